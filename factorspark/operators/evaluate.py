"""Forward returns, information coefficients and cumulative series."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.columns import div
from .calendar import steps


def _code() -> WindowSpec:
    return Window.partitionBy("code").orderBy("t")


def forward_return(prices: DataFrame, n: int, cost: str = "open", close: str = "close", calendar: DataFrame | None = None, start: dt.date | None = None, end: dt.date | None = None, fill: bool = True) -> DataFrame:
    """Adds `forward`: close n rows ahead over the cost one row ahead, less 1; rows without it are dropped.

    With a `calendar`, only prices from `start` to `end` are looked at; with `fill`, those of the n trading days after
    `end` too, as far as there are any."""
    if start is not None:
        prices = prices.where(F.col("time") >= F.lit(start))
    if end is not None:
        last = max((t for time, t in steps(calendar) if time <= end), default=0)
        prices = prices.where(F.col("t") <= last + (n if fill else 0))
    out = prices.withColumn("forward", div(F.lead(close, n).over(_code()), F.lead(cost, 1).over(_code())) - 1)
    return out.where("forward is not null")


def labels(prices: DataFrame, n: int, keep_unknown: bool = False) -> DataFrame:
    """Adds close_future, return_ratio and class_label (1 for a rise). Unknown returns are dropped, or
    labelled 0 with `keep_unknown`."""
    out = prices.withColumn("close_future", F.lead("close", n).over(_code())).withColumn("return_ratio", div("close_future", "close") - 1)
    out = out.withColumn("class_label", F.coalesce((F.col("return_ratio") > 0).cast("int"), F.lit(0)))
    return out if keep_unknown else out.where("return_ratio is not null")


def average_rank(column: str, by: list[str]) -> Column:
    """Rank with ties averaged, NULL for NULL."""
    value = Window.partitionBy(*by, F.col(column).isNull()).orderBy(column)
    ties = F.count("*").over(Window.partitionBy(*by, column))
    return F.when(F.col(column).isNotNull(), F.rank().over(value) + (ties - 1) / 2.0)


def correlation(a: str, b: str) -> Column:
    """Pearson correlation as an aggregate; NULL, not an error, where one side does not vary."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return div(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def inversions(y: np.ndarray) -> int:
    """Pairs of places with a greater whole number before a smaller one: level by level, those between the halves of each
    block, whose sorted left halves are looked up by the right ones."""
    place, top, total, size = np.arange(len(y)), int(y.max(initial=0)) + 1, 0, 1
    while size < len(y):
        block, late = place // (2 * size), place // size % 2 == 1
        keys = block * top + y
        left = np.sort(keys[~late])
        end = np.searchsorted(left, (block[late] + 1) * top, "left")
        total += int((end - np.searchsorted(left, keys[late], "right")).sum())
        size *= 2
    return total


def _kendall(rows: pd.DataFrame) -> pd.DataFrame:
    """tau-b, by the inversions of y in the order of x and y."""
    x, y = rows["value"].to_numpy(float), rows["forward"].to_numpy(float)
    order = np.lexsort((y, x))
    x, y = x[order], np.unique(y[order], return_inverse=True)[1]
    n, swaps = len(x), inversions(y)
    pairs = lambda c: (c * (c - 1) // 2).sum()
    tx, ty = (pairs(np.unique(z, return_counts=True)[1]) for z in (x, y))
    txy = pairs(np.unique(np.stack((x, y)), axis=1, return_counts=True)[1])
    total = n * (n - 1) // 2
    base = np.sqrt(float(total - tx) * float(total - ty))
    ic = (total - tx - ty + txy - 2 * swaps) / base if base else None
    return pd.DataFrame({"time": [rows["time"].iloc[0]], "factor": [rows["factor"].iloc[0]], "ic": [ic]})


def ranked(values: np.ndarray) -> np.ndarray:
    """Ranks from 1 on, ties averaged."""
    order = np.argsort(values)
    start = np.flatnonzero(np.r_[True, values[order[1:]] != values[order[:-1]]]) if len(values) else np.zeros(0, int)
    count = np.diff(np.r_[start, len(values)])
    out = np.empty(len(values))
    out[order] = np.repeat(start + (count + 1) / 2, count)
    return out


def _spearman(columns: list[str]):
    def ics(rows: pa.Table) -> pa.Table:
        """One date: the correlations of the ranks of each column and of `forward`, over the rows that have both."""
        x, y = (np.stack([rows[c].to_pandas().to_numpy(float) for c in names]) for names in (columns, ["forward"]))
        back, found = ranked(y[0]), {}
        for c, values in zip(columns, x, strict=True):
            have = ~np.isnan(values)
            if have.any():
                a, b = ranked(values[have]), back if have.all() else ranked(y[0][have])
                a, b = a - (len(a) + 1) / 2, b - (len(b) + 1) / 2
                size = np.sqrt((a @ a) * (b @ b))
                found[c] = a @ b / size if size else None
        return pa.table({"time": [rows["time"][0].as_py()] * len(found), "factor": list(found), "ic": list(found.values())}, pa.schema([("time", pa.date32()), ("factor", pa.string()), ("ic", pa.float64())]))

    return ics


def factor_ic(factors: DataFrame, returns: DataFrame, columns: list[str], kind: str = "spearman") -> DataFrame:
    """(time, factor, ic): correlation of each factor with `forward` per date, over rows that have both."""
    rows = factors.select("code", "time", *columns).join(returns.select("code", "time", "forward"), ["code", "time"])
    if kind == "spearman":  # a date at once, which has a row per code: ranks of each column need its order only
        known = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(c)
        rows = rows.select("time", known("forward"), *map(known, columns)).where("forward is not null")
        return rows.groupBy("time").applyInArrow(_spearman(columns), "time date, factor string, ic double")
    long = rows.unpivot(["time", "forward"], columns, "factor", "value").where("value is not null and forward is not null")
    if kind == "kendall":
        return long.groupBy("time", "factor").applyInPandas(_kendall, "time date, factor string, ic double")
    if kind != "pearson":
        raise ValueError(f"unknown kind {kind}")
    return long.groupBy("time", "factor").agg(correlation("value", "forward").alias("ic"))


def icir(ic: DataFrame) -> DataFrame:
    """Per factor: mean, sample deviation, count, min, max of the IC and icir = mean / deviation."""
    out = ic.groupBy("factor").agg(F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.count("ic").alias("n"), F.min("ic").alias("min"), F.max("ic").alias("max"))
    return out.withColumn("icir", div("mean", "std"))


def cumulative(series: DataFrame, ret: str = "ret", last: int = 251, by: str = "factor") -> DataFrame:
    """The last rows of each series with `cum_return` (first return taken as 0) and `cum_sum`."""
    newest = Window.partitionBy(by).orderBy(F.desc("t"))
    over = Window.partitionBy(by).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = series.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last).drop("_n")
    out = out.withColumn("_r", F.when(F.row_number().over(Window.partitionBy(by).orderBy("t")) == 1, 0.0).otherwise(F.col(ret)))
    return out.withColumn("cum_return", F.product(1 + F.col("_r")).over(over) - 1).withColumn("cum_sum", F.sum(ret).over(over)).drop("_r")
