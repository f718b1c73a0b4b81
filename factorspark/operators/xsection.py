"""Cross-section operators: one date (or one date and group) is a partition.

Statistics are window aggregates over the date's partition, so any number of them in a row costs one
exchange by date and the input is read once. A date has one row per code, so partitions are even. Cleaning of many
columns, which needs the order of each, sorts a date's columns as arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.columns import div, row_mean
from .panel import last_known


def _over(by: str | list[str]) -> WindowSpec:
    return Window.partitionBy(*([by] if isinstance(by, str) else by))


def winsorize(df: DataFrame, columns: list[str], by: str | list[str] = "time", lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """Clips each column to its quantiles (linear interpolation) of the date; NULL stays NULL."""
    bounds = {f"_{c}": F.percentile(c, F.array(F.lit(lower), F.lit(upper))).over(_over(by)) for c in columns}
    clip = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_{c}")[1]), F.col(f"_{c}")[0]))
    return df.withColumns(bounds).withColumns({c: clip(c) for c in columns}).drop(*bounds)


def fill_median(df: DataFrame, columns: list[str], by: str | list[str] = "time") -> DataFrame:
    """NULL becomes the date's median."""
    return df.withColumns({c: F.coalesce(F.col(c), F.percentile(c, 0.5).over(_over(by))) for c in columns})


def zscore(df: DataFrame, columns: list[str], by: str | list[str] = "time", eps: float = 1e-6) -> DataFrame:
    """(x - mean) / (sample deviation + eps) per date."""
    over = _over(by)
    return df.withColumns({c: div(F.col(c) - F.avg(c).over(over), F.stddev_samp(c).over(over) + eps) for c in columns})


def _quantiles(ordered: np.ndarray, known: np.ndarray, share: float) -> np.ndarray:
    """Of each row the quantile of its first `known` values, which are in order; NaN without any."""
    at = share * np.maximum(known - 1, 0)
    low, high, row = np.floor(at).astype(int), np.ceil(at).astype(int), np.arange(len(ordered))
    below, above = ordered[row, low], ordered[row, high]
    return np.where(low == high, below, (high - at) * below + (at - low) * above)


def _cleaned(columns: list[str], lower: float, upper: float, eps: float):
    def clean(rows: pa.Table) -> pa.Table:
        """One date: clipped to the quantiles, unknown values at the median of the clipped ones, z-scores."""
        x = np.stack([rows[c].to_pandas().to_numpy(float) for c in columns])
        ordered, known = np.sort(x, 1), (~np.isnan(x)).sum(1)
        bounds = [_quantiles(ordered, known, q)[:, None] for q in (lower, upper)]
        clip = lambda v: np.maximum(np.minimum(v, bounds[1]), bounds[0])
        x = clip(x)
        x = np.where(np.isnan(x), _quantiles(clip(ordered), known, 0.5)[:, None], x)
        spread = (x.std(1, ddof=1) if rows.num_rows > 1 else np.full(len(x), np.nan)) + eps
        x = (x - x.mean(1)[:, None]) / np.where(spread == 0, np.nan, spread)[:, None]
        return pa.table([rows["code"], rows["time"], *[pa.array(v, from_pandas=True) for v in x]], names=["code", "time", *columns])

    return clean


def _scored(columns: list[str], eps: float):
    def score(rows: pa.Table) -> pa.Table:
        """One date: z-scores of the known values of each column."""
        x = np.stack([rows[c].to_pandas().to_numpy(float) for c in columns])
        n = (~np.isnan(x)).sum(1)[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            gap = x - np.nansum(x, 1, keepdims=True) / n
            spread = np.sqrt(np.nansum(gap * gap, 1, keepdims=True) / np.where(n > 1, n - 1, np.nan)) + eps
            x = gap / np.where(spread == 0, np.nan, spread)
        scored = dict(zip(columns, x, strict=True))
        return pa.table([pa.array(scored[c], from_pandas=True) if c in scored else rows[c] for c in rows.column_names], names=rows.column_names)

    return score


def zscore_many(df: DataFrame, columns: list[str], by: str = "time", eps: float = 1e-6) -> DataFrame:
    """`zscore` of many columns, all those of a date together; NaN counts as unknown."""
    kinds = {c: "double" if c in columns else kind for c, kind in df.dtypes}
    known = {c: F.nanvl(F.col(c).cast("double"), F.lit(None)) for c in columns}
    return df.withColumns(known).groupBy(by).applyInArrow(_scored(columns, eps), ", ".join(f"`{c}` {kind}" for c, kind in kinds.items()))


def clean_panel(factor: DataFrame, price_keys: DataFrame, columns: list[str], lower: float = 0.01, upper: float = 0.99, eps: float = 1e-6) -> DataFrame:
    """Factor rows on exactly the price rows (code, time): fill forward, winsorize, fill with medians, z-score. A date, which
    has a row per code, is cleaned at once, all columns together; NaN counts as unknown."""
    aligned = price_keys.select("code", "time").join(factor.select("code", "time", *columns), ["code", "time"], "left")
    filled = aligned.select("code", "time", *[last_known(F.nanvl(F.col(c).cast("double"), F.lit(None)), t="time").alias(c) for c in columns])
    kinds = dict(filled.dtypes)
    return filled.groupBy("time").applyInArrow(_cleaned(columns, lower, upper, eps), ", ".join(f"`{c}` {kinds[c]}" for c in ("code", "time", *columns)))


def mad_winsorize(df: DataFrame, column: str | list[str], by: str | list[str] = "time", k: float = 5.0) -> DataFrame:
    """Clips columns to k median absolute deviations around the median of their group."""
    columns, over = [column] if isinstance(column, str) else column, _over(by)
    df = df.withColumns({f"_mid{c}": F.percentile(c, 0.5).over(over) for c in columns})
    df = df.withColumns({f"_gap{c}": F.percentile(F.abs(F.col(c) - F.col(f"_mid{c}")), 0.5).over(over) * k for c in columns})
    clip = lambda c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.col(f"_mid{c}") + F.col(f"_gap{c}")), F.col(f"_mid{c}") - F.col(f"_gap{c}")))
    return df.withColumns({c: clip(c) for c in columns}).drop(*[f"_{n}{c}" for c in columns for n in ("mid", "gap")])


def mad_standardize(df: DataFrame, columns: list[str], by: str | list[str] = "time", k: float = 5.0) -> DataFrame:
    """Median fill, MAD clip, then (x - mean) / sample deviation."""
    return zscore(mad_winsorize(fill_median(df, columns, by), columns, by, k), columns, by, 0.0)


def regression_residual(df: DataFrame, y: str, x: str, weight: Column, by: str | list[str] = "time") -> DataFrame:
    """Adds `residual` of y on (1, x) with weights, per date; NULL where x does not vary."""
    over, w, a, b = _over(by), F.col("_w"), F.col(x) - F.col("_mx"), F.col(y) - F.col("_my")
    total = lambda c: F.sum(w * c).over(over)
    rows = df.withColumn("_w", F.when(F.col(y).isNotNull() & F.col(x).isNotNull(), weight))
    used = F.when(w.isNotNull(), F.col(x))
    rows = rows.withColumns({"_mx": div(total(F.col(x)), F.sum(w).over(over)), "_my": div(total(F.col(y)), F.sum(w).over(over)), "_varies": F.min(used).over(over) < F.max(used).over(over)})
    # sums of deviations from the means: those of the plain values would cancel
    rows = rows.withColumn("_b", F.when(F.col("_varies"), div(total(a * b), total(a * a))))
    return rows.withColumn("residual", b - F.col("_b") * a).drop("_w", "_mx", "_my", "_varies", "_b")


def group_relative(df: DataFrame, value: str, weight: Column, by: list[str]) -> DataFrame:
    """Adds `relative`: the group's weighted mean of `value` minus the row's own."""
    w = F.when(F.col(value).isNotNull(), weight)
    over = Window.partitionBy(*by)
    return df.withColumn("relative", div(F.sum(w * F.col(value)).over(over), F.sum(w).over(over)) - F.col(value))


def dummies(df: DataFrame, column: str, values: list[str], constant: str | None = "country") -> DataFrame:
    """0/1 columns for a fixed list of values, and a constant column."""
    out = df.withColumns({f"{column}_{v}": F.coalesce((F.col(column) == v).cast("double"), F.lit(0.0)) for v in values})
    return out.withColumn(constant, F.lit(1.0)) if constant else out


def cap_shares(df: DataFrame, cap: str, by: str = "time", group: str = "L1") -> DataFrame:
    """(date, group, share) of a group's capital in the date's."""
    sums = df.groupBy(by, group).agg(F.sum(cap).alias("_cap"))
    return sums.select(by, group, div(F.col("_cap"), F.sum("_cap").over(Window.partitionBy(by))).alias("share"))


def style_composite(df: DataFrame, styles: dict[str, list[str]], by: str = "time", eps: float = 1e-6) -> DataFrame:
    """Per style, the mean of its non-null descriptors, z-scored per date."""
    return zscore(df.select("code", by, *[row_mean(c).alias(s) for s, c in styles.items()]), list(styles), by, eps)


def ic_weighted_composite(df: DataFrame, ic: DataFrame, columns: list[str], half_life: float = 250, least: int = 120) -> DataFrame:
    """Mean of exposures weighted by the half-life average of all earlier ICs (time, t, factor, ic).

    A factor counts once it has `least` earlier ICs; weights are divided by the sum of their absolute values.
    """
    before = Window.partitionBy("factor").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    grown = F.pow(F.lit(2.0), F.col("t") / F.lit(float(half_life)))
    known = F.col("ic").isNotNull()
    smooth = F.when(F.count("ic").over(before) >= least, div(F.sum(F.when(known, grown * F.col("ic"))).over(before), F.sum(F.when(known, grown)).over(before)))
    weights = ic.select("time", "factor", smooth.alias("w")).groupBy("time").pivot("factor", columns).agg(F.first("w"))
    weights = weights.select("time", *[F.col(c).alias(f"_w{c}") for c in columns])
    term = lambda c: F.coalesce(F.col(f"_w{c}") * F.col(c), F.lit(0.0))
    size = lambda c: F.coalesce(F.when(F.col(c).isNotNull(), F.abs(F.col(f"_w{c}"))), F.lit(0.0))
    top, bottom = term(columns[0]), size(columns[0])
    for c in columns[1:]:
        top, bottom = top + term(c), bottom + size(c)
    return df.join(weights, "time").select("code", "time", div(top, bottom).alias("composite"))
