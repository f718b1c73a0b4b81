"""Irregular analyst forecasts: expanding statistics, changes and decayed sums."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import by_code, div
from .calendar import local, snapped, steps
from .panel import last_known

LOOK_BACK = 1095
EXACT, UNIT = "decimal(24,8)", 1e8


def forecast_days(reports: DataFrame, values: list[str]) -> DataFrame:
    """(code, year, time, n, and for each value its count k_, sum s_ and sum of squares ss_): forecasts of a day for a
    target year, so a much covered code is no long window. Sums are exact, so their order does not matter."""
    sums = []
    for v in values:
        sums += [F.count(v).alias(f"k_{v}"), F.sum(F.col(v).cast(EXACT)).alias(f"s_{v}"), F.sum((F.col(v) * F.col(v)).cast(EXACT)).alias(f"ss_{v}")]
    return reports.groupBy("code", "year", "time").agg(F.count("*").alias("n"), *sums)


def expanding_forecast(days: DataFrame, calendar: DataFrame, value: str, ahead: int = 0, least: int = 5, look_back: int = LOOK_BACK) -> DataFrame:
    """(code, time, mean, std): statistics of all forecasts for the year `ahead` years on, up to each day.

    `days` are those of `forecast_days`, `year` being the target. Within the calendar year of target - `ahead`,
    each trading day has the mean and population deviation of the target's forecasts so far, from the `look_back`
    trading days before that year's end on, once there are `least` of them (NULLs count).
    """
    spans: dict[int, list[int]] = {}
    place = dict((t, time) for time, t in steps(calendar))
    for t, time in place.items():
        spans.setdefault(time.year, []).append(t)
    years = local(calendar, [(y, min(t), max(t), place[max(max(t) - look_back + 1, min(place))]) for y, t in spans.items()], own=pa.int32(), _low=pa.int32(), _high=pa.int32(), _first=pa.date32())
    rows = days.withColumn("own", F.col("year") - ahead).join(F.broadcast(years), "own").where((F.col("time") >= F.col("_first")) & (F.year("time") <= F.col("own")))
    over = Window.partitionBy("code", "own").orderBy("time").rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.sum(c).over(over)
    so_far = rows.select("code", "own", "_low", "_high", "time", total("n").alias("n"), total(f"k_{value}").alias("k"), F.rint(total(f"s_{value}").cast("double") * UNIT).alias("s"), total(f"ss_{value}").cast("double").alias("ss"))
    mean = div(F.col("s"), F.col("k") * UNIT)  # one division of whole numbers: equal means are equal to the last bit
    spread = F.sqrt(F.greatest(div("ss", "k") - mean * mean, F.lit(0.0)))
    known = so_far.where(F.col("n") >= least).select("code", "own", "_low", "_high", F.col("time").alias("_on"), mean.alias("mean"), spread.alias("std"))
    # what is known before the year stands on its first trading day
    at = snapped(known, calendar, "_on").withColumn("t", F.greatest("t", "_low")).where("t <= _high")
    at = at.groupBy("code", "own", "t", "_high").agg(*[F.max_by(c, "_on").alias(c) for c in ("mean", "std")])
    grid = at.groupBy("code", "own", "_high").agg(F.min("t").alias("_from")).select("code", "own", F.explode(F.sequence("_from", "_high")).alias("t"))
    dense = grid.join(at.drop("_high"), ["code", "own", "t"], "left").join(F.broadcast(calendar), "t")
    fill = Window.partitionBy("code", "own").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return dense.select("code", "time", *[F.last(c, ignorenulls=True).over(fill).alias(c) for c in ("mean", "std")])


def padded_change(value: str, n: int) -> Column:
    """Change over n steps of the forward-filled value; needs dense rows with `_known` set to it."""
    return div(F.col(value), F.lag(F.col(value), n).over(by_code())) - 1


def decayed_changes(df: DataFrame, values: dict[str, str], n: int, terms: int = 4) -> DataFrame:
    """Adds for each `name: column` the sum over i < terms of the column's n-step change i * n rows before,
    over i + 1; unknown changes are 0. Needs dense rows.

    A name is NULL before the code's first value and on dates before any code has a change.
    """
    # a change is known n steps after a value other than 0, for the first time after the first of all codes
    first = df.agg(F.struct(*[F.min(F.when(F.col(c) != 0, F.col("t"))).alias(name) for name, c in values.items()])).scalar()
    df = df.withColumns({f"_k{name}": last_known(c) for name, c in values.items()})
    df = df.withColumns({f"_c{name}": padded_change(f"_k{name}", n) for name in values})
    df = df.withColumns({f"_s{name}": _decayed(f"_c{name}", n, terms) for name in values})
    df = df.withColumns({name: F.when((F.col("t") >= first[name] + n) & F.col(f"_k{name}").isNotNull(), F.col(f"_s{name}")) for name in values})
    return df.drop(*[f"_{x}{name}" for x in "kcs" for name in values])


def _decayed(change: str, n: int, terms: int) -> Column:
    total = F.coalesce(F.col(change), F.lit(0.0))
    for i in range(1, terms):
        total = total + F.coalesce(F.lag(change, i * n).over(by_code()), F.lit(0.0)) / (i + 1)
    return total
