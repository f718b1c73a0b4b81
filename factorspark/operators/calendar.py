"""Trading calendar: a small table (time, t) with t = 1, 2, .. in order of time.

It has one row per trading day, so what is derived from it alone (`snap_map`, bounds, months) is worked out on the driver
and enters plans as a local table.
"""

from __future__ import annotations

import bisect
import datetime as dt
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.columns import report_deadline


def ordinals(df: DataFrame, time: str = "time") -> DataFrame:
    """The calendar of the times in `df`. The one global window runs over distinct times only."""
    return df.select(F.col(time).alias("time")).where("time is not null").distinct().withColumn("t", F.row_number().over(Window.orderBy("time")))


def resolve_window(calendar: DataFrame, start: dt.date | None = None, end: dt.date | None = None, count: int | None = None) -> DataFrame:
    """One row (start, end) from any two of the three; `count` trading days include the anchor.

    Both dates given: count is ignored. Too little history: the bound that is sought is NULL.
    """
    if sum(x is not None for x in (start, end, count)) < 2:
        raise ValueError("two of start, end and count are needed")
    one = calendar.agg(F.max(F.when(F.col("time") <= F.lit(end), F.col("t"))).alias("e"), F.min(F.when(F.col("time") >= F.lit(start), F.col("t"))).alias("s"))
    if start is not None and end is not None:
        return one.select(F.lit(start).alias("start"), F.lit(end).alias("end"))
    if end is not None:
        bound, names = F.col("e") - (count - 1), (F.col("time").alias("start"), F.lit(end).alias("end"))
    else:
        bound, names = F.col("s") + (count - 1), (F.lit(start).alias("start"), F.col("time").alias("end"))
    return one.select(bound.alias("t")).join(F.broadcast(calendar), "t", "left").select(*names)


def trading_days(calendar: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    return calendar.where(F.col("time").between(F.lit(start), F.lit(end)))


def shift_days(df: DataFrame, calendar: DataFrame, n: int, time: str = "time") -> DataFrame:
    """Adds `shifted`: n trading days on; n calendar days on where that leaves the calendar or `time` is none of its days."""
    here = calendar.select(F.col("time").alias(time), (F.col("t") + n).alias("_t"))
    there = calendar.select(F.col("t").alias("_t"), F.col("time").alias("_time"))
    to = here.join(F.broadcast(there), "_t", "left").select(time, "_time")
    return df.join(F.broadcast(to), time, "left").withColumn("shifted", F.coalesce("_time", F.date_add(time, n))).drop("_time")


_steps: weakref.WeakKeyDictionary[DataFrame, list[tuple[dt.date, int]]] = weakref.WeakKeyDictionary()


def steps(calendar: DataFrame) -> list[tuple[dt.date, int]]:
    """The calendar's rows in order."""
    if calendar not in _steps:
        _steps[calendar] = sorted((r["time"], r["t"]) for r in calendar.select("time", "t").collect())
    return _steps[calendar]


def local(like: DataFrame, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """A small table of the driver's."""
    arrays = zip(*rows, strict=True) if rows else [[] for _ in columns]
    return like.sparkSession.createDataFrame(pa.table({n: pa.array(x, t) for (n, t), x in zip(columns.items(), arrays, strict=True)}))


def snap_map(calendar: DataFrame) -> DataFrame:
    """(day, time, t): for every day from the first to the last trading day, the first trading day on or after it."""
    rows, day = [], None
    for time, t in steps(calendar):
        day = time if day is None else day
        while day <= time:
            rows.append((day, time, t))
            day += dt.timedelta(1)
    return local(calendar, rows, day=pa.date32(), time=pa.date32(), t=pa.int32())


def snapped(df: DataFrame, calendar: DataFrame, date_col: str) -> DataFrame:
    """Adds (time, t), the first trading day on or after `date_col`; rows after the last trading day are dropped."""
    first = steps(calendar)[0][0] if steps(calendar) else None
    day = F.greatest(F.col(date_col), F.lit(first).cast("date"))
    return df.where(F.col(date_col).isNotNull()).withColumn("day", day).join(F.broadcast(snap_map(calendar)), "day").drop("day")


def step_distances(calendar: DataFrame, years: int) -> dict[int, list[int]]:
    """Of each trading day's step, for each number of years back, how many steps before it the first trading day on or after
    365 days a year before lies; years that begin before the calendar are left out."""
    days = steps(calendar)
    out: dict[int, list[int]] = {}
    for time, t in days:
        for i in range(1, years + 1):
            day = time - dt.timedelta(365 * i)
            if day >= days[0][0]:
                out.setdefault(t, []).append(t - days[bisect.bisect_left(days, (day, 0))][1])
    return out


def period_ends(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """All quarter ends from the quarter of `start` to the quarter of `end`."""
    quarter = F.explode(F.sequence(F.trunc(F.lit(start), "quarter"), F.trunc(F.lit(end), "quarter"), F.expr("interval 3 months")))
    return spark.range(1).select(quarter.alias("q")).select(F.last_day(F.add_months("q", 2)).alias("statDate"))


def on_time(filings: DataFrame) -> DataFrame:
    """Filings published before their deadline, dated at the deadline; later ones are dropped."""
    return filings.withColumn("_due", report_deadline()).where("pubDate < _due").withColumn("pubDate", F.col("_due")).drop("_due")


def rebalance_dates(spark: SparkSession, start: dt.date, end: dt.date) -> DataFrame:
    """May 1 and Sep 1 before `end`, from the last one on or before `start` on."""
    dates = [dt.date(y, m, 1) for y in range(start.year - 1, end.year + 1) for m in (5, 9) if dt.date(y, m, 1) < end]
    first = max((d for d in dates if d <= start), default=start)
    return spark.createDataFrame([(d,) for d in dates if d >= first], "time date")


def rebalance_of(calendar: DataFrame) -> DataFrame:
    """The rebalancing dates of a whole calendar: May 1 and Sep 1 before its last day, from the last one on or before
    its first day on."""
    span = calendar.agg(F.min("time").alias("first"), F.max("time").alias("last"))
    years = span.select("first", "last", F.explode(F.sequence(F.year("first") - 1, F.year("last"))).alias("_y"))
    dates = years.select("first", "last", F.explode(F.array(*[F.make_date("_y", F.lit(m), F.lit(1)) for m in (5, 9)])).alias("time")).where("time < last")
    start = dates.where("time <= first").agg(F.max("time"))
    return dates.where(F.col("time") >= start.scalar()).select("time")


def month_starts(calendar: DataFrame) -> DataFrame:
    """(time, month_start): the first trading day of each day's month, for days that need no ordinal."""
    first: dict[tuple[int, int], dt.date] = {}
    days = sorted(r["time"] for r in calendar.select("time").distinct().collect())
    rows = [(d, first.setdefault((d.year, d.month), d)) for d in days]
    return local(calendar, rows, time=pa.date32(), month_start=pa.date32())
