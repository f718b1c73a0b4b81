"""Panel operators: selection, de-duplication, completeness, alignment and fills. Tables stay long."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import by_code
from .calendar import month_starts, ordinals, resolve_window, snapped, steps


def select_panel(df: DataFrame, codes: DataFrame | None = None, start: dt.date | None = None, end: dt.date | None = None, fields: list[str] | None = None, time: str = "time") -> DataFrame:
    """Rows in the inclusive date range whose code is in `codes`, with the keys and `fields`."""
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end))
    if codes is not None:
        df = df.join(codes.select("code").distinct(), "code", "left_semi")
    return df if fields is None else df.select("code", time, *fields)


def select_statements(df: DataFrame, start: dt.date | None = None, end: dt.date | None = None, count: int | None = None, codes: DataFrame | None = None, fields: list[str] | None = None) -> DataFrame:
    """Statements of a window of report periods: from any two of start, end and count, where count is a number of
    distinct statDates."""
    bounds = resolve_window(ordinals(df, "statDate"), start, end, count)
    inside = F.col("statDate").between(F.coalesce(bounds.select("start").scalar(), "statDate"), F.coalesce(bounds.select("end").scalar(), "statDate"))
    return select_panel(df.where(inside), codes, fields=None if fields is None else ["pubDate", *fields], time="statDate")


def select_reports(reports: DataFrame, years: list[int], codes: DataFrame | None = None, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Forecasts for target years, by the year that their `quarter` ("2023Q4") begins with, which becomes `year`."""
    year = F.substring("quarter", 1, 4).try_cast("int")
    return select_panel(reports.withColumn("year", year).where(F.col("year").isin(years)), codes, start, end)


def with_prefix(df: DataFrame, prefixes: list[str], code: str = "code") -> DataFrame:
    """Rows whose code begins with one of the prefixes."""
    test = F.lit(False)
    for prefix in prefixes:
        test = test | F.col(code).cast("string").startswith(prefix)
    return df.where(test)


def listed_before(listing: DataFrame, start: dt.date) -> DataFrame:
    """Codes of a listing (code, list_date) that are listed on `start`."""
    return listing.where(F.col("list_date") <= F.lit(start)).select("code").distinct()


def with_industry(df: DataFrame, industry: DataFrame, columns: tuple[str, ...] = ("L1",), month_start: bool = False, how: str = "inner", calendar: DataFrame | None = None) -> DataFrame:
    """Adds industry columns: those of the code, or of (code, time) if the industry table varies in time; with
    `month_start`, those of the first day of the month: of the calendar's days, or else of those of `df`, which has to be
    computed for it."""
    if "time" not in industry.columns:
        return df.join(industry.select("code", *columns), "code", how)
    if not month_start:
        return df.join(industry.select("code", "time", *columns), ["code", "time"], how)
    dated = df.join(F.broadcast(month_starts(df if calendar is None else calendar)), "time")  # one row per trading day
    return dated.join(industry.select("code", F.col("time").alias("month_start"), *columns), ["code", "month_start"], how).drop("month_start")


def dedupe_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in the given order."""
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def complete_codes(tables: list[DataFrame], periods: DataFrame, key: str = "statDate") -> DataFrame:
    """Codes that have every period in every table."""
    n = len(tables)
    have = None
    for k, df in enumerate(tables):
        part = df.select("code", key).join(F.broadcast(periods.select(key).distinct()), key, "left_semi").withColumn("_table", F.lit(k))
        have = part if have is None else have.unionByName(part)
    counted = have.distinct().groupBy("code").agg(F.count("*").alias("_have"))
    need = periods.select(F.count_distinct(key).alias("_need"))
    return counted.join(F.broadcast(need), F.col("_have") == F.col("_need") * n).select("code")


def densify(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """A row for every code and calendar step from the code's first row to the calendar's end (needs `t`)."""
    last = max((t for _, t in steps(calendar)), default=0)
    span = df.groupBy("code").agg(F.min("t").alias("_from")).where(F.col("_from") <= last)
    grid = span.select("code", F.explode(F.sequence(F.col("_from"), F.lit(last))).alias("t"))
    grid = grid.join(F.broadcast(calendar), "t")
    return grid.join(df.drop("time"), ["code", "t"], "left")


def last_known(column: str | Column, code: str = "code", t: str = "t") -> Column:
    """The column's last non-null value up to the row."""
    return F.last(column, ignorenulls=True).over(by_code(code, t).rowsBetween(Window.unboundedPreceding, 0))


def fill_limited(column: str, most: int) -> Column:
    """The last value, if it is at most `most` steps old."""
    at = F.last(F.when(F.col(column).isNotNull(), F.col("t")), ignorenulls=True).over(by_code().rowsBetween(Window.unboundedPreceding, 0))
    return F.when(F.col("t") - at <= most, last_known(column))


def asof_align_all(parts: list[tuple[DataFrame, str, list[str], str]], calendar: DataFrame, end: dt.date | None = None) -> DataFrame:
    """(code, time, values): as `asof_align`, of several tables (df, date_col, values, order) at once: one exchange and
    one pass over the trading days carry all their columns. Column names differ between the tables."""
    if end is not None:
        calendar = calendar.where(F.col("time") <= F.lit(end))
    rows, names = None, []
    for df, date_col, values, order in parts:
        names += values
        part = df.select("code", F.col(date_col).alias("_day"), F.col(order).alias("_order"), *values)
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    rows = snapped(rows, calendar, "_day").repartition("code")
    at = rows.groupBy("code", "time", "t").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_order"))).alias(c) for c in names])
    return densify(at, calendar).select("code", "time", *[last_known(c).alias(c) for c in names])


def asof_align(df: DataFrame, calendar: DataFrame, date_col: str, values: list[str], order: str, end: dt.date | None = None) -> DataFrame:
    """(code, time, values): each record lands on the first trading day on or after its date, and every
    column carries its own last non-null value forward over the trading days.

    Records of one day count in the order of `order`, column by column. Records of any age before the first trading
    day land on it; records past the last one are dropped.
    """
    return asof_align_all([(df, date_col, values, order)], calendar, end)


def backfill(df: DataFrame, calendar: DataFrame, column: str, other: str) -> DataFrame:
    """`column` on every trading day: the next known value, `other` after the last one."""
    grid = df.select("code").distinct().join(F.broadcast(calendar))
    grid = grid.join(df.select("code", "t", column), ["code", "t"], "left")
    follow = F.first(column, ignorenulls=True).over(by_code().rowsBetween(0, Window.unboundedFollowing))
    return grid.select("code", "time", F.coalesce(follow, F.lit(other)).alias(column))


def map_category(df: DataFrame, mapping: DataFrame, fine: str, coarse: str, other: str = "other") -> DataFrame:
    """Adds the coarse category of a map, which Spark broadcasts if it is small; unmapped values go to `other`, and of
    several categories of a value the largest counts."""
    one = mapping.groupBy(fine).agg(F.max(coarse).alias(coarse))
    return df.drop(coarse).join(one, fine, "left").withColumn(coarse, F.coalesce(coarse, F.lit(other)))


def join_statements(tables: list[DataFrame], keys: tuple[str, ...] = ("code", "statDate")) -> DataFrame:
    """Inner join of statement tables on their keys; columns of later tables that repeat are dropped."""
    out = tables[0]
    for df in tables[1:]:
        out = out.join(df.select(*keys, *[c for c in df.columns if c not in out.columns]), list(keys))
    return out
