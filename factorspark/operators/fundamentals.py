"""Statement operators: quarterly values, trailing sums, point-in-time differences and trend slopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..functions.columns import div
from .panel import dedupe_last, join_statements


def _periods() -> WindowSpec:
    return Window.partitionBy("code").orderBy("statDate")


def _year() -> WindowSpec:
    return Window.partitionBy("code", F.year("statDate")).orderBy("statDate")


def quarter_value(c: str) -> Column:
    """Year-to-date value less the row before; the value itself in the year's first period."""
    return F.when(F.quarter("statDate") == 1, F.col(c)).otherwise(F.col(c) - F.lag(c).over(_periods()))


def ttm(df: DataFrame, columns: list[str], rows: int = 4, cumulative: bool = True) -> DataFrame:
    """Adds `<c>_ttm`: the sum of the last `rows` single-period values, NULL unless all are known."""
    over = _periods().rowsBetween(-(rows - 1), 0)
    single = df.withColumns({f"_{c}": quarter_value(c) if cumulative else F.col(c) for c in columns})
    total = lambda c: F.when(F.count(f"_{c}").over(over) == rows, F.sum(f"_{c}").over(over))
    return single.withColumns({f"{c}_ttm": total(c) for c in columns}).drop(*[f"_{c}" for c in columns])


def half_year_ttm(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds `<c>_ttm` for amounts that are filed for half-years: in June and December rows, the sum of the last two
    half-years, of which June's is the year to date and December's that less June's; NULL in other rows."""
    half = F.month("statDate").isin(6, 12)
    over = Window.partitionBy("code", half).orderBy("statDate")
    single = df.withColumns({f"_{c}": F.when(F.month("statDate") == 6, F.col(c)).otherwise(F.col(c) - F.lag(c).over(over)) for c in columns})
    return single.withColumns({f"{c}_ttm": F.when(half, F.col(f"_{c}") + F.lag(f"_{c}").over(over)) for c in columns}).drop(*[f"_{c}" for c in columns])


def parent_profit() -> Column:
    """Net profit of the parent's owners: comprehensive income to the parent less other comprehensive income."""
    return F.coalesce("compr_inc_attr_p", F.lit(0.0)) - F.coalesce("oth_compr_income", F.lit(0.0))


def combine_statements(income: DataFrame, balance: DataFrame, cashflow: DataFrame) -> DataFrame:
    """One row per (code, statDate) of the three statements' last filings, with np_parent_company_owners."""
    last = [dedupe_last(df, ["code", "statDate"], ["pubDate"]) for df in (income, balance, cashflow)]
    return join_statements(last).withColumn("np_parent_company_owners", parent_profit())


def trailing(finance: DataFrame) -> DataFrame:
    """Statements with all trailing sums: of year-to-date amounts, of half-yearly net profit, and of the cash increase,
    which is filed per quarter."""
    out = ttm(finance, ["operating_revenue", "total_operating_revenue", "total_operating_cost", "np_parent_company_owners", "operating_cost"])
    return ttm(half_year_ttm(out, ["net_profit"]), ["cash_equivalent_increase"], cumulative=False)


def capital_expenditure() -> Column:
    """Cash paid for long-term assets less the year's change in long-term debt without interest, which is that from the
    first to the last of the rows that the code has for the year."""
    debt = F.coalesce("longterm_account_payable", F.lit(0.0)) + F.coalesce("specific_account_payable", F.lit(0.0))
    year = _year().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.col("fix_intan_other_asset_acqui_cash") - (F.last(debt).over(year) - F.first(debt).over(year))


def second_half(df: DataFrame, columns: list[str]) -> DataFrame:
    """In years of exactly two rows, the second row's columns become its own half's: itself less the first."""
    n = F.count("*").over(Window.partitionBy("code", F.year("statDate")))
    last = F.row_number().over(_year()) == 2
    return df.withColumns({c: F.when((n == 2) & last, F.col(c) - F.lag(c).over(_year())).otherwise(F.col(c)) for c in columns})


def rolling_variation(column: str, rows: int = 10) -> Column:
    """4 * population deviation / mean over the code's last `rows` periods, NULL unless all are known."""
    over = _periods().rowsBetween(-(rows - 1), 0)
    return F.when(F.count(column).over(over) == rows, div(4 * F.stddev_pop(column).over(over), F.avg(column).over(over)))


def trend_slopes(statements: DataFrame, dates: DataFrame, columns: list[str], periods: int, more_than: int, date_col: str = "pubDate") -> DataFrame:
    """(code, time, columns): at each date of `dates`, minus the slope of the known values over 0, 1, .. in the
    last `periods` report periods that ended before it, over their mean; NULL unless more than `more_than` are known."""
    ends = statements.select("statDate").distinct()
    recent = ends.join(F.broadcast(dates), F.col("statDate") < F.col("time"))  # two small tables of dates
    recent = recent.withColumn("_n", F.row_number().over(Window.partitionBy("time").orderBy(F.desc("statDate")))).where(F.col("_n") <= periods)
    rows = statements.where(F.col(date_col).isNotNull()).join(F.broadcast(recent.select("time", "statDate")), "statDate")
    place = lambda c: F.count(c).over(Window.partitionBy("code", "time").orderBy("statDate").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumns({f"_{c}": place(c).cast("double") for c in columns})
    slope = lambda c: F.when(F.count(c) > more_than, -div(F.regr_slope(F.col(c), F.when(F.col(c).isNotNull(), F.col(f"_{c}"))), F.avg(c)))
    return rows.groupBy("code", "time").agg(*[slope(c).alias(c) for c in columns])


def pcf_ratio(valuation: DataFrame, cash_ttm: str = "cash_equivalent_increase_ttm", scale: float = 1e4) -> Column:
    """Price times shares over the trailing cash increase."""
    return div(F.col("close") * F.col("paidin_capital") * scale, F.col(cash_ttm))
