"""Descriptors from statements and forecasts: quality, growth, sentiment, and the statement part of value.

A descriptor has two steps: its records (`*_records`), dated by the deadline of their report period, and the day's value
of what was last known. `aligned` carries the records of any number of descriptors over the trading days at once.
`finance` has the statements' columns and their trailing sums (`fundamentals.trailing`).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import div
from ..operators.calendar import on_time
from ..operators.events import decayed_changes, expanding_forecast
from ..operators.fundamentals import capital_expenditure, rolling_variation, second_half, trend_slopes
from ..operators.panel import asof_align_all, densify
from ..operators.xsection import mad_standardize

Records = tuple[DataFrame, str, list[str], str]  # table, date, columns, order of records of one date


def aligned(records: list[Records], calendar: DataFrame, valuation: DataFrame | None = None, *columns: str) -> DataFrame:
    """(code, time) and the records' columns as last known on each trading day; with a valuation, on its rows."""
    out = asof_align_all(records, calendar)
    return out if valuation is None else out.join(valuation.select("code", "time", *columns), ["code", "time"])


def leverage_records(finance: DataFrame, scale: float = 1e8) -> Records:
    """Long-term debt and preferred equity (unknown: 0), assets and liabilities of June and December statements."""
    half = on_time(finance.where(F.month("statDate").isin(6, 12)))
    known = lambda c: F.coalesce(F.col(c) / scale, F.lit(0.0))
    half = half.withColumns({"LD": known("total_non_current_liability"), "PE": known("oth_eqt_tools_p_shr"), "debt": F.col("total_liability"), "assets": F.col("total_assets")})
    return half, "pubDate", ["LD", "PE", "debt", "assets"], "statDate"


def leverage_columns() -> dict[str, Column]:
    cap, debt = F.col("market_cap"), F.col("PE") + F.col("LD")
    return {"Market_Leverage": div(cap + debt, cap), "Book_Leverage": div(div("market_cap", "pb_ratio") + debt, cap), "Debt_to_asset_ratio": div("debt", "assets")}


def leverage(finance: DataFrame, valuation: DataFrame, calendar: DataFrame, scale: float = 1e8) -> DataFrame:
    """Market and book leverage and debt to assets, from June and December statements."""
    rows = aligned([leverage_records(finance, scale)], calendar, valuation, "market_cap", "pb_ratio")
    return rows.select("code", "time", *[c.alias(n) for n, c in leverage_columns().items()])


def variability_records(finance: DataFrame, rows: int = 10) -> Records:
    """Variation of trailing sales, earnings and cash over `rows` half-years, standardized per deadline."""
    half = on_time(finance.where(F.month("statDate").isin(6, 12)))
    names = {"Variation_in_Sales": "operating_revenue_ttm", "Variation_in_Earning": "net_profit_ttm", "Variation_in_Cashflow": "cash_equivalent_increase_ttm"}
    varied = half.select("code", "statDate", "pubDate", *[rolling_variation(c, rows).alias(n) for n, c in names.items()])
    varied = varied.where(" or ".join(f"{n} is not null" for n in names))
    return mad_standardize(varied, list(names), "pubDate"), "pubDate", list(names), "statDate"


def earnings_variability(finance: DataFrame, calendar: DataFrame, rows: int = 10) -> DataFrame:
    return aligned([variability_records(finance, rows)], calendar)


def forecast(days: DataFrame, valuation: DataFrame | None, calendar: DataFrame, value: str, stat: str, name: str, scale: float = 1.0, ahead: int = 0) -> DataFrame:
    """Expanding mean or std of the forecasts (`events.forecast_days`) over `scale`, per market cap if `valuation` is given."""
    out = expanding_forecast(days, calendar, value, ahead).withColumn("_v", F.col(stat) / scale)
    if valuation is None:
        return out.select("code", "time", F.col("_v").alias(name))
    return out.join(valuation.select("code", "time", "market_cap"), ["code", "time"]).select("code", "time", div("_v", "market_cap").alias(name))


def accrual_records(finance: DataFrame) -> Records:
    """ABS from the change in net operating assets, ACF from cash flows; half-years, flows of the own half."""
    worn = ["fixed_assets_depreciation", "intangible_assets_amortization", "defferred_expense_amortization"]
    half = on_time(finance.where(F.quarter("statDate").isin(2, 4)))
    flows = second_half(half, [*worn, "net_operate_cash_flow", "net_invest_cash_flow", "net_profit"])
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    debt = z("non_current_liability_in_one_year") + z("total_non_current_liability") + z("shortterm_loan")
    worn_off = z(worn[0]) + z(worn[1]) + z(worn[2])
    rows = flows.withColumn("NOA", (z("total_assets") - z("cash_and_equivalents_at_end")) - (z("total_liability") - debt))
    change = F.col("NOA") - F.lag("NOA").over(Window.partitionBy("code").orderBy("statDate"))
    cash = z("net_profit") - (z("net_operate_cash_flow") + z("net_invest_cash_flow")) + worn_off
    rows = rows.withColumn("ABS", -div(change - worn_off, "total_assets")).withColumn("ACF", -div(cash, "total_assets"))
    return rows, "pubDate", ["ABS", "ACF"], "statDate"


def accruals(finance: DataFrame, calendar: DataFrame) -> DataFrame:
    return aligned([accrual_records(finance)], calendar)


def profit_records(finance: DataFrame) -> Records:
    """Turnover, gross profit, margin and return on assets; filings of one deadline are averaged."""
    sales, cost, assets = F.col("total_operating_revenue_ttm"), F.col("total_operating_cost_ttm"), F.col("total_assets")
    rows = on_time(finance).select("code", "pubDate", div(sales, assets).alias("ATO"), div(sales - cost, assets).alias("GP"), div(sales - cost, sales).alias("GPM"), div(F.col("np_parent_company_owners_ttm"), assets).alias("ROA"))
    names = ["ATO", "GP", "GPM", "ROA"]
    return rows.groupBy("code", "pubDate").agg(*[F.avg(n).alias(n) for n in names]), "pubDate", names, "pubDate"


def profitability(finance: DataFrame, calendar: DataFrame) -> DataFrame:
    return aligned([profit_records(finance)], calendar)


def investment_records(finance: DataFrame, dates: DataFrame, periods: int = 21, more_than: int = 6) -> Records:
    """Negative growth of assets, shares and, from December statements, capital expenditure; unknown is 0."""
    rows = on_time(finance)
    grown = trend_slopes(rows, dates, ["total_assets", "paidin_capital"], periods, more_than)
    yearly = rows.where(F.month("statDate") == 12).withColumn("spent", capital_expenditure())
    spent = trend_slopes(yearly, dates, ["spent"], 5, 2)
    names = {"total_assets": "Total_Assets_Growth_Rate", "paidin_capital": "Issuance_growth", "spent": "Capital_expenditure_growth"}
    both = grown.join(spent, ["code", "time"], "full_outer").select("code", F.col("time").alias("pubDate"), *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in names.items()])
    return both, "pubDate", list(names.values()), "pubDate"


def investment_quality(finance: DataFrame, dates: DataFrame, calendar: DataFrame, periods: int = 21, more_than: int = 6) -> DataFrame:
    return aligned([investment_records(finance, dates, periods, more_than)], calendar)


def growth_records(finance: DataFrame, dates: DataFrame, periods: int = 21, more_than: int = 8) -> Records:
    """Negative trend of trailing earnings and revenue."""
    names = {"np_parent_company_owners_ttm": "Earning_Growth_Rate", "operating_revenue_ttm": "OP_Growth_Rate"}
    slopes = trend_slopes(on_time(finance), dates, list(names), periods, more_than).withColumnsRenamed(names).withColumnRenamed("time", "pubDate")
    return slopes, "pubDate", list(names.values()), "pubDate"


def growth(finance: DataFrame, dates: DataFrame, calendar: DataFrame, periods: int = 21, more_than: int = 8) -> DataFrame:
    return aligned([growth_records(finance, dates, periods, more_than)], calendar)


def enterprise_records(finance: DataFrame) -> Records:
    rows = on_time(finance).withColumn("ebit", F.col("operating_revenue_ttm") - F.col("operating_cost_ttm"))
    return rows, "pubDate", ["ebit"], "statDate"


def enterprise_column(scale: float = 1e8) -> Column:
    return div(div("ebit", "market_cap"), F.lit(scale))


def enterprise_multiple(finance: DataFrame, valuation: DataFrame, calendar: DataFrame, scale: float = 1e8) -> DataFrame:
    """Trailing revenue less cost per market cap."""
    rows = aligned([enterprise_records(finance)], calendar, valuation, "market_cap")
    return rows.select("code", "time", enterprise_column(scale).alias("Enterprise_multiple"))


def sentiment(days: DataFrame, valuation: DataFrame, calendar: DataFrame, n: int = 63, scale: float = 1e4, keep: Callable[[str, Callable[[], DataFrame]], DataFrame] = lambda name, compute: compute()) -> DataFrame:
    """Decayed changes of the mean forecast, per market cap and as it is. The daily means, which are read three times, go
    through `keep(name, compute)`."""
    mean = forecast(days, None, calendar, "np", "mean", "m", scale).join(valuation.select("code", "time", "market_cap"), ["code", "time"], "left")
    both = keep(f"mean-forecasts-{scale}", lambda: mean.select("code", "time", div("m", "market_cap").alias("ep"), F.col("m").alias("eps")).join(F.broadcast(calendar), "time"))
    out = decayed_changes(densify(both, calendar), {"Pred_EP_chg": "ep", "Pred_EPS_chg": "eps"}, n)
    return out.where("Pred_EP_chg is not null or Pred_EPS_chg is not null").select("code", "time", "Pred_EP_chg", "Pred_EPS_chg")
