"""Workload A: all descriptors, cleaned, combined into styles and scored."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import div
from ..operators.attribution import pure_factor_returns
from ..operators.evaluate import factor_ic, forward_return, icir
from ..operators.events import expanding_forecast
from ..operators.panel import densify, with_industry
from ..operators.rolling import beta_layers, ewma_deviation, layered, weighted_sum
from ..operators.xsection import clean_panel, style_composite
from ..sources.io import write_table
from ..styles import price, statements

STYLES = {
    "Size": ["LNCAP", "MIDCAP"],
    "Volatility": ["BETA", "Hist_sigma", "Daily_std", "Cumulative_range"],
    "Liquidity": ["Monthly_share_turnover", "Quarterly_share_turnover", "Annual_share_turnover", "Annualized_traded_value_ratio"],
    "Momentum": ["Short_Term_reversal", "Seasonality", "Industry_Momentum", "Relative_strength", "Hist_alpha"],
    "Quality": [
        "Market_Leverage", "Book_Leverage", "Debt_to_asset_ratio", "Variation_in_Sales", "Variation_in_Earning", "Variation_in_Cashflow", "forecast_EP_std", "ABS", "ACF",
        "ATO", "GP", "GPM", "ROA", "Total_Assets_Growth_Rate", "Issuance_growth", "Capital_expenditure_growth",
    ],
    "Value": ["Book_to_price", "Earning_to_price", "Cash_earning_to_price", "forecast_EP_mean", "Enterprise_multiple", "Longterm_Relative_strength", "Longterm_Alpha"],
    "Growth": ["Earning_Growth_Rate", "OP_Growth_Rate", "roe_mean"],
    "Sentiment": ["Pred_EP_chg", "Pred_EPS_chg"],
    "Dividend": ["Dividend_to_Price", "Forecast_Dividend_to_Price"],
}
DESCRIPTORS = [c for columns in STYLES.values() for c in columns]
AT_ONCE = 4
Keep = Callable[[str, Callable[[], DataFrame]], DataFrame]


@dataclass(frozen=True)
class Windows:
    """Window lengths in calendar steps and scales of amounts; the defaults are those of daily panels."""

    beta: tuple[int, float] = (252, 63)
    deviation: float = 42
    range: tuple[int, int, int] = (21, 12, 10)
    turnover: tuple[int, int] = (21, 12)
    traded: tuple[int, float] = (252, 63)
    reversal: tuple[int, float] = (21, 5)
    seasons: tuple[int, int] = (5, 21)
    industry: tuple[int, float, int] = (126, 21, 252)
    strength: tuple[int, float, int] = (252, 126, 11)
    longterm: tuple[int, float, int] = (750, 260, 11)
    null_share: float = 0.1
    variation: int = 10
    change: int = 63
    debt_scale: float = 1e8
    forecast_scale: float = 1e4


def slice_ic(prices: DataFrame, window: int, half_life: float, n: int = 2) -> DataFrame:
    """Spearman IC of cleaned beta and residual risk: one workload from prices to scores."""
    names = ["BETA", "Hist_sigma"]
    cleaned = clean_panel(price.market_beta(prices, window, half_life).select("code", "time", *names), prices, names)
    return factor_ic(cleaned, forward_return(prices, n), names, "spearman")


def price_windows(prices: DataFrame, calendar: DataFrame, w: Windows, index: DataFrame | None = None) -> DataFrame:
    """The price rows with `t`, all descriptors that follow from a code's own rows, and `RS`, the strength that is set against
    the industry's; by one dense panel and one pass over it for each layer of windows. The regressions run on `index`
    (`price.benchmark`)."""
    plain = ["ret", "close", "pre_close", "turnover_ratio", "circulating_market_cap", "pb_ratio", "pe_ratio", "pcf_ratio", "dv_ratio"]
    dense = densify(prices.select("code", "time", "t", *plain, F.lit(True).alias("_row")), calendar)
    dense = price.on_market(ewma_deviation(dense, "ret", w.deviation).withColumnRenamed("ewma", "Daily_std"), prices, index)
    long, half, mean = w.longterm
    window, fading, denominator = w.industry
    market, alpha, longterm = beta_layers("ret", "mkt_ret", *w.beta), price.alpha_layers(*w.strength), price.alpha_layers(long, half, mean, -1, "Longterm_Alpha")
    plain_layers = [
        price.range_layers(*w.range),
        price.turnover_layers(*w.turnover),
        price.traded_layers(*w.traded),
        price.reversal_layers(*w.reversal),
        price.season_layers(calendar, *w.seasons),
        price.strength_layers(*w.strength, null_share=w.null_share),
        price.strength_layers(long, half, mean, -1, "Longterm_Relative_strength", w.null_share),
        [{"RS": weighted_sum(F.log(1 + F.col("ret")), window, fading, null_denominator=denominator)}],
        market[:1],
    ]
    made = {"t", "circulating_market_cap", "RS", "beta", "sigma", *DESCRIPTORS}
    rows = dense
    # some at a time, and without what only they need: the JVM does not compile what has too many columns
    for k, group in enumerate((plain_layers, [market[1:]], [alpha[1:]], [longterm[1:]])):
        rows = layered(rows, *group)
        rows = rows.select([c for c in rows.columns if c in made or c in dense.columns or k < 3 and c in market[0]])
    rows = rows.where("_row")
    known = F.col("_on") & F.col("ret").isNotNull()
    rows = rows.withColumns({"BETA": F.when(known, F.col("beta")), "Hist_sigma": F.when(known, F.col("sigma"))} | price.value_columns())
    return rows.select("code", "time", "t", "circulating_market_cap", "RS", *[c for c in DESCRIPTORS if c in rows.columns])


def statement_descriptors(prices: DataFrame, calendar: DataFrame, finance: DataFrame, dates: DataFrame, w: Windows) -> DataFrame:
    """All descriptors from statements, by one alignment to the trading days."""
    records = [statements.leverage_records(finance, w.debt_scale), statements.variability_records(finance, w.variation), statements.accrual_records(finance), statements.profit_records(finance), statements.investment_records(finance, dates), statements.growth_records(finance, dates), statements.enterprise_records(finance)]
    rows = statements.aligned(records, calendar, prices, "market_cap", "pb_ratio")
    rows = rows.withColumns(statements.leverage_columns() | {"Enterprise_multiple": statements.enterprise_column(w.debt_scale)})
    return rows.select("code", "time", *[c for c in DESCRIPTORS if c in rows.columns])


def forecast_descriptors(prices: DataFrame, calendar: DataFrame, days: DataFrame, w: Windows, keep: Keep = lambda name, compute: compute()) -> list[DataFrame]:
    """Tables of the descriptors from forecasts (`events.forecast_days`)."""
    profit = expanding_forecast(days, calendar, "np").join(prices.select("code", "time", "market_cap"), ["code", "time"])
    per_cap = lambda c: div(F.col(c) / w.forecast_scale, F.col("market_cap"))
    return [
        profit.select("code", "time", per_cap("mean").alias("forecast_EP_mean"), per_cap("std").alias("forecast_EP_std")),
        statements.forecast(days.withColumn("year", F.col("year") + 2), None, calendar, "roe", "mean", "roe_mean", ahead=2),
        statements.forecast(days, None, calendar, "rd", "mean", "Forecast_Dividend_to_Price"),
        statements.sentiment(days, prices, calendar, w.change, w.forecast_scale, keep),
    ]


def descriptor_panel(prices: DataFrame, calendar: DataFrame, window: int = 12, half_life: float = 6) -> DataFrame:
    """Some price descriptors side by side, outer-joined on (code, time)."""
    parts = [price.size(prices), price.market_beta(prices, window, half_life).drop("alpha"), price.daily_std(prices, calendar, half_life), price.value_ratios(prices), price.dividend(prices)]
    return reduce(lambda a, b: a.join(b, ["code", "time"], "full_outer"), parts)


def descriptor_table(prices: DataFrame, calendar: DataFrame, industry: DataFrame, finance: DataFrame, days: DataFrame, dates: DataFrame, w: Windows = Windows(), keep: Keep = lambda name, compute: compute(), index: DataFrame | None = None) -> DataFrame:
    """(code, time) of the price rows with all DESCRIPTORS.

    Tables bucketed by code are joined without an exchange, so all the sorts of a chain of joins run in one task; AT_ONCE
    tables at a time are joined and kept, which bounds a task's memory.
    """
    windows = keep("price-windows", lambda: price_windows(prices, calendar, w, index))
    momentum = price.industry_relative(windows.select("code", "time", "RS", "circulating_market_cap"), industry, calendar, w.industry[0])
    parts = [price.size(prices), momentum, statement_descriptors(prices, calendar, finance, dates, w), *forecast_descriptors(prices, calendar, days, w, keep)]
    beside = lambda first, tables: reduce(lambda a, b: a.join(b, ["code", "time"], "left"), tables, first)
    keys = prices.select("code", "time")
    kept = [keep(f"descriptors-{k}", lambda k=k: beside(keys, parts[k : k + AT_ONCE])) for k in range(0, len(parts), AT_ONCE)]
    return beside(windows.drop("t", "RS", "circulating_market_cap"), kept).select("code", "time", *DESCRIPTORS)


def factor_returns(exposures: DataFrame, names: list[str], prices: DataFrame, industry: DataFrame) -> DataFrame:
    """Pure factor returns of the exposures (code, time, `names`) over the next trading day: the calendar's next day, on
    which a suspended code has none. Capital is weighed over all codes that have an industry on the date."""
    own = with_industry(prices.select("code", "time", "t", F.col("circulating_market_cap").alias("cap")), industry)
    ahead = prices.select("code", (F.col("t") - 1).alias("t"), F.col("ret").alias("next_ret"), F.log(1 + F.col("ret")).alias("next_log"))
    rows = own.join(exposures.select("code", "time", *names), ["code", "time"]).join(ahead, ["code", "t"], "left")
    return pure_factor_returns(rows, names, own.groupBy("time", "L1").agg(F.coalesce(F.sum("cap"), F.lit(0.0)).alias("cap")))


def build_factors(prices: DataFrame, calendar: DataFrame, industry: DataFrame, finance: DataFrame, days: DataFrame, dates: DataFrame, w: Windows = Windows(), n: int = 5, keep: Keep = lambda name, compute: compute(), index: DataFrame | None = None) -> dict[str, DataFrame]:
    """Descriptors (raw and cleaned), styles, IC and ICIR of the descriptors, and the styles' pure factor returns. With
    `index` (`price.benchmark`) betas and alphas are those on the index, else on the mean return of all codes.

    Tables that several others read go through `keep(name, compute)`, such as `load_or_compute` with a path.
    """
    raw = descriptor_table(prices, calendar, industry, finance, days, dates, w, keep, index)
    cleaned = keep("cleaned", lambda: clean_panel(raw, prices, DESCRIPTORS))
    styles = style_composite(cleaned, STYLES)
    ic = keep("ic", lambda: factor_ic(cleaned, forward_return(prices, n), DESCRIPTORS))
    return {"descriptors": raw, "cleaned": cleaned, "styles": styles, "ic": ic, "icir": icir(ic), "returns": factor_returns(styles, list(STYLES), prices, industry)}


def write_factors(built: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Writes the tables of `build_factors`, those of days by year."""
    for name, df in built.items():
        write_table(df, f"{folder}/{name}", form, by_year_of="time" if "time" in df.columns else None)
