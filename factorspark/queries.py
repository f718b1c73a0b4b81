"""Registered queries of the library: each applies one operator to panels derived from the star schema.

Weekly panels use windows of a year in weeks, monthly ones in months; doubles are rounded to 6 decimals
here, not in the operators.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from .operators import calendar, evaluate, events, fundamentals, panel, rolling, training, xsection
from .plans.factors import DESCRIPTORS, STYLES as FACTOR_STYLES, Windows, descriptor_panel, descriptor_table, factor_returns, slice_ic
from .sources import adapters, io
from .styles import price, statements
from .styles.price import benchmark

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
START, END = dt.date(1997, 3, 5), dt.date(2001, 6, 15)
W, H = 52, 13


#: Added before rounding, here and in the SQL: exact halves, which engines round either way, all go up.
NUDGE = 3e-10


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + NUDGE, 6) + F.lit(0.0) for c, kind in df.dtypes if kind == "double"})


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = lambda spark, sf_dir: rounded(fn(spark, sf_dir))
    return fn


def _bucket_session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings in which joins on (code, time) stay in a bucket of code, the order in buckets
    counts, and stages of many columns are not put into one method, which the JVM would interpret beyond 8000 bytes."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    own.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
    return own


class Tables:
    """The derived tables of a folder, each written once per application and state of the folder, and bucketed by code,
    so that the fact table is read once for each of them and what works per code needs no exchange."""

    def __init__(self, spark: SparkSession, sf_dir: str, unit: str = "week"):
        self.spark, self.sf, self.unit = _bucket_session(spark), sf_dir, unit
        self.stages = io.Stages(self.spark, [f"{sf_dir}/{t}.parquet" for t in ("lineitem", "supplier", "nation", "region")])

    def keep(self, name: str, compute: Callable[[], DataFrame], by: str | None = "code", then: tuple[str, ...] = ()) -> DataFrame:
        return self.stages.keep(name, compute, by, then)

    def stage_all(self) -> None:
        """Writes the tables that most queries read."""
        _ = self.p, self.cal, self.industry_panel, self.filings, self.finance, self.days, self.dates

    @cached_property
    def p(self) -> DataFrame:
        return self.keep(f"panel-{self.unit}", lambda: adapters.panel(self.spark, self.sf, self.unit), then=("t",))

    @cached_property
    def cal(self) -> DataFrame:
        return self.keep(f"calendar-{self.unit}", lambda: calendar.ordinals(self.p), None)

    @cached_property
    def index(self) -> DataFrame:
        return self.keep(f"index-{self.unit}", lambda: adapters.index_prices(self.spark, self.sf, self.unit), None)

    @cached_property
    def industry(self) -> DataFrame:
        return adapters.industry(self.spark, self.sf)

    @cached_property
    def industry_panel(self) -> DataFrame:
        return self.keep(f"industry-{self.unit}", lambda: adapters.industry_panel(self.spark, self.sf, self.p), then=("time",))

    @cached_property
    def filings(self) -> DataFrame:
        return self.keep("filings", lambda: adapters.filings(self.spark, self.sf), then=("statDate",))

    @cached_property
    def finance(self) -> DataFrame:
        return self.keep("finance", lambda: adapters.finance(self.filings), then=("statDate",))

    @cached_property
    def reports(self) -> DataFrame:
        return adapters.reports(self.spark, self.sf)

    @cached_property
    def days(self) -> DataFrame:
        return self.keep("forecast-days", lambda: events.forecast_days(self.reports, ["np", "rd", "roe"]), then=("year", "time"))

    @cached_property
    def dates(self) -> DataFrame:
        return self.keep(f"rebalance-{self.unit}", lambda: calendar.rebalance_of(self.cal), None)


def style(name: str, fn: Callable[[Tables], DataFrame], unit: str = "week") -> None:
    QUERIES[name] = lambda spark, sf_dir: rounded(fn(Tables(spark, sf_dir, unit)))


# calendar
style("calendar_ordinals", lambda x: x.cal)
style("window_resolve", lambda x: calendar.resolve_window(x.cal, end=END, count=30).unionByName(calendar.resolve_window(x.cal, start=START, count=10)).unionByName(calendar.resolve_window(x.cal, end=dt.date(1995, 2, 1), count=30)))
style("trading_days", lambda x: calendar.trading_days(x.cal, START, END))
style("trade_day_shift", lambda x: calendar.shift_days(x.cal, x.cal, 5))
style("period_ends", lambda x: panel.select_panel(x.finance, start=dt.date(1990, 1, 1), time="statDate").select("statDate").distinct().join(calendar.period_ends(x.spark, dt.date(1994, 5, 5), dt.date(2002, 2, 2)), "statDate", "full_outer"))
style("disclosure_deadline", lambda x: x.finance.select("statDate", calendar.report_deadline().alias("deadline")).distinct())
style("on_time_filings", lambda x: calendar.on_time(x.finance).select("code", "statDate", "pubDate"))
style("rebalance_dates", lambda x: x.dates)

# selection, completeness, alignment
style("select_panel", lambda x: panel.select_panel(x.p, x.industry.where("L1 <> 'ASIA'"), START, END, ["close"]))
style("dedupe_last", lambda x: x.finance.select("code", "statDate", "pubDate", "operating_revenue"))
style("completeness_filter", lambda x: panel.complete_codes(adapters.statements(x.filings), calendar.period_ends(x.spark, dt.date(1996, 1, 1), dt.date(1998, 12, 31))))
style("asof_align", lambda x: panel.asof_align(x.finance, x.cal, "pubDate", ["total_assets", "net_profit"], "statDate"))
style("backfill_calendar", lambda x: panel.backfill(x.p.withColumn("band", F.when(F.col("turnover_ratio") > 100, "high").otherwise("low")), x.cal, "band", "other"))
style("statement_join", lambda x: fundamentals.combine_statements(*adapters.statements(x.filings)).select("code", "statDate", "net_profit", "total_assets", "fix_intan_other_asset_acqui_cash", "np_parent_company_owners"))
style("select_statements", lambda x: panel.select_statements(x.finance, end=END, count=9, fields=["total_assets"]))
style("select_reports", lambda x: panel.select_reports(x.reports, [1998, 1999], start=START, end=END).groupBy("code", "year").agg(F.count("*").alias("n"), F.max("np").alias("np")))
style("code_prefix", lambda x: panel.with_prefix(x.p.select("code", "time", "close"), ["1", "3", "6"]))
style("listed_before", lambda x: panel.listed_before(adapters.listing(x.spark, x.sf), dt.date(1995, 1, 20)))
style("industry_month_start", lambda x: panel.with_industry(x.p.select("code", "time", "close"), x.industry_panel, ("industry", "L1"), month_start=True, calendar=x.cal))
style("industry_map", lambda x: panel.map_category(x.industry, x.industry.where("industry not like 'A%'").select("industry", "L1").distinct(), "industry", "L1").select("code", "industry", "L1"))
style("fill_limited", lambda x: panel.densify(x.p.select("code", "time", "t", "close"), x.cal).select("code", "time", panel.fill_limited("close", 2).alias("close")))

# cross-section
style("winsorize_quantile", lambda x: xsection.winsorize(x.p.select("code", "time", "ret", "market_cap"), ["ret", "market_cap"], "time", 0.05, 0.95))
style("median_fill", lambda x: xsection.fill_median(x.p.select("code", "time", "ret"), ["ret"]))
style("zscore", lambda x: xsection.zscore(x.p.select("code", "time", "close", "turnover_ratio"), ["close", "turnover_ratio"]))
style("clean_panel", lambda x: xsection.clean_panel(x.p.select("code", "time", "ret", "dv_ratio"), x.p, ["ret", "dv_ratio"], 0.05, 0.95))
style("mad_winsorize", lambda x: xsection.mad_winsorize(x.p.select("code", "time", "turnover_ratio"), "turnover_ratio", "time", 2.0))
style("mad_standardize", lambda x: xsection.mad_standardize(x.p.select("code", "time", "ret", "turnover_ratio"), ["ret", "turnover_ratio"], "time", 2.0))
style("size_lncap", lambda x: price.size(x.p).select("code", "time", "LNCAP"))
style("size_midcap", lambda x: price.size(x.p).select("code", "time", "MIDCAP"))
style("group_relative", lambda x: xsection.group_relative(x.p.join(x.industry, "code"), "ret", F.sqrt("circulating_market_cap"), ["time", "L1"]).select("code", "time", "relative"))
style("industry_dummies", lambda x: xsection.dummies(x.industry.select("code", "L1"), "L1", ["AFRICA", "AMERICA", "ASIA", "EUROPE"]).drop("L1").withColumnsRenamed({f"L1_{v}": v.lower() for v in ("AFRICA", "AMERICA", "ASIA", "EUROPE")}))
style("cap_shares", lambda x: xsection.cap_shares(x.p.join(x.industry, "code"), "market_cap"))
STYLES = {"worth": ["close", "market_cap"], "trade": ["turnover_ratio", "dv_ratio", "ret"]}
style("style_composite", lambda x: xsection.style_composite(x.p, STYLES), "month")

# rolling descriptors
style("rolling_beta", lambda x: price.market_beta(x.p, W, H).select("code", "time", "BETA"))
style("hist_sigma", lambda x: price.market_beta(x.p, W, H).select("code", "time", "Hist_sigma"))
style("daily_std", lambda x: price.daily_std(x.p, x.cal, 10))
style("cumulative_range", lambda x: price.cumulative_range(x.p, x.cal, 4, 13, 2))
style("turnover_monthly", lambda x: price.turnover(x.p, x.cal, 3, 12).select("code", "time", "Monthly_share_turnover").dropna())
style("turnover_quarterly", lambda x: price.turnover(x.p, x.cal, 3, 12).select("code", "time", "Quarterly_share_turnover").dropna())
style("turnover_annual", lambda x: price.turnover(x.p, x.cal, 3, 12).select("code", "time", "Annual_share_turnover").dropna())
style("traded_value_ratio", lambda x: price.traded_value_ratio(x.p, x.cal, W, H))
style("short_term_reversal", lambda x: price.reversal(x.p, x.cal, 6, 3), "month")
style("seasonality", lambda x: price.seasonality(x.p, x.cal, 3, 5))
style("industry_momentum", lambda x: price.industry_momentum(x.p, x.p, x.industry, x.cal, 26, 13, 52))
style("industry_momentum_varying", lambda x: price.industry_momentum(x.p, x.p, x.industry_panel, x.cal, 26, 13, 52))
style("relative_strength", lambda x: price.relative_strength(x.p, x.cal, 12, 6, 3), "month")
style("hist_alpha", lambda x: price.smoothed_alpha(x.p, x.cal, 12, 6, 3), "month")
style("longterm_strength", lambda x: price.relative_strength(x.p, x.cal, 36, 12, 3, -1, "Longterm_Relative_strength"), "month")
style("beta_on_index", lambda x: price.market_beta(x.p, W, H, index=benchmark(x.index)).select("code", "time", "BETA", "Hist_sigma"))
style("alpha_on_index", lambda x: price.smoothed_alpha(x.p, x.cal, 12, 6, 3, index=benchmark(x.index)), "month")
style("longterm_alpha", lambda x: price.smoothed_alpha(x.p, x.cal, 36, 12, 3, -1, "Longterm_Alpha"), "month")
style("panel_rolling_apply", lambda x: rolling.panel_rolling_apply(x.p.select("code", "time", "turnover_ratio"), "time", "code", "turnover_ratio", 4, lambda s: 4 * s.std(ddof=0) / s.mean()), "month")

# statements and forecasts
style("ttm", lambda x: fundamentals.trailing(fundamentals.combine_statements(*adapters.statements(x.filings))).select("code", "statDate", "operating_revenue_ttm", "net_profit_ttm", "total_operating_cost_ttm", "np_parent_company_owners_ttm", "cash_equivalent_increase_ttm"))
style("pcf_ratio", lambda x: x.finance.join(x.p.select("code", "time", "close"), "code").where("time > statDate and time <= date_add(statDate, 7)").select("code", "time", fundamentals.pcf_ratio(None, scale=1.0).alias("pcf")))
style("leverage", lambda x: statements.leverage(x.finance, x.p, x.cal, 1.0))
style("earnings_variability", lambda x: statements.earnings_variability(x.finance, x.cal, 6))
style("accruals", lambda x: statements.accruals(x.finance, x.cal))
style("profitability", lambda x: statements.profitability(x.finance, x.cal))
style("investment_quality", lambda x: statements.investment_quality(x.finance, x.dates, x.cal))
style("growth_slopes", lambda x: statements.growth(x.finance, x.dates, x.cal))
style("enterprise_multiple", lambda x: statements.enterprise_multiple(x.finance, x.p, x.cal, 1.0))
style("value_ratios", lambda x: price.value_ratios(x.p))
style("dividend", lambda x: price.dividend(x.p))
style("forecast_dividend", lambda x: statements.forecast(x.days, None, x.cal, "rd", "mean", "Forecast_Dividend_to_Price"))
style("forecast_ep_mean", lambda x: statements.forecast(x.days, x.p, x.cal, "np", "mean", "forecast_EP_mean"))
style("forecast_ep_std", lambda x: statements.forecast(x.days, x.p, x.cal, "np", "std", "forecast_EP_std"))
style("forecast_roe", lambda x: statements.forecast(x.days.withColumn("year", F.col("year") + 2), None, x.cal, "roe", "mean", "roe_mean", ahead=2))
style("sentiment_change", lambda x: statements.sentiment(x.days, x.p, x.cal, 13, 1.0, x.keep))

# evaluation
style("forward_return", lambda x: evaluate.forward_return(x.p, 4).select("code", "time", "forward"))
style("forward_return_window", lambda x: evaluate.forward_return(x.p, 4, calendar=x.cal, start=START, end=END).select("code", "time", "forward"))
style("labels", lambda x: evaluate.labels(x.p, 3).select("code", "time", "close_future", "return_ratio", "class_label"))
COLUMNS = ["turnover_ratio", "dv_ratio", "ret"]
for _kind in ("pearson", "spearman", "kendall"):
    style(f"ic_{_kind}", lambda x, kind=_kind: evaluate.factor_ic(x.p, evaluate.forward_return(x.p, 2), COLUMNS, kind))
style("icir", lambda x: evaluate.icir(slice_ic(x.p, W, H)))
style("ic_weighted_composite", lambda x: xsection.ic_weighted_composite(x.p, evaluate.factor_ic(x.p, evaluate.forward_return(x.p, 2), COLUMNS, "pearson").join(F.broadcast(x.cal), "time"), COLUMNS, 12, 6), "month")
style("cumulative_returns", lambda x: evaluate.cumulative(x.p.select(F.col("code").alias("factor"), "time", "t", "ret").where("ret is not null"), "ret", 30))


def _attribution(x: Tables) -> DataFrame:
    columns = ["turnover_ratio", "dv_ratio"]
    return factor_returns(xsection.zscore(x.p.select("code", "time", *columns), columns), columns, x.p, x.industry)


style("pure_factor_returns", _attribution, "month")

# training
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
style("walk_forward_windows", lambda x: training.walk_forward(x.cal, 40, 5).unionByName(training.walk_forward(x.cal, 100, 50, 5).withColumn("window_id", F.col("window_id") + 1000)))


def _windowed(x: Tables) -> DataFrame:
    spans = training.walk_forward(x.cal, 40, 20, 5)
    rows = evaluate.labels(x.p, 3).join(F.broadcast(spans), (F.col("time") >= F.col("start")) & (F.col("time") <= F.col("end")))
    return training.time_split(rows, ["window_id"])


style("time_split", lambda x: _windowed(x).groupBy("window_id", "is_train").agg(F.count("*").alias("n"), F.min("time").alias("first"), F.max("time").alias("last")), "month")
style("training_table", lambda x: training.training_table(x.p, ["turnover_ratio", "dv_ratio"], x.industry, REGIONS[:2], evaluate.labels(x.p, 3)), "month")
style("training_table_varying", lambda x: training.training_table(x.p, ["turnover_ratio", "dv_ratio"], x.industry_panel, REGIONS[:2], evaluate.labels(x.p, 3)), "month")
style("regression_metrics", lambda x: training.regression_metrics(_windowed(x).withColumn("score", F.col("dv_ratio") / 100), "return_ratio", "score", ["window_id"]), "month")
style("class_metrics", lambda x: training.class_metrics(_windowed(x).withColumn("score", F.col("dv_ratio") / 10), "class_label", "score", ["window_id"]), "month")
style("portfolio_rank", lambda x: training.rank_portfolio(x.p.withColumn("score", F.col("turnover_ratio")), top=10).select("code", "time", "score", "rank"))


@query
def label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class metrics of text length as a score of quality, per language."""
    docs, marks = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.join(marks, "doc_id").select("lang", "quality", (F.col("n_chars") / 1000.0).alias("score"))
    return training.class_metrics(rows, "quality", "score", ["lang"])


@query
def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily z-scores of 1 + mean event value per user."""
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("user_id").alias("code"), F.col("ts").cast("date").alias("time")).agg((1 + F.avg("value")).alias("close"))
    return xsection.zscore(ev, ["close"])


TRAINED = ["turnover_ratio", "dv_ratio", "ret"]


def _in_time(df: DataFrame) -> DataFrame:
    """Rows in order of time, so that a window's dates are a part of the files."""
    return df.repartitionByRange("time").sortWithinPartitions("time")


def _run(x: Tables, kind: str) -> dict[str, DataFrame]:
    """Every walk-forward window of three columns, trained and scored."""
    rows = x.keep("training-rows-3", lambda: _in_time(evaluate.labels(x.p, 3)), None)
    return training.walk_forward_run(rows, training.walk_forward(x.cal, 40, 20, 5), TRAINED, kind, x.stages.folder(f"windows-40-20-5-10-{kind}"), rounds=10, rate=0.1)


RANKED = ["window_id", "code", "time", "return_ratio", "class_label", "score", "rank"]
style("boosted_regression", lambda x: _run(x, "regression")["portfolio"].select(RANKED), "month")
style("boosted_classifier", lambda x: _run(x, "classifier")["portfolio"].select(RANKED), "month")
style("feature_importance", lambda x: _run(x, "regression")["importance"], "month")
style("walk_forward_regression", lambda x: _run(x, "regression")["metrics"].drop("importances"), "month")
style("walk_forward_classifier", lambda x: _run(x, "classifier")["metrics"].drop("importances"), "month")

# workload A whole
WEEKLY = Windows(beta=(W, H), deviation=10, range=(4, 13, 2), turnover=(3, 12), traded=(W, H), reversal=(6, 3), seasons=(3, 5), industry=(26, 13, 52), strength=(26, 13, 3), longterm=(104, 52, 3), null_share=0.3, variation=6, change=13, debt_scale=1.0, forecast_scale=1.0)


def _kept(x: Tables, name: str, compute: Callable[[], DataFrame], by: str | None = "code") -> DataFrame:
    return x.stages.keep(f"factors-{WEEKLY}-{name}", compute, by, ("time",) if by == "code" else (), dealt=by == "time")


def _descriptors(x: Tables) -> DataFrame:
    return descriptor_table(x.p, x.cal, x.industry_panel, x.finance, x.days, x.dates, WEEKLY, keep=lambda name, compute: _kept(x, name, compute))


def _cleaned(x: Tables) -> DataFrame:
    """Bucketed by date, as all that follows works on dates."""
    return _kept(x, "cleaned", lambda: xsection.clean_panel(_descriptors(x), x.p, DESCRIPTORS), "time")


def _ic(x: Tables) -> DataFrame:
    return _kept(x, "ic", lambda: evaluate.factor_ic(_cleaned(x), evaluate.forward_return(x.p, 5), DESCRIPTORS), None)


def _styles(x: Tables) -> DataFrame:
    return xsection.style_composite(_cleaned(x), FACTOR_STYLES)


# each works out what it needs of `build_factors`, and no more
style("all_descriptors", _descriptors)
style("all_styles", _styles)
style("all_factor_ic", _ic)
style("all_icir", lambda x: evaluate.icir(_ic(x)))
style("style_returns", lambda x: factor_returns(_styles(x), list(FACTOR_STYLES), x.p, x.industry_panel))


def _strategy(x: Tables, kind: str) -> dict[str, DataFrame]:
    """All descriptors with the industries of the day, trained and scored in windows of 150 weeks, 60 weeks apart; test
    days come so late that no label of the training rows reaches beyond them."""
    inputs = [*DESCRIPTORS, *[f"L1_{r}" for r in REGIONS], "country"]
    table = lambda: training.training_table(_descriptors(x), DESCRIPTORS, x.industry_panel, REGIONS, evaluate.labels(x.p, 5))
    rows = x.stages.keep(f"training-rows-5-{WEEKLY}", table, "time", dealt=True)  # in order of time, worked out once
    return training.walk_forward_run(rows, training.walk_forward(x.cal, 150, 60, 5), inputs, kind, x.stages.folder(f"strategy-150-60-5-10-15-{kind}-{WEEKLY}"), rounds=10, rate=0.1, leaves=15)


style("strategy_portfolio", lambda x: _strategy(x, "classifier")["portfolio"].select(RANKED))
style("strategy_metrics", lambda x: _strategy(x, "classifier")["metrics"].drop("importances"))
style("strategy_importance", lambda x: _strategy(x, "classifier")["importance"])
style("strategy_regression", lambda x: _strategy(x, "regression")["metrics"].drop("importances"))
EIGHT = ["LNCAP", "MIDCAP", "BETA", "Hist_sigma", "Daily_std", "Book_to_price", "Earning_to_price", "Dividend_to_Price"]
style("descriptor_panel", lambda x: descriptor_panel(x.p, x.cal).select("code", "time", *EIGHT), "month")
