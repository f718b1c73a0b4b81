"""Canonical tables derived from the star schema (suppliers as stocks).

`panel`: prices and valuations per supplier and week or month. `income`, `balance`, `cashflow`: statements per
supplier and quarter, and `finance`, the three joined. `reports`: analyst forecasts, one per line item. All are plain
aggregations of `lineitem`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import div
from ..operators.calendar import ordinals
from ..operators.fundamentals import combine_statements, trailing
from . import schemas


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sums() -> list[Column]:
    """Sums over line items: price e, price times discount d and tax x, quantity n, quantity times discount nd and tax nx,
    and discount _d. They are sums of whole cents and percents, so that their order does not matter."""
    whole = lambda c: F.round(F.col(c) * 100).cast("long")
    e, d, x, n = whole("l_extendedprice"), whole("l_discount"), whole("l_tax"), F.col("l_quantity").cast("long")
    terms = {"e": (e, 100), "d": (e * d, 10_000), "x": (e * x, 10_000), "n": (n, 1), "nd": (n * d, 100), "nx": (n * x, 100), "_d": (d, 100)}
    return [(F.sum(term).cast("double") / F.lit(float(unit))).alias(name) for name, (term, unit) in terms.items()]


def panel(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """code, time, t, open, close, pre_close, ret and valuation columns."""
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("code"), F.date_trunc(unit, "l_shipdate").cast("date").alias("time"))
    rows = rows.agg(F.min(F.col("l_extendedprice") / F.col("l_quantity")).alias("open"), F.count("*").alias("_k"), *_sums())
    rows = rows.select(
        "code",
        "time",
        (F.col("e") / F.col("n")).alias("close"),
        "open",
        F.col("e").alias("market_cap"),
        (F.col("e") - F.col("d")).alias("circulating_market_cap"),
        F.col("n").alias("turnover_ratio"),
        F.round(div("e", "x"), 6).alias("pb_ratio"),
        F.round(div("e", "d"), 6).alias("pe_ratio"),
        div("e", F.round(F.col("nd") - F.col("nx"), 6)).alias("pcf_ratio"),
        F.round(100 * F.col("_d") / F.col("_k"), 6).alias("dv_ratio"),
    )
    rows = rows.join(F.broadcast(ordinals(rows)), "time")  # one row per trading day
    before = F.lag("close").over(Window.partitionBy("code").orderBy("t"))
    return rows.withColumn("pre_close", before).withColumn("ret", F.col("close") / F.col("pre_close") - 1)


def index_prices(spark: SparkSession, sf_dir: str, unit: str = "week") -> DataFrame:
    """code, time, close, pre_close of one index: the mean price of all that was sold in a period, in four decimals."""
    rows = _table(spark, sf_dir, "lineitem").groupBy(F.date_trunc(unit, "l_shipdate").cast("date").alias("time")).agg(*_sums())
    rows = rows.select(F.lit("ALL").alias("code"), "time", F.round(F.col("e") / F.col("n"), 4).alias("close"))
    return rows.withColumn("pre_close", F.lag("close").over(Window.partitionBy("code").orderBy("time")))  # a row per period


def industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code, industry, L1: the supplier's nation and region."""
    nation = _table(spark, sf_dir, "nation").join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    supplier = _table(spark, sf_dir, "supplier")
    return supplier.join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("code"), F.col("n_name").alias("industry"), F.col("r_name").alias("L1"))


def industry_panel(spark: SparkSession, sf_dir: str, panel: DataFrame) -> DataFrame:
    """code, time, industry, L1 that vary in time: the nation some places on from the supplier's, a place a year."""
    nation = _table(spark, sf_dir, "nation").join(F.broadcast(_table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    nation = nation.select(F.col("n_nationkey").alias("_key"), F.col("n_name").alias("industry"), F.col("r_name").alias("L1"))
    own = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("code"), F.col("s_nationkey").alias("_own"))
    rows = panel.select("code", "time").join(own, "code").withColumn("_key", F.pmod(F.col("_own") + F.year("time"), F.lit(25)))
    return rows.join(F.broadcast(nation), "_key").select("code", "time", "industry", "L1")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """code and list_date, the day of the first line item."""
    return _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("code")).agg(F.min("l_shipdate").cast("date").alias("list_date"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw statements per supplier and quarter: a few periods missing, a few filed twice."""
    q = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("code"), F.date_trunc("quarter", "l_shipdate").cast("date").alias("q"))
    q = q.agg(*_sums())
    q = q.withColumn("k", F.year("q") * 4 + F.quarter("q"))
    year = Window.partitionBy("code", F.year("q")).orderBy("q")
    ever = Window.partitionBy("code").orderBy("q")
    ytd, total = (lambda c: F.sum(c).over(year)), (lambda c: F.sum(c).over(ever))
    half = F.quarter("q").isin(2, 4)
    out = q.select(
        "code",
        "k",
        F.last_day(F.add_months("q", 2)).alias("statDate"),
        ytd("e").alias("operating_revenue"),
        ytd(F.col("e") + F.col("x")).alias("total_operating_revenue"),
        ytd(F.col("e") - F.col("d")).alias("operating_cost"),
        ytd(F.col("e") - F.col("d") + F.col("x")).alias("total_operating_cost"),
        ytd("d").alias("compr_inc_attr_p"),
        F.when(F.col("k") % 5 != 0, ytd("x")).alias("oth_compr_income"),
        F.when(half, ytd("d")).alias("net_profit"),
        ytd("n").alias("net_operate_cash_flow"),
        ytd(-F.col("x")).alias("net_invest_cash_flow"),
        ytd(F.col("n") * 2).alias("fix_intan_other_asset_acqui_cash"),
        ytd(F.col("x") * 0.06).alias("fixed_assets_depreciation"),
        ytd(F.col("x") * 0.03).alias("intangible_assets_amortization"),
        ytd(F.col("x") * 0.01).alias("defferred_expense_amortization"),
        F.col("n").alias("cash_equivalent_increase"),
        total("e").alias("total_assets"),
        total((F.col("e") - F.col("d")) * 0.6).alias("total_liability"),
        total("x").alias("total_non_current_liability"),
        F.when(F.col("k") % 7 != 0, total(F.col("x") * 0.25)).alias("non_current_liability_in_one_year"),
        total(F.col("d") * 0.5).alias("shortterm_loan"),
        F.when(F.col("code") % 2 != 0, total(F.col("d") * 0.1)).alias("longterm_account_payable"),
        total(F.col("x") * 0.2).alias("specific_account_payable"),
        F.when(F.col("code") % 3 == 0, total(F.col("n") * 20)).alias("oth_eqt_tools_p_shr"),
        total("n").alias("cash_and_equivalents_at_end"),
        total(F.col("n") * 3).alias("paidin_capital"),
    )
    out = out.where((F.col("code") * 31 + F.col("k")) % 97 != 0).withColumn("pubDate", F.date_add("statDate", (20 + (7 * F.col("code") + 11 * F.col("k")) % 90).cast("int")))
    again = out.where((F.col("code") + F.col("k")) % 13 == 0).withColumn("pubDate", F.date_add("pubDate", 5)).withColumn("operating_revenue", F.col("operating_revenue") * 1.01)
    return out.unionByName(again)


KEYS = ("code", "k", "statDate", "pubDate")


def statements(filings: DataFrame) -> list[DataFrame]:
    """Income, balance and cash-flow statements of the filings."""
    return [filings.select(*KEYS, *[c for c in table.fieldNames() if c in filings.columns and c not in KEYS]) for table in (schemas.INCOME, schemas.BALANCE, schemas.CASHFLOW)]


def finance(filings: DataFrame) -> DataFrame:
    """The three statements joined, with their trailing sums."""
    return trailing(combine_statements(*statements(filings)))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forecasts: code, time, quarter, target year, np, rd, roe."""
    year = F.year("l_shipdate")
    return _table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("code"), F.col("l_shipdate").cast("date").alias("time"), F.concat(year, F.lit("Q"), F.quarter("l_shipdate")).alias("quarter"), year.alias("year"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("np"), F.col("l_discount").alias("rd"), F.col("l_tax").alias("roe"),
    )
