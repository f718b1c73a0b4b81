"""Descriptors from prices and valuations: size, volatility, liquidity, momentum, value, dividend.

Inputs are panels with (code, time, t); windows are counted in calendar steps. The defaults are those of
daily panels; weekly and monthly panels pass their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import by_code, div, half_life_weights, lagged_sum, row_mean
from ..operators.calendar import step_distances
from ..operators.panel import fill_limited, with_industry
from ..operators.rolling import Layers, beta_layers, decayed_sum, dense_panel, ewma_deviation, full_window, layered, sampled_lags, weighted_beta, weighted_sum, window_count
from ..operators.xsection import group_relative, mad_winsorize, regression_residual


def size(valuation: DataFrame, k: float = 5.0) -> DataFrame:
    """LNCAP, and MIDCAP: the part of its cube that it does not explain, clipped and standardized per date."""
    df = valuation.select("code", "time", F.col("circulating_market_cap").alias("cap")).withColumn("LNCAP", F.log(F.col("cap") + 1))
    df = regression_residual(df.withColumn("_cube", F.pow("LNCAP", F.lit(3.0))), "_cube", "LNCAP", F.sqrt("cap"))
    df = mad_winsorize(df, "residual", "time", k)
    over = Window.partitionBy("time")
    midcap = div(F.col("residual") - F.avg("residual").over(over), F.stddev_pop("residual").over(over))
    return df.select("code", "time", "LNCAP", midcap.alias("MIDCAP"))


def on_market(rows: DataFrame, prices: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Adds `mkt_ret`: the benchmark's return of the day, or the mean return of all codes, and `_on`, whether the day has one."""
    index = prices.groupBy("time").agg(F.avg("ret").alias("mkt_ret")) if index is None else index.select("time", "mkt_ret")
    return rows.join(F.broadcast(index.withColumn("_on", F.lit(True))), "time", "left")  # one row per trading day


def benchmark(index: DataFrame, code: str | None = None) -> DataFrame:
    """(time, mkt_ret) of the index prices (time, close, pre_close), of one `code` if the table has several."""
    rows = index if code is None else index.where(F.col("code") == code)
    return rows.select("time", (div("close", "pre_close") - 1).alias("mkt_ret"))


def market_beta(prices: DataFrame, window: int = 252, half_life: float = 63, least: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """BETA, Hist_sigma and alpha of returns on the market, or on an index (`benchmark`), which has no row of its own."""
    fit = weighted_beta(on_market(prices, prices, index).where("_on"), "ret", "mkt_ret", window, half_life, least)
    return fit.where("ret is not null and beta is not null").select("code", "time", F.col("beta").alias("BETA"), F.col("sigma").alias("Hist_sigma"), "alpha")


def daily_std(prices: DataFrame, calendar: DataFrame, half_life: float = 42) -> DataFrame:
    dense = dense_panel(prices, calendar, ["ret"])
    return ewma_deviation(dense, "ret", half_life).where("ewma is not null").select("code", "time", F.col("ewma").alias("Daily_std"))


def _known(dense: DataFrame, layers: Layers, name: str) -> DataFrame:
    """(code, time, name) of the layers' column, where it is known."""
    return layered(dense, layers).select("code", "time", name).where(F.col(name).isNotNull())


def range_layers(step: int, count: int, limit: int) -> Layers:
    names = [f"_p{k}" for k in range(count + 1)]
    points = [F.lag("_before", step * count - 1).over(by_code()), *sampled_lags(F.col("_filled"), step, count)[::-1]]
    padded = [F.coalesce(*names[k::-1]) for k in range(count + 1)]
    rest = F.array(*[F.when(before.isNotNull(), now) for before, now in zip(padded, padded[1:], strict=False)])
    return [
        {"_filled": fill_limited("close", limit), "_before": fill_limited("pre_close", limit)},
        dict(zip(names, points, strict=True)),
        {"_rest": rest},
        {"Cumulative_range": F.when(F.col("t") >= step * count, F.log(F.array_max("_rest")) - F.log(F.array_min("_rest")))},
    ]


def cumulative_range(prices: DataFrame, calendar: DataFrame, step: int = 21, count: int = 12, limit: int = 10) -> DataFrame:
    """Log range of the prices every `step` rows over `count` steps. The first known point is the base of the
    returns; the range is that of the points after it, of which unknown ones repeat the point before."""
    return _known(dense_panel(prices, calendar, ["close", "pre_close"]), range_layers(step, count, limit), "Cumulative_range")


def turnover_layers(month: int, months: int) -> Layers:
    lags = {f"_l{k}": c for k, c in enumerate(sampled_lags(F.col("_m"), month, months))}
    mean = lambda n: F.when(F.col("t") >= month * months, F.log(row_mean(list(lags)[:n]) / 100))
    return [{"_m": full_window(F.col("turnover_ratio"), month)}, lags, {"Monthly_share_turnover": F.log(F.col("_m") / 100), "Quarterly_share_turnover": mean(3), "Annual_share_turnover": mean(months)}]


def turnover(valuation: DataFrame, calendar: DataFrame, month: int = 21, months: int = 12) -> DataFrame:
    """Log turnover of a month, and log means of the last 3 and of all `months` monthly sums."""
    dense = layered(dense_panel(valuation, calendar, ["turnover_ratio"]), turnover_layers(month, months))
    return dense.select("code", "time", "Monthly_share_turnover", "Quarterly_share_turnover", "Annual_share_turnover")


def traded_layers(window: int, half_life: float) -> Layers:
    value, norm = F.col("turnover_ratio") / 100, sum(half_life_weights(window, half_life, standardize=False))
    total = decayed_sum(value, window, half_life) * F.lit(0.5 ** (1 / half_life) * window / norm)
    return [{"Annualized_traded_value_ratio": F.when(F.col("t") >= window, div(total * window, window_count(value, window).cast("double")))}]


def traded_value_ratio(valuation: DataFrame, calendar: DataFrame, window: int = 252, half_life: float = 63) -> DataFrame:
    """`window` times the mean of the known turnovers, weighted by half-life weights with a mean of 1."""
    return _known(dense_panel(valuation, calendar, ["turnover_ratio"]), traded_layers(window, half_life), "Annualized_traded_value_ratio")


def reversal_layers(window: int, half_life: float) -> Layers:
    return [{"_mean": full_window(F.col("ret"), window, mean=True)}, {"Short_Term_reversal": lagged_sum(F.log(1 + F.col("_mean")), half_life_weights(window, half_life), by_code())}]


def reversal(prices: DataFrame, calendar: DataFrame, window: int = 21, half_life: float = 5) -> DataFrame:
    return _known(dense_panel(prices, calendar, ["ret"]), reversal_layers(window, half_life), "Short_Term_reversal")


def season_layers(calendar: DataFrame, years: int, days: int) -> Layers:
    """The return that began some steps before stands as many rows before; a calendar has few such distances."""
    back = step_distances(calendar, years)
    at: list[dict[int, list[int]]] = [{} for _ in range(years)]  # the steps of each distance, by years back
    for t, own in back.items():
        for i, n in enumerate(own):
            at[i].setdefault(n, []).append(t)
    ago = {f"_r{n}": F.lag("_r", n).over(by_code()) for n in sorted({n for own in at for n in own})}
    used = {f"_year{i}": F.coalesce(*[F.when(F.col("t").isin(own[n]), F.col(f"_r{n}")) for n in sorted(own)]) for i, own in enumerate(at) if own}
    start = {"_r": div(F.lead("_last", days - 1).over(by_code()), "close") - 1}
    return [{"_last": fill_limited("close", days - 1)}, start, ago, used, {"Seasonality": row_mean(list(used)) if used else F.lit(None).cast("double")}]


def seasonality(prices: DataFrame, calendar: DataFrame, years: int = 5, days: int = 21) -> DataFrame:
    """Mean over the years i of the return over the `days` trading days from the first one on or after time - 365 i."""
    return _known(dense_panel(prices, calendar, ["close"]), season_layers(calendar, years, days), "Seasonality")


def strength(prices: DataFrame, calendar: DataFrame, window: int, half_life: float, null_denominator: int | None = None, null_share: float = 0.1) -> DataFrame:
    """code, time, t, RS: half-life weighted sum of log returns."""
    dense = dense_panel(prices, calendar, ["ret"])
    return dense.select("code", "time", "t", weighted_sum(F.log(1 + F.col("ret")), window, half_life, null_share, null_denominator).alias("RS"))


def industry_momentum(prices: DataFrame, valuation: DataFrame, industry: DataFrame, calendar: DataFrame, window: int = 126, half_life: float = 21, null_denominator: int = 252) -> DataFrame:
    """The industry's strength, weighted by sqrt(cap), minus the code's own. An industry table that varies in time is
    taken as of the month's first day, of those with a full window behind them."""
    rs = strength(prices, calendar, window, half_life, null_denominator)
    return industry_relative(rs.join(valuation.select("code", "time", "circulating_market_cap"), ["code", "time"]), industry, calendar, window)


def industry_relative(strengths: DataFrame, industry: DataFrame, calendar: DataFrame, window: int) -> DataFrame:
    """`industry_momentum` from strengths (code, time, RS, circulating_market_cap)."""
    rows = with_industry(strengths.where("RS is not null"), industry, month_start=True, calendar=calendar.where(F.col("t") >= window))
    return group_relative(rows, "RS", F.sqrt("circulating_market_cap"), ["time", "L1"]).select("code", "time", F.col("relative").alias("Industry_Momentum"))


def strength_layers(window: int, half_life: float, mean: int, sign: int = 1, name: str = "Relative_strength", null_share: float = 0.1) -> Layers:
    rs = weighted_sum(F.log(1 + F.col("ret")), window, half_life, null_share)
    return [{f"_{name}": rs}, {name: sign * full_window(F.col(f"_{name}"), mean, mean=True)}]


def relative_strength(prices: DataFrame, calendar: DataFrame, window: int = 252, half_life: float = 126, mean: int = 11, sign: int = 1, name: str = "Relative_strength", null_share: float = 0.1) -> DataFrame:
    """Mean of the last `mean` strengths; sign -1 for the long-term reversal."""
    return _known(dense_panel(prices, calendar, ["ret"]), strength_layers(window, half_life, mean, sign, name, null_share), name)


def alpha_layers(window: int, half_life: float, mean: int, sign: int = 1, name: str = "Hist_alpha") -> Layers:
    own = F.when(F.col("_on"), F.col(f"alpha{name}"))
    return [*beta_layers("ret", "mkt_ret", window, half_life, mark=name), {name: sign * full_window(own, mean, mean=True)}]


def smoothed_alpha(prices: DataFrame, calendar: DataFrame, window: int = 252, half_life: float = 126, mean: int = 11, sign: int = 1, name: str = "Hist_alpha", index: DataFrame | None = None) -> DataFrame:
    """Mean of the last `mean` intercepts of the regression on the market, or on an index (`benchmark`)."""
    dense = on_market(dense_panel(prices, calendar, ["ret"]), prices, index)
    return _known(dense.where("_on"), alpha_layers(window, half_life, mean, sign, name), name)


def value_columns() -> dict[str, Column]:
    one = F.lit(1.0)
    return {"Book_to_price": div(one, "pb_ratio"), "Earning_to_price": div(one, "pe_ratio"), "Cash_earning_to_price": div(one, "pcf_ratio"), "Dividend_to_Price": F.col("dv_ratio")}


def value_ratios(valuation: DataFrame) -> DataFrame:
    return valuation.withColumns(value_columns()).select("code", "time", "Book_to_price", "Earning_to_price", "Cash_earning_to_price")


def dividend(valuation: DataFrame) -> DataFrame:
    return valuation.select("code", "time", F.col("dv_ratio").alias("Dividend_to_Price"))
