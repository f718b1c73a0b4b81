"""Operators against plain loops on small panels, and properties."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.functions.columns import half_life_weights, report_deadline
from factorspark.operators import attribution, calendar, evaluate, events, fundamentals, panel, rolling, training, xsection
from factorspark.plans import factors
from factorspark.sources import io, schemas
from factorspark.styles import price, statements

DAY = dt.date(2020, 1, 6)


@pytest.fixture(scope="module")
def prices(spark):
    """5 codes x 40 days: full, gaps, late listing, delisting, constant price."""
    rng, rows = random.Random(1), []
    for code in range(5):
        close = 10.0
        for k in range(40):
            if (code == 1 and k % 7 in (2, 3)) or (code == 2 and k < 15) or (code == 3 and k > 25):
                continue
            before, close = close, close if code == 4 else round(close * (1 + rng.uniform(-0.05, 0.05)), 4)
            rows.append((code, DAY + dt.timedelta(k), close, before, float(rng.randint(1, 100)), round(rng.random(), 3)))
    df = spark.createDataFrame(rows, "code long, time date, close double, pre_close double, circulating_market_cap double, x double")
    cal = calendar.ordinals(df)
    return df.join(cal, "time").withColumn("ret", F.col("close") / F.col("pre_close") - 1).cache(), cal


def wide(df, value):
    pdf = df.select("time", "code", value).toPandas()
    return pdf.pivot(index="time", columns="code", values=value).sort_index().astype(float)


def test_beta_equals_least_squares(prices):
    df, _ = prices
    out = {(r.code, r.time): r for r in price.market_beta(df, 15, 5, 8).collect()}
    ret = wide(df, "ret")
    mkt = ret.mean(axis=1)
    weights = np.array(half_life_weights(15, 5))[::-1]
    checked = 0
    for code in ret:
        for k in range(14, 40):
            y, x = ret[code].to_numpy()[k - 14 : k + 1], mkt.to_numpy()[k - 14 : k + 1]
            have = ~np.isnan(y)
            if have.sum() < 8 or np.isnan(y[-1]):
                assert (code, ret.index[k]) not in out
                continue
            w, a = np.sqrt(weights[have]), np.column_stack((np.ones(have.sum()), x[have]))
            fit = np.linalg.lstsq(a * w[:, None], y[have] * w, rcond=None)[0]
            got = out[code, ret.index[k]]
            assert math.isclose(got.alpha, fit[0], abs_tol=1e-9) and math.isclose(got.BETA, fit[1], abs_tol=1e-8)
            assert math.isclose(got.Hist_sigma, np.std(y[have] - a @ fit), abs_tol=1e-9)
            checked += 1
    assert checked > 60


def test_long_calendars_and_large_values_keep_their_digits(spark):
    """Half-life 5 over 10,000 steps, 2,000 half-lives; returns of 1e-4 on a level of 1e3."""
    rng = np.random.default_rng(6)
    n, window, half = 10_000, 40, 5
    x = 1e3 + rng.normal(0, 1e-4, n)
    y = 2 * x + rng.normal(0, 1e-4, n)
    df = spark.createDataFrame([(1, k + 1, float(a), float(b)) for k, (a, b) in enumerate(zip(x, y, strict=True))], "code int, t int, x double, y double")
    out = rolling.weighted_beta(df, "y", "x", window, half).withColumn("total", rolling.weighted_sum(F.col("x") - 1e3, window, half)).where("t % 997 = 0 or t > 9990").collect()
    assert len(out) > 15
    for r in out:
        a, b = x[r.t - window : r.t], y[r.t - window : r.t]
        w = 0.5 ** ((np.arange(window)[::-1] + 1) / half)
        ca, cb = a - (w * a).sum() / w.sum(), b - (w * b).sum() / w.sum()
        beta = (w * ca * cb).sum() / (w * ca * ca).sum()
        assert math.isclose(r.beta, beta, rel_tol=1e-9)
        assert math.isclose(r.alpha, (w * b).sum() / w.sum() - beta * (w * a).sum() / w.sum(), rel_tol=1e-9)
        assert math.isclose(r.total, (w * (a - 1e3)).sum() / w.sum(), rel_tol=1e-9, abs_tol=1e-15)


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 64, 301):
        y = rng.integers(0, max(1, n // 2), n)
        assert evaluate.inversions(y) == sum(int(a > b) for k, b in enumerate(y) for a in y[:k])


def test_ewma_restarts_after_gaps(prices):
    df, cal = prices
    out = {(r.code, r.time): r.Daily_std for r in price.daily_std(df, cal, 4).collect()}
    ret, keep = wide(df, "ret"), 0.5 ** (1 / 4)
    for code in ret:
        series = ret[code].loc[ret[code].first_valid_index() :]
        seed = v = series.var()
        for t, r in series.items():
            v = v * keep + r * r * (1 - keep)
            if np.isnan(v):
                v = seed
                assert (code, t) not in out
            else:
                assert math.isclose(out[code, t], math.sqrt(v), abs_tol=1e-12)


def test_cumulative_range_with_gaps(prices):
    df, cal = prices
    out = {(r.code, r.time): r.Cumulative_range for r in price.cumulative_range(df, cal, 3, 4, 1).collect()}
    close, before = wide(df, "close").ffill(limit=1), wide(df, "pre_close").ffill(limit=1)
    for code in close:
        for k in range(11, 40):
            points = [before[code].iloc[k - 11], *[close[code].iloc[k - 11 + j] for j in (2, 5, 8, 11)]]
            r = pd.Series(points).ffill().pct_change()
            r = r.where(pd.Series(points).ffill().shift().notna())
            z = np.log(1 + r).cumsum().dropna()
            key = (code, close.index[k])
            if len(z):
                assert math.isclose(out[key], z.max() - z.min(), abs_tol=1e-9), key
            else:
                assert key not in out


def test_cross_section(prices):
    df, _ = prices
    for t, group in xsection.zscore(df.select("code", "time", "close"), ["close"], eps=0.0).toPandas().groupby("time"):
        assert abs(group.close.mean()) < 1e-9 and (len(group) < 2 or abs(group.close.std() - 1) < 1e-9)
    once = xsection.winsorize(df.select("code", "time", "x"), ["x"], "time", 0.0, 1.0)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, df.select("code", "time", "x").collect()))
    shuffled = df.repartition(7, "x")
    clean = lambda d: sorted((r.code, r.time, round(r.ret, 9)) for r in xsection.clean_panel(d.select("code", "time", "ret"), d, ["ret"]).collect())
    assert clean(df) == clean(shuffled)
    residual = xsection.regression_residual(df.withColumn("y", 3 * F.col("x") + 2), "y", "x", F.sqrt("circulating_market_cap")).where("residual is not null").toPandas()
    assert residual.residual.abs().max() < 1e-9


def test_asof_never_looks_ahead_and_fills_by_column(spark, prices):
    _, cal = prices
    rows = [(1, DAY - dt.timedelta(9), DAY - dt.timedelta(40), 1.0, None), (1, DAY + dt.timedelta(4), DAY - dt.timedelta(10), None, 5.0), (1, DAY + dt.timedelta(4), DAY - dt.timedelta(5), 3.0, None), (2, DAY + dt.timedelta(900), DAY, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "code long, pubDate date, statDate date, a double, b double")
    out = {(r.code, r.time): (r.a, r.b) for r in panel.asof_align(df, cal, "pubDate", ["a", "b"], "statDate").collect()}
    assert len(out) == 40 and out[1, DAY] == (1.0, None) and out[1, DAY + dt.timedelta(3)] == (1.0, None)
    assert out[1, DAY + dt.timedelta(4)] == (3.0, 5.0) == out[1, DAY + dt.timedelta(39)]


def test_asof_takes_records_of_any_age_and_several_tables(spark, prices):
    _, cal = prices
    old = spark.createDataFrame([(1, dt.date(1990, 5, 1), dt.date(1990, 3, 31), 1.0), (1, dt.date(1991, 5, 1), dt.date(1991, 3, 31), 2.0), (3, None, None, 5.0)], "code long, pubDate date, statDate date, a double")
    new = spark.createDataFrame([(1, DAY + dt.timedelta(2), 7.0), (2, DAY + dt.timedelta(2), 8.0), (2, DAY + dt.timedelta(2), None)], "code long, day date, b double")
    both = {(r.code, r.time): (r.a, r.b) for r in panel.asof_align_all([(old, "pubDate", ["a"], "statDate"), (new, "day", ["b"], "day")], cal).collect()}
    assert both[1, DAY] == (2.0, None) and both[1, DAY + dt.timedelta(2)] == (2.0, 7.0) and both[2, DAY + dt.timedelta(39)] == (None, 8.0)
    assert {c for c, _ in both} == {1, 2} and len(both) == 40 + 38
    alone = {(r.code, r.time): r.a for r in panel.asof_align(old, cal, "pubDate", ["a"], "statDate").collect()}
    assert alone == {k: v[0] for k, v in both.items() if k[0] == 1}


def test_trailing_sums_by_their_kind(spark):
    q = [dt.date(y, m, d) for y in (2019, 2020) for m, d in ((3, 31), (6, 30), (9, 30), (12, 31))]
    flow = [1.0, 3.0, 6.0, 10.0, 2.0, 5.0, 9.0, 14.0]
    rows = [(1, d, v, v if d.month in (6, 12) else None, 1.0 * k) for k, (d, v) in enumerate(zip(q, flow, strict=True))]
    df = spark.createDataFrame(rows, "code long, statDate date, operating_revenue double, net_profit double, cash_equivalent_increase double")
    for c in ("total_operating_revenue", "total_operating_cost", "np_parent_company_owners", "operating_cost"):
        df = df.withColumn(c, F.col("operating_revenue"))
    out = {r.statDate: r for r in fundamentals.trailing(df).collect()}
    assert [out[d].operating_revenue_ttm for d in q] == [None] * 3 + [10.0, 11.0, 12.0, 13.0, 14.0]
    assert [out[d].net_profit_ttm for d in q] == [None, None, None, 10.0, None, 12.0, None, 14.0]
    assert [out[d].cash_equivalent_increase_ttm for d in q] == [None] * 3 + [6.0, 10.0, 14.0, 18.0, 22.0]


def test_leverage_and_accruals_by_hand(spark, prices):
    _, cal = prices
    at = [dt.date(2018, 12, 31), dt.date(2019, 6, 30)]
    base = {"code": 1, "pubDate": None, "oth_eqt_tools_p_shr": 3.0, "total_non_current_liability": 4.0, "total_assets": 100.0, "total_liability": 60.0, "cash_and_equivalents_at_end": 10.0, "non_current_liability_in_one_year": 5.0, "shortterm_loan": 6.0}
    base |= {"fixed_assets_depreciation": 1.0, "intangible_assets_amortization": 2.0, "defferred_expense_amortization": None, "net_operate_cash_flow": 7.0, "net_invest_cash_flow": -3.0, "net_profit": 9.0}
    two = [base | {"statDate": at[0], "pubDate": dt.date(2019, 3, 1)}, base | {"statDate": at[1], "pubDate": dt.date(2019, 8, 1), "total_assets": 120.0}]
    kinds = ", ".join(f"{c} {'long' if c == 'code' else 'date' if c.endswith('Date') else 'double'}" for c in two[0])
    finance = spark.createDataFrame([tuple(r.values()) for r in two], kinds)
    valuation = spark.createDataFrame([(1, DAY, 50.0, 2.0)], "code long, time date, market_cap double, pb_ratio double")
    got = statements.leverage(finance, valuation, cal, 1.0).first()
    assert (got.Market_Leverage, got.Book_Leverage, got.Debt_to_asset_ratio) == ((50 + 7) / 50, (25 + 7) / 50, 0.5)
    got = statements.accruals(finance, cal).where(F.col("time") == F.lit(DAY)).first()
    assert math.isclose(got.ABS, -(20 - 3) / 120) and math.isclose(got.ACF, -(9 - 4 + 3) / 120)


def test_forecasts_expand_within_their_year(spark):
    days = [dt.date(2019, 12, 20) + dt.timedelta(k) for k in range(60)]
    cal = calendar.ordinals(spark.createDataFrame([(d,) for d in days if d.weekday() < 5], "time date"))
    values = [(dt.date(2019, 12, 24), 0.1), (dt.date(2019, 12, 28), 0.2), (dt.date(2019, 12, 28), None), (dt.date(2020, 1, 7), 0.3), (dt.date(2020, 1, 11), 0.7), (dt.date(2020, 1, 20), 0.9)]
    rows = spark.createDataFrame([(1, t, "2020Q4", 2020, v) for t, v in values], "code long, time date, quarter string, year int, rd double")
    got = {r.time: (r.mean, r.std) for r in events.expanding_forecast(events.forecast_days(rows, ["rd"]), cal, "rd").collect()}
    for d in days:
        if d.weekday() > 4 or d.year < 2020:
            assert d not in got
            continue
        known = [v for t, v in values if t <= d]
        if len(known) < 5:
            assert d not in got
            continue
        have = [v for v in known if v is not None]
        assert math.isclose(got[d][0], sum(have) / len(have)) and math.isclose(got[d][1], np.std(have), abs_tol=1e-7)
    early = events.expanding_forecast(events.forecast_days(rows, ["rd"]), cal, "rd", least=2)
    assert early.agg(F.min("time")).first()[0] == dt.date(2020, 1, 1)
    assert panel.select_reports(rows.withColumn("quarter", F.when(F.col("rd") > 0.5, "2021Q1").otherwise(F.col("quarter"))), [2021]).count() == 2


def test_selectors(spark, prices):
    df, cal = prices
    stats = [dt.date(2019, m, 28) for m in (3, 6, 9, 12)]
    rows = spark.createDataFrame([(c, d, d, 1.0) for c in (1, 2) for d in stats[c - 1 :]], "code long, pubDate date, statDate date, a double")
    assert sorted({r.statDate for r in panel.select_statements(rows, end=dt.date(2019, 11, 1), count=2).collect()}) == stats[1:3]
    assert panel.select_statements(rows, end=dt.date(2019, 4, 1), count=9).count() == 1
    assert [r.code for r in panel.listed_before(spark.createDataFrame([("a", stats[0]), ("b", stats[3])], "code string, list_date date"), stats[1]).collect()] == ["a"]
    codes = spark.createDataFrame([("600000",), ("000001",), ("830001",)], "code string")
    assert {r.code for r in panel.with_prefix(codes, ["0", "6", "3"]).collect()} == {"600000", "000001"}
    varying = df.select("code", "time", F.concat(F.lit("i"), F.month("time"), F.dayofmonth("time")).alias("L1"))
    dated = panel.with_industry(df.select("code", "time"), varying, month_start=True).collect()
    assert {r.time.month: r.L1 for r in dated} == {1: "i16", 2: "i21"}
    assert all(r.L1 == f"i{r.time.month}{r.time.day}" for r in panel.with_industry(df.select("code", "time"), varying).collect())
    window = evaluate.forward_return(df, 2, "close", calendar=cal, start=DAY + dt.timedelta(3), end=DAY + dt.timedelta(9)).where("code = 0")
    assert [r.time for r in window.orderBy("time").collect()] == [DAY + dt.timedelta(k) for k in range(3, 10)]
    assert evaluate.forward_return(df, 2, "close", calendar=cal, end=DAY + dt.timedelta(9), fill=False).where("code = 0").count() == 8
    assert [r.time for r in calendar.rebalance_of(cal).collect()] == [dt.date(2019, 9, 1)]


def test_windows_are_trained_scored_and_written(spark, prices, tmp_path):
    df, cal = prices
    rows = evaluate.labels(df.where("code <> 4").dropna(subset=["ret"]), 1)
    spans = training.walk_forward(cal, 20, 5)
    n = spans.count()
    for kind, names in (("regression", ["rmse", "r2"]), ("classifier", ["accuracy", "f1", "auc"])):
        built = training.walk_forward_run(rows, spans, ["x", "ret"], kind, rounds=2)
        found = {r.window_id: r for r in built["metrics"].collect()}
        scored = built["portfolio"].toPandas()
        assert len(found) == n == scored.window_id.nunique()
        for k, r in found.items():
            own = scored[scored.window_id == k]
            assert r.n == len(own) and r.start < r.end < r.test and set(own.time) == {r.test} and all(m in r.asDict() for m in names)
            assert [x.feature for x in r.importances] == [x.feature for x in sorted(r.importances, key=lambda x: (-x.splits, -x.importance, x.feature))]
            if kind == "regression":
                assert math.isclose(r.rmse, math.sqrt(((own.return_ratio - own.score) ** 2).mean()), abs_tol=1e-12)
            else:
                assert math.isclose(r.accuracy, ((own.score >= 0.5) == (own.class_label == 1)).mean())
        io.write_metrics(built["metrics"], str(tmp_path / kind))
        assert sorted(p.name for p in (tmp_path / kind).glob("window_id=*")) == sorted(f"window_id={k}" for k in found)


def test_pure_factor_returns_equal_dense_solution(spark):
    rng, rows = np.random.default_rng(5), []
    for d in range(3):
        for k in range(40):
            rows.append((DAY + dt.timedelta(d), "abc"[k % 3], float(rng.normal()), float(rng.normal()), float(rng.integers(1, 90)) if k else None, float(rng.normal()) / 50, float(rng.normal()) / 50))
    df = spark.createDataFrame(rows, "time date, L1 string, s1 double, s2 double, cap double, next_ret double, next_log double")
    out = {(r.time, r.factor): (r.simple, r.log) for r in attribution.pure_factor_returns(df, ["s1", "s2"]).collect()}
    for t, g in df.fillna(0.0).toPandas().groupby("time"):
        x = np.column_stack((np.ones(len(g)), *[(g.L1 == c).astype(float) for c in "abc"], g.s1, g.s2))
        v = np.diag(np.sqrt(g.cap) / np.sqrt(g.cap).sum())
        caps = g.groupby("L1").cap.sum()
        r = np.delete(np.eye(6), 3, 1)
        r[3, 1:3] = -caps["a"] / caps["c"], -caps["b"] / caps["c"]
        f = r @ np.linalg.pinv(r.T @ x.T @ v @ x @ r) @ r.T @ x.T @ v @ g[["next_ret", "next_log"]].to_numpy()
        for name, want in zip(("country", "a", "b", "c", "s1", "s2"), f, strict=True):
            assert np.allclose(out[t, name], want, atol=1e-10)
        assert abs(sum(caps[c] * out[t, c][0] for c in "abc")) < 1e-9


@pytest.mark.parametrize("kind", ["pearson", "spearman", "kendall"])
def test_ic_equals_pandas(prices, kind):
    df, _ = prices
    got = {(r.time, r.factor): r.ic for r in evaluate.factor_ic(df, evaluate.forward_return(df, 2, "close"), ["x", "ret"], kind).collect()}
    joined = df.join(evaluate.forward_return(df, 2, "close").select("code", "time", "forward"), ["code", "time"]).toPandas()
    for t, g in joined.groupby("time"):
        for c in ("x", "ret"):
            a, b = (g[c], g.forward) if kind == "pearson" else (g[c].rank(), g.forward.rank())
            if kind == "kendall":
                s = [np.sign(a.iloc[i] - a.iloc[j]) * np.sign(b.iloc[i] - b.iloc[j]) for i in range(len(g)) for j in range(i)]
                n1, n2 = (sum(z.iloc[i] != z.iloc[j] for i in range(len(g)) for j in range(i)) for z in (a, b))
                want = sum(s) / math.sqrt(n1 * n2) if n1 and n2 else None
            else:
                want = a.corr(b) if len(g) > 1 and a.std() > 0 and b.std() > 0 else None
            assert (got[t, c] is None) == (want is None) and (want is None or math.isclose(got[t, c], want, abs_tol=1e-9))
            assert got[t, c] is None or -1 - 1e-9 <= got[t, c] <= 1 + 1e-9


def test_weights_and_calendar(spark, prices):
    _, cal = prices
    assert math.isclose(sum(half_life_weights(252, 63)), 1)
    one = lambda **k: tuple(calendar.resolve_window(cal, **k).first())
    assert one(end=DAY + dt.timedelta(9), count=10) == (DAY, DAY + dt.timedelta(9))
    assert one(start=DAY, count=3) == (DAY, DAY + dt.timedelta(2)) and one(end=DAY, count=2)[0] is None
    with pytest.raises(ValueError):
        one(count=3)
    due = {r.statDate: r.d for r in calendar.period_ends(spark, dt.date(2020, 2, 1), dt.date(2020, 12, 1)).withColumn("d", report_deadline()).collect()}
    assert list(map(due.get, sorted(due))) == [dt.date(2020, 5, 1), dt.date(2020, 9, 1), dt.date(2020, 11, 1), dt.date(2021, 5, 1)]
    assert [r.time for r in calendar.rebalance_dates(spark, dt.date(2020, 3, 1), dt.date(2020, 9, 2)).collect()] == [dt.date(2019, 9, 1), dt.date(2020, 5, 1), dt.date(2020, 9, 1)]
    with pytest.raises(ValueError):
        training.walk_forward(cal, 40, 5)


def test_rolling_apply_equals_windows(spark, prices):
    df, _ = prices
    out = {(r.code, r.time): r.x for r in rolling.panel_rolling_apply(df, "time", "code", "x", 3, lambda s: s.max()).collect()}
    want = wide(df, "x").rolling(3).max().ffill()
    assert out == {(c, t): v for c in want for t, v in want[c].items() if not np.isnan(v)}


def test_sources_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", "20200131", 1.5, float("nan")), ("b", "x", 2.5, 1.0)], "ts_code string, trade_date string, pe double, pb double")
    df = io.nulls_for_nan(io.parse_dates(io.canonical_names(rows), ["time"]))
    assert [tuple(r) for r in df.collect()] == [("a", dt.date(2020, 1, 31), 1.5, None)] and df.columns == ["code", "time", "pe_ratio", "pb_ratio"]
    assert io.canonical_names(df, back=True).columns[0] == "ts_code"
    calls = []
    compute = lambda: (calls.append(1), df)[1]
    for _ in range(2):
        assert io.load_or_compute(spark, str(tmp_path / "t"), compute).count() == 1
    assert calls == [1]
    io.write_table(df, str(tmp_path / "y"), "csv", by_year_of="time")
    assert (tmp_path / "y" / "year=2020").exists()
    assert io.read_table(spark, str(tmp_path / "t"), schemas._table(code="s", time="d")).columns == ["code", "time"]
    for code in "ab":
        (tmp_path / f"{code}.csv").write_text(f"code,time,open,close,pre_close\n{code},2020-01-02,1.5,2,1\n")
    (tmp_path / "empty.csv").write_text("code,time,open,close,pre_close\n")
    many = io.read_table(spark, [str(tmp_path / f"{c}.csv") for c in ("a", "b", "empty")], schemas.PRICE, "csv")
    assert many.schema == schemas.PRICE and sorted(r.code for r in many.collect()) == ["a", "b"]
    once = [io.Stages(spark, [str(tmp_path)]).keep("once", compute, "code", ("time",)) for _ in range(2)]
    assert calls == [1, 1] and [df.count() for df in once] == [1, 1]
    assert "Exchange" not in once[0].groupBy("code").count()._jdf.queryExecution().executedPlan().toString().replace("AQEShuffleRead", "")


def test_boosted_trees_rank_a_clear_signal(spark):
    rows = [(k, DAY + dt.timedelta(k % 30), float(k % 11), float(k % 7), (k % 11) / 10.0, int(k % 11 > 5), k % 5 != 0) for k in range(600)]
    df = spark.createDataFrame(rows, "code long, time date, a double, b double, return_ratio double, class_label int, is_train boolean")
    score, model = training.fit_regression(df, ["a", "b"], rounds=5)
    found = {r.feature: r for r in training.feature_importance(spark, model).collect()}
    assert found["a"].importance > found["b"].importance and sum(r.splits for r in found.values()) == sum(f >= 0 for t in model.trees for f in t.feature)
    assert training.rank_portfolio(score(df), top=1).agg(F.min("a")).first()[0] >= 8
    score, _ = training.fit_classifier(df, ["a", "b"], rounds=5)
    assert training.class_metrics(score(df).withColumn("all", F.lit(1)), "class_label", "score", ["all"]).first().auc > 0.99


def test_boosted_queries_train_and_score_every_window(spark, data):
    from factorspark.queries import QUERIES, Tables

    spans = training.walk_forward(Tables(spark, data, "month").cal, 40, 20, 5).collect()
    assert len(spans) > 1
    want = {(s.window_id, s.test) for s in spans}
    for name in ("boosted_regression", "boosted_classifier"):
        rows = QUERIES[name](spark, data).collect()
        assert {(r.window_id, r.time) for r in rows} == want
        for k, _ in want:
            assert sorted(r["rank"] for r in rows if r.window_id == k) == list(range(1, 1 + sum(r.window_id == k for r in rows)))
    found = QUERIES["feature_importance"](spark, data).collect()
    assert sorted((r.window_id, r.feature) for r in found) == sorted((s.window_id, c) for s in spans for c in ("turnover_ratio", "dv_ratio", "ret"))


def test_factors_are_built_and_written(spark, data, tmp_path):
    """Workload A whole, on keys of the price rows, each table once."""
    from factorspark.queries import WEEKLY, Tables

    x = Tables(spark, data)
    kept = []

    def keep(name, compute):
        kept.append(name)
        return io.load_or_compute(spark, str(tmp_path / "kept" / name), compute)

    built = factors.build_factors(x.p, x.cal, x.industry_panel, x.finance, x.days, x.dates, WEEKLY, n=2, keep=keep)
    assert len(kept) == len(set(kept)) and len(factors.DESCRIPTORS) == 45 and len(factors.STYLES) == 9
    assert built["descriptors"].columns == ["code", "time", *factors.DESCRIPTORS]
    assert built["descriptors"].count() == x.p.count() == built["styles"].count()
    for t, group in built["styles"].toPandas().groupby("time"):
        means = group[list(factors.STYLES)].mean().dropna()
        assert (means.abs() < 1e-6).all(), t
    assert {r.factor for r in built["icir"].collect()} <= set(factors.DESCRIPTORS)
    factors.write_factors({n: built[n] for n in ("styles", "ic", "icir", "returns")}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out" / "styles")).count() == x.p.count()
    assert {r.factor for r in spark.read.parquet(str(tmp_path / "out" / "returns")).select("factor").distinct().collect()} >= {"country", *factors.STYLES}
