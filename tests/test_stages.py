"""Staged tables follow their inputs; returns of the next trading day; regressions on an index."""

import datetime as dt
import math
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorspark.plans.factors import factor_returns
from factorspark.queries import QUERIES, Tables
from factorspark.sources import io
from factorspark.styles import price

DAY = dt.date(2020, 1, 1)


@pytest.fixture
def folder(data, tmp_path):
    for name in ("lineitem", "supplier", "nation", "region"):
        shutil.copy(f"{data}/{name}.parquet", tmp_path)
    return tmp_path


def test_a_changed_input_gives_new_rows(spark, folder):
    sf = str(folder)
    keep = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(keep)
    whole = {tuple(r) for r in QUERIES["size_lncap"](spark, sf).collect()}
    first = Tables(spark, sf)
    name = first.p._jdf.queryExecution().analyzed().toString()
    assert Tables(spark, sf).keep("panel-week", lambda: pytest.fail("the stage is there")).count() == len(whole)
    half = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_suppkey % 2 = 0")
    half.coalesce(1).write.parquet(f"{sf}/half")
    (part,) = (folder / "half").glob("part-*.parquet")
    shutil.move(part, folder / "lineitem.parquet")
    now = {tuple(r) for r in QUERIES["size_lncap"](spark, sf).collect()}
    assert {r[0] for r in now} == {r[0] for r in whole if r[0] % 2 == 0} and len(now) < len(whole)
    assert spark.conf.get(keep) == before
    second = Tables(spark, sf)
    assert second.p._jdf.queryExecution().analyzed().toString() != name
    stages = second.stages
    tables = [t.name for t in spark.catalog.listTables(stages.database)]
    assert len([t for t in tables if t.startswith(second.p.inputFiles()[0].split("/")[-2][:17])]) == 1  # the former one is gone
    at = second.p.inputFiles()[0].rsplit("/", 1)[0]
    stages.drop()
    assert not (io.existing(spark, at))
    assert QUERIES["size_lncap"](spark, sf).count() == len(now)


def test_load_or_compute_follows_its_inputs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("1\n")
    calls = []
    compute = lambda: (calls.append(1), spark.read.text(str(tmp_path / "in")))[1]
    get = lambda: sorted(r[0] for r in io.load_or_compute(spark, str(tmp_path / "out"), compute, [str(tmp_path / "in")]).collect())
    assert get() == get() == ["1"] and len(calls) == 1
    (tmp_path / "in/b.txt").write_text("2\n")
    assert get() == ["1", "2"] and len(calls) == 2 and len(list((tmp_path / "out").glob("inputs=*"))) == 1


def test_years_and_ranges_are_written_apart(spark, tmp_path):
    path = str(tmp_path / "t")
    frame = lambda rows: spark.createDataFrame(rows, "code string, time date, x int")
    day = lambda y, m: dt.date(y, m, 1)
    read = lambda: sorted((r.time, r.x) for r in spark.read.parquet(path).collect())
    io.write_table(frame([("a", day(2020, 1), 1), ("a", day(2021, 1), 2)]), path, by_year_of="time")
    io.write_table(frame([("a", day(2021, 5), 3)]), path, by_year_of="time")
    assert read() == [(day(2020, 1), 1), (day(2021, 5), 3)]
    io.write_range(frame([("a", day(2021, 6), 4), ("a", day(2019, 1), 9)]), path, "time", day(2020, 12), day(2021, 6))
    assert read() == [(day(2020, 1), 1), (day(2021, 6), 4)]
    io.write_range(frame([]), path, "time", day(2021, 1), day(2021, 12))
    assert read() == [(day(2020, 1), 1)]
    io.write_range(frame([("a", day(2022, 6), 5)]), path, "time", day(2022, 1), day(2022, 12))
    assert read() == [(day(2020, 1), 1), (day(2022, 6), 5)]


def test_next_day_returns_of_suspended_codes_and_whole_capital(spark):
    """Code 3 has no row on day 2, so its return over the day after day 1 is 0; code 9 has capital but no exposure, and
    industry `c` has no exposure at all."""
    rng = np.random.default_rng(8)
    codes, kinds = list(range(10)), "aaabbbbaac"
    rows, expo = [], []
    for t in (1, 2, 3):
        for k in codes:
            if (k, t) != (3, 2):
                rows.append((k, DAY + dt.timedelta(t), t, float(rng.integers(5, 90)), float(rng.normal() / 50)))
            if k < 8:
                expo.append((k, DAY + dt.timedelta(t), float(rng.normal())))
    prices = spark.createDataFrame(rows, "code long, time date, t int, circulating_market_cap double, ret double")
    exposures = spark.createDataFrame(expo, "code long, time date, s double")
    industry = spark.createDataFrame([(k, kinds[k]) for k in codes], "code long, L1 string")
    got = {(r.time, r.factor): (r.simple, r.log) for r in factor_returns(exposures, ["s"], prices, industry).collect()}
    own = {(k, t): (cap, ret) for k, _, t, cap, ret in rows}
    style = {(k, d): s for k, d, s in expo}
    for t in (1, 2, 3):
        day = DAY + dt.timedelta(t)
        have = [k for k in codes if (k, t) in own and (k, day) in style]
        x = np.array([[1.0, *[float(kinds[k] == c) for c in "abc"], style[k, day]] for k in have])
        v = np.diag([math.sqrt(own[k, t][0]) for k in have])
        caps = [sum(own[k, t][0] for k in codes if kinds[k] == c and (k, t) in own) for c in "abc"]
        tie = np.delete(np.eye(5), 3, 1)
        tie[3, 1:3] = -caps[0] / caps[2], -caps[1] / caps[2]
        back = np.array([own.get((k, t + 1), (0, 0.0))[1] for k in have])
        want = tie @ np.linalg.pinv(tie.T @ x.T @ v @ x @ tie) @ tie.T @ x.T @ v @ np.stack((back, np.log1p(back)), 1)
        for name, w in zip(("country", "a", "b", "c", "s"), want, strict=True):
            assert np.allclose(got[day, name], w, atol=1e-8), (t, name)


def test_betas_on_an_index(spark):
    rng = np.random.default_rng(3)
    move = rng.normal(0, 0.02, 80)
    rows = [(k, DAY + dt.timedelta(t), t + 1, float(0.001 * k + (k + 1) * move[t])) for k in range(3) for t in range(80)]
    prices = spark.createDataFrame(rows, "code long, time date, t int, ret double")
    level = 100 * np.cumprod(1 + move)
    index = [("X", DAY + dt.timedelta(t), float(level[t]), float(level[t - 1]) if t else 100.0) for t in range(80)] + [("Y", DAY, 1.0, 2.0)]
    index = price.benchmark(spark.createDataFrame(index, "code string, time date, close double, pre_close double"), "X")
    out = price.market_beta(prices, 40, 20, index=index).collect()
    assert {r.code for r in out} == {0, 1, 2} and len(out) == 3 * 41
    assert all(math.isclose(r.BETA, r.code + 1, rel_tol=1e-6) and math.isclose(r.alpha, 0.001 * r.code, abs_tol=1e-9) for r in out)
    calendar = prices.select("t", "time").distinct()
    alpha = price.smoothed_alpha(prices, calendar, 40, 20, 3, index=index).collect()
    assert alpha and all(math.isclose(r.Hist_alpha, 0.001 * r.code, abs_tol=1e-9) for r in alpha)
    assert not any(math.isclose(r.BETA, r.code + 1, rel_tol=1e-3) for r in price.market_beta(prices, 40, 20).where(F.col("code") < 2).collect())
