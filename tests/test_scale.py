"""What a query costs: each works out what it needs, and windows of any length cost the same."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from factorspark.operators import evaluate, rolling, training, xsection
from factorspark.plans import factors
from factorspark.queries import QUERIES, Tables


def test_returns_of_styles_need_no_ic(spark, data, monkeypatch):
    def unused(*_, **__):
        pytest.fail("the IC is worked out")

    Tables(spark, data).stages.drop()  # what other tests left
    monkeypatch.setattr(evaluate, "factor_ic", unused)
    monkeypatch.setattr(factors, "factor_ic", unused)
    assert "simple" in QUERIES["style_returns"](spark, data).columns


def test_windows_of_any_length_have_growing_frames(spark):
    rng = np.random.default_rng(2)
    rows = [(k, t, float(rng.normal()) if rng.random() < 0.8 else None) for k in range(3) for t in range(1, 120)]
    df = spark.createDataFrame(rows, "code int, t int, x double")
    out = df.withColumns({"total": rolling.full_window(F.col("x"), 3), "faded": rolling.weighted_sum(F.col("x"), 40, 9, 0.3)})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan and "currentrow$()) AS" not in plan.replace("unboundedpreceding$(), currentrow$()", "")
    for code, own in out.toPandas().groupby("code"):
        own = own.sort_values("t")
        x = own.x.to_numpy()
        weights = 0.5 ** (np.arange(40)[::-1] / 9)
        assert np.allclose(own.total, pd.Series(x).rolling(3).sum(), equal_nan=True)
        for k in range(39, len(x)):
            part = x[k - 39 : k + 1]
            want = np.nansum(weights * part) / weights.sum() if np.isnan(part).mean() <= 0.3 else np.nan
            assert np.allclose(own.faded.to_numpy(float)[k], want, equal_nan=True), (code, k)


def test_dates_are_cleaned_at_once(spark):
    """A date of one code, one of two, and one on which a column is unknown or constant."""
    rows = [(1, "2020-01-01", 1.0, None), (1, "2020-01-02", 2.0, 5.0), (2, "2020-01-02", 4.0, 5.0), *[(k, "2020-01-03", float(k), None) for k in range(3, 7)]]
    df = spark.createDataFrame(rows, "code long, time string, a double, b double").withColumn("time", F.to_date("time")).withColumn("t", F.dayofmonth("time"))
    out = {(r.code, r.time.day): (r.a, r.b) for r in xsection.clean_panel(df, df, ["a", "b"], 0.0, 1.0, 0.0).collect()}
    z = lambda x: (x - x.mean()) / x.std(ddof=1)
    assert out[1, 1] == (None, None) and out[1, 2][1] is None
    assert np.allclose([out[k, 2][0] for k in (1, 2)], z(np.array([2.0, 4.0])))
    assert np.allclose([out[k, 3][0] for k in range(3, 7)], z(np.arange(3.0, 7.0))) and all(out[k, 3][1] is None for k in range(3, 7))


def test_splits_of_a_pass_come_from_few_tasks_and_rows_are_split_once(spark, tmp_path, monkeypatch):
    """A pass has no group of its own for each node and feature, and a window's cut is found once."""
    frame = type(spark.range(1))
    seen = []
    monkeypatch.setattr(training, "time_split", lambda *_, **__: pytest.fail("the cut is worked out in every pass"))
    monkeypatch.setattr(frame, "groupBy", (lambda real: lambda self, *by: (seen.append(by), real(self, *by))[1])(frame.groupBy))
    day = dt.date(2020, 1, 1)
    rng = np.random.default_rng(4)
    rows = [(k, day + dt.timedelta(t), float(a := rng.normal()), a + float(rng.normal()) / 5) for t in range(30) for k in range(10)]
    df = spark.createDataFrame(rows, "code long, time date, a double, return_ratio double")
    spans = spark.createDataFrame([(0, day, day + dt.timedelta(20), day + dt.timedelta(22))], "window_id int, start date, end date, test date")
    training.train_windows(df, spans, ["a"], "regression", str(tmp_path / "w"), rounds=3, rate=0.3, least_rows=5)
    scored = spark.read.parquet(str(tmp_path / "w/scored"))
    assert scored.count() == 10 and scored.corr("a", "score") > 0.5
    assert ("node", "feature") not in seen


def test_training_tables_equal_the_windows_of_a_date(spark):
    rng = np.random.default_rng(5)
    rows = [(k, t, float(rng.normal()) if rng.random() < 0.7 else None, 1.0 if k % 2 else None) for t in (1, 2, 3) for k in range(1 if t == 3 else 9)]
    df = spark.createDataFrame(rows, "code long, t int, a double, b double").withColumn("time", F.make_date(F.lit(2020), F.lit(1), "t"))
    key = lambda frame: sorted((r.code, r.t, *(None if v is None else round(v, 9) for v in (r.a, r.b))) for r in frame.collect())
    for eps in (0.0, 1e-6):
        assert key(xsection.zscore_many(df, ["a", "b"], "time", eps)) == key(xsection.zscore(df, ["a", "b"], "time", eps))


def test_descriptors_need_no_cleaning(spark, data, monkeypatch):
    def unused(*_, **__):
        pytest.fail("the descriptors are cleaned")

    Tables(spark, data).stages.drop()
    monkeypatch.setattr(xsection, "clean_panel", unused)
    monkeypatch.setattr(factors, "clean_panel", unused)
    assert QUERIES["all_descriptors"](spark, data).columns == ["code", "time", *factors.DESCRIPTORS]
