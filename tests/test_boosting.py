"""Boosted trees against a learner in plain numpy that grows split by split."""

import math

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorspark.operators import boosting, training
from factorspark.operators.boosting import Options


def plain_boost(codes, label, weight, train, key, start, o):
    """Scores after each round; each leaf's best split is found by looking at all bins, the best leaf is split first."""
    score = np.full(len(codes), start)
    rng = np.random.default_rng(o.seed)
    out, late_loss = [score.copy()], []
    columns = codes.shape[1]
    thin = lambda g: math.copysign(max(abs(g) - o.l1, 0), g)
    for k in range(o.rounds):
        features = sorted(rng.permutation(columns)[: max(1, math.ceil(o.features * columns))].tolist())
        if o.goal == "binary":
            p = 1 / (1 + np.exp(-score))
            g, h = weight * (p - label), weight * p * (1 - p)
            lost = weight * (np.logaddexp(0, score) - label * score)
        else:
            g, h = weight * (score - label), weight
            lost = weight * (score - label) ** 2
        late_loss.append(lost[~train].sum() / weight[~train].sum())
        bag = train & (boosting.in_bag(key, k // o.bagging_rounds, o.bagging, o.seed) if o.bagging < 1 else True)

        def split(rows, g=g, h=h, bag=bag, features=features):
            own = rows & bag
            best = None
            whole = thin(g[own].sum()) ** 2 / (h[own].sum() + o.l2)
            for f in features:
                for missing in (True, False):
                    for b in range(255):
                        left = own & np.where(codes[:, f] == 255, missing, codes[:, f] <= b)
                        right = own & ~left
                        if min(left.sum(), right.sum()) < o.least_rows or min(h[left].sum(), h[right].sum()) < o.least_hessian:
                            continue
                        gain = sum(thin(g[x].sum()) ** 2 / (h[x].sum() + o.l2) for x in (left, right)) - whole
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                            best = (gain, f, b, missing)
            return best

        every = np.ones(len(codes), bool)
        leaves = [(every, split(every))]
        while len(leaves) < o.leaves and any(s for _, s in leaves):
            at = max((i for i, (_, s) in enumerate(leaves) if s), key=lambda i: leaves[i][1][0])
            rows, (_, f, b, missing) = leaves.pop(at)
            left = rows & np.where(codes[:, f] == 255, missing, codes[:, f] <= b)
            leaves += [(x, split(x)) for x in (left, rows & ~left)]
        if len(leaves) == 1:
            break
        for rows, _ in leaves:
            own = rows & bag
            score[rows] -= o.rate * thin(g[own].sum()) / (h[own].sum() + o.l2)
        out.append(score.copy())
    return out, late_loss


def sample(spark, n=260, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    x[rng.random(n) < 0.1, 1] = np.nan
    y = np.sin(2 * x[:, 0]) + np.where(np.isnan(x[:, 1]), 1.0, x[:, 1] > 0) + rng.normal(0, 0.2, n)
    rows = [(k, *[None if np.isnan(v) else float(v) for v in x[k]], float(y[k]), int(y[k] > 0.5), float(1 + k % 3), bool(k % 5)) for k in range(n)]
    return spark.createDataFrame(rows, "code long, a double, b double, c double, y double, up int, w double, is_train boolean").repartition(3), x


@pytest.mark.parametrize("goal, more", [("regression", {"bagging": 1.0, "features": 1.0}), ("regression", {"l1": 0.5, "l2": 1.0}), ("binary", {"l1": 0.1, "l2": 0.1, "bagging_rounds": 2})])
def test_trees_equal_those_of_the_plain_learner(spark, monkeypatch, goal, more):
    monkeypatch.setattr(boosting, "BLOCK", 50)
    monkeypatch.setattr(boosting, "SAVED", 2)
    o = Options(goal=goal, rounds=5, rate=0.3, leaves=7, least_rows=8, **more)
    df, _ = sample(spark)
    model = boosting.fit(df, ["a", "b", "c"], "y" if goal == "regression" else "up", o, weight="w", key=["code"])
    local = df.withColumn("_key", F.xxhash64("code")).orderBy("code").toPandas()
    codes = boosting.binned(local[["a", "b", "c"]].to_numpy(float), model.edges)
    label = local["y" if goal == "regression" else "up"].to_numpy(float)
    scores, late = plain_boost(codes, label, local["w"].to_numpy(), local["is_train"].to_numpy(), local["_key"].to_numpy(), model.start, o)
    assert np.allclose([x[1] for x in model.losses][: len(late)], late, rtol=1e-9)
    raw = model.raw(local[["a", "b", "c"]].to_numpy(float))
    assert len(model.trees) == int(np.argmin([x[1] for x in model.losses])) >= 3
    assert np.allclose(raw, scores[len(model.trees)], atol=1e-9)
    out = [r.score for r in model.score(df).orderBy("code").collect()]
    assert np.allclose(out, 1 / (1 + np.exp(-raw)) if goal == "binary" else raw)
    inner = sum(f >= 0 for t in model.trees for f in t.feature)
    assert sum(n for _, _, n in model.importance()) == inner > 0 and all(t.feature.count(-1) <= 7 for t in model.trees)


def test_it_stops_early_and_has_defined_edges(spark):
    df, _ = sample(spark)
    noise = df.withColumn("y", F.when(F.col("is_train"), F.rand(3)).otherwise(F.rand(4)))
    model = boosting.fit(noise, ["c"], "y", Options(rounds=60, rate=0.5, least_rows=2, patience=3), key=["code"])
    assert len(model.losses) <= 4 + int(np.argmin([x[1] for x in model.losses])) and len(model.losses) < 60
    flat = boosting.fit(df.withColumn("y", F.lit(2.0)), ["a", "b"], "y", Options(rounds=3))
    assert not flat.trees and {r.score for r in flat.score(df).collect()} == {2.0}
    empty = df.withColumn("a", F.lit(None).cast("double"))
    assert not boosting.fit(empty, ["a"], "y", Options(rounds=3)).trees
    with pytest.raises(ValueError):
        boosting.fit(df.where("false"), ["a"], "y")


DAY = dt.date(2020, 1, 1)


def panel(spark, seed=0, days=40, codes=12, after=None):
    """Rows whose label follows `a` with noise; after the day `after`, labels are drawn anew."""
    rng, other = np.random.default_rng(3), np.random.default_rng(seed)
    rows = []
    for t in range(days):
        for k in range(codes):
            a, y = float(rng.normal()), float(rng.normal())
            y = a + y / 5 if after is None or t <= after else float(other.normal())
            rows.append((k, DAY + dt.timedelta(t), a, float(k), y, int(y > 0)))
    return spark.createDataFrame(rows, "code long, time date, a double, b double, return_ratio double, class_label int")


def spans(spark):
    rows = [(w, DAY + dt.timedelta(4 * w), DAY + dt.timedelta(4 * w + 20), DAY + dt.timedelta(4 * w + 22)) for w in range(4)]
    return spark.createDataFrame(rows, "window_id int, start date, end date, test date")


def test_a_stopped_run_goes_on_where_it_was(spark, tmp_path, monkeypatch):
    folder, rows = str(tmp_path / "w"), panel(spark)
    seen, real = [], training.FITS["regression"]

    def failing(df, *rest, **options):
        k = df.first().window_id
        seen.append(k)
        if k == 2:
            raise RuntimeError("lost")
        return real(df, *rest, **options)

    monkeypatch.setitem(training.FITS, "regression", failing)
    with pytest.raises(RuntimeError):
        training.walk_forward_run(rows, spans(spark), ["a", "b"], folder=folder, rounds=2, workers=2, least_rows=5)
    done = {p.name for p in (tmp_path / "w/done").glob("window_id=*")}
    assert done and "window_id=2" not in done
    seen.clear()
    monkeypatch.setitem(training.FITS, "regression", lambda df, *rest, **options: (seen.append(df.first().window_id), real(df, *rest, **options))[1])
    built = training.walk_forward_run(rows, spans(spark), ["a", "b"], folder=folder, rounds=2, least_rows=5)
    assert sorted(f"window_id={k}" for k in seen) == sorted({f"window_id={k}" for k in range(4)} - done)
    assert {r.window_id: r.n for r in built["metrics"].collect()} == {k: 12 for k in range(4)}
    size = lambda df: len(df._jdf.queryExecution().analyzed().toString())
    fewer = training.walk_forward_run(rows, spans(spark).where("window_id < 2"), ["a", "b"], folder=str(tmp_path / "x"), rounds=2, least_rows=5)
    assert abs(size(fewer["metrics"]) - size(built["metrics"])) < 200


@pytest.mark.parametrize("kind", ["regression", "classifier"])
def test_labels_after_a_window_do_not_reach_its_scores(spark, tmp_path, kind):
    scores = []
    for seed in (1, 2):
        rows = panel(spark, seed, after=20)
        built = training.walk_forward_run(rows, spans(spark).where("window_id = 0"), ["a", "b"], kind, str(tmp_path / f"{kind}{seed}"), rounds=6, rate=0.3, least_rows=5)
        scores.append([(r.code, r.score) for r in built["portfolio"].orderBy("code").collect()])
        best = built["portfolio"].where("rank <= 3").agg(F.avg("a")).first()[0]
        assert best > 0.3  # the signal is found
    assert scores[0] == scores[1]
