"""Walk-forward training, scoring and ranking."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import div
from ..sources.io import existing, shared_folder
from .boosting import Boosted, Options, fit
from .evaluate import average_rank
from .panel import with_industry
from .xsection import dummies, zscore_many


def walk_forward(calendar: DataFrame, train: int, step: int, embargo: int = 1) -> DataFrame:
    """(window_id, start, end, test): training spans of `train` + 1 days, a test day `embargo` days on, every
    `step` days. Raises where the calendar is too short for one."""
    days = calendar.agg(F.max("t")).first()[0] or 0
    if train + embargo >= days:
        raise ValueError("the calendar is too short for a training window")
    at = calendar.select("t", "time")
    starts = at.where((F.col("t") - 1) % step == 0).where(F.col("t") + train + embargo <= days)
    out = starts.select((F.floor((F.col("t") - 1) / step)).cast("int").alias("window_id"), F.col("t").alias("first"), F.col("time").alias("start"))
    for name, shift in (("end", train), ("test", train + embargo)):
        out = out.join(F.broadcast(at.select((F.col("t") - shift).alias("first"), F.col("time").alias(name))), "first")
    return out.select("window_id", "start", "end", "test")


def time_split(rows: DataFrame, by: list[str], share: float = 0.8, time: str = "time") -> DataFrame:
    """Adds `is_train`: whether a row lies before the `share` quantile of its window's row times."""
    day = F.unix_date(time)
    cut = rows.groupBy(*by).agg(F.percentile(day, share).alias("_cut"))
    return rows.join(F.broadcast(cut), by).withColumn("is_train", day < F.col("_cut")).drop("_cut")  # one row per window


def standardized(train: DataFrame, columns: list[str]) -> dict[str, Column]:
    """The columns less their means and over their deviations, both those of the rows of `train`; a column that does not
    vary keeps its scale."""
    found = train.agg(*[F.avg(c).alias(f"m{k}") for k, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"d{k}") for k, c in enumerate(columns)]).first()
    return {c: (F.col(c) - F.lit(found[f"m{k}"])) / F.lit(found[f"d{k}"] or 1.0) for k, c in enumerate(columns)}


def fit_regression(rows: DataFrame, columns: list[str], label: str = "return_ratio", rounds: int = 1000, rate: float = 0.01, seed: int = 42, **options) -> tuple[Callable[[DataFrame], DataFrame], Boosted]:
    """Boosted trees on the rows of `is_train`, stopped early on the others; features are scaled on the
    training rows and the same scaling applies to every row scored. Returns (score function, model)."""
    scaled = standardized(rows.where("is_train"), columns)
    model = fit(rows.withColumns(scaled), columns, label, Options(rounds=rounds, rate=rate, seed=seed, **options), key=_keys(rows))
    return lambda df: model.score(df, inputs=scaled), model


def fit_classifier(rows: DataFrame, columns: list[str], label: str = "class_label", rounds: int = 1000, rate: float = 0.01, seed: int = 42, **options) -> tuple[Callable[[DataFrame], DataFrame], Boosted]:
    """Boosted trees for up or down with class weights n / (2 n_class). Returns (score function, model)."""
    counts = {r[0]: r[1] for r in rows.where("is_train").where(F.col(label).isNotNull()).groupBy(label).count().collect()}  # two classes
    weight = F.lit(1.0)
    for kind, n in counts.items():
        weight = F.when(F.col(label) == kind, sum(counts.values()) / (2.0 * n)).otherwise(weight)
    given = {"features": 0.8, "l1": 0.1, "l2": 0.1} | options
    model = fit(rows.withColumn("_balance", weight), columns, label, Options(goal="binary", rounds=rounds, rate=rate, seed=seed, **given), weight="_balance", key=_keys(rows))
    return model.score, model


def _keys(rows: DataFrame) -> list[str] | None:
    return ["code", "time"] if {"code", "time"} <= set(rows.columns) else None


FITS = {"regression": fit_regression, "classifier": fit_classifier}
IMPORTANCE = "feature string, importance double, splits long"


def train_windows(rows: DataFrame, spans: DataFrame, columns: list[str], kind: str, folder: str, workers: int = 4, time: str = "time", **options) -> None:
    """Trains and scores every window of `walk_forward` and writes it to `folder`: the scored rows of its test day, the
    importances, and last its span, which marks the window as done. Windows that are done are left alone, so a run that
    was stopped goes on where it was. `workers` windows run at a time, each in a scheduler pool of its own; `rows` are
    read once by each window, so they should be a written table, best in order of time."""
    spark = rows.sparkSession
    done = existing(spark, f"{folder}/done")
    have = set() if done is None else {r[0] for r in done.select("window_id").distinct().collect()}  # a row per window

    def train(span) -> None:
        k = span["window_id"]
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"window-{k}")
        own = rows.where(F.col(time).between(F.lit(span["start"]), F.lit(span["end"]))).withColumn("window_id", F.lit(k))
        cut = own.agg(F.percentile(F.unix_date(time), 0.8)).first()[0]  # as `time_split` has it, found once for all passes
        score, model = FITS[kind](own.withColumn("is_train", F.unix_date(time) < F.lit(cut)), columns, **options)
        test = rows.where(F.col(time) == F.lit(span["test"]))
        score(test).write.mode("overwrite").parquet(f"{folder}/scored/window_id={k}")
        spark.createDataFrame(model.importance(), IMPORTANCE).coalesce(1).write.mode("overwrite").parquet(f"{folder}/importance/window_id={k}")
        mark = [(span["start"], span["end"], span["test"], len(model.trees))]
        spark.createDataFrame(mark, "start date, end date, test date, rounds int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/done/window_id={k}")

    todo = [s for s in spans.orderBy("window_id").collect() if s["window_id"] not in have]  # a row per window
    with ThreadPoolExecutor(workers) as pool:
        list(pool.map(inheritable_thread_target(spark)(train), todo))


def walk_forward_run(rows: DataFrame, spans: DataFrame, columns: list[str], kind: str = "regression", folder: str | None = None, **options) -> dict[str, DataFrame]:
    """Trains and scores every window (`train_windows`): `portfolio` has the ranked test days, `importance` the features
    of each window by gain and number of splits, and `metrics` a row per window with its span, its rounds, its test day's
    metrics and its importances. The tables are read from `folder`, so their plans do not grow with the windows."""
    spark = rows.sparkSession
    folder = folder or f"{shared_folder(spark)}/windows-{uuid.uuid4().hex}"
    train_windows(rows, spans, columns, kind, folder, **options)
    read = lambda name: spark.read.option("basePath", f"{folder}/{name}").parquet(f"{folder}/{name}").withColumn("window_id", F.col("window_id").cast("int"))
    scored, importance, done = read("scored"), read("importance").select("window_id", "feature", "importance", "splits"), read("done")
    found = regression_metrics(scored, "return_ratio", "score", ["window_id"]) if kind == "regression" else class_metrics(scored, "class_label", "score", ["window_id"])
    listed = importance.groupBy("window_id").agg(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("splits")).alias("n"), (-F.col("importance")).alias("gain"), "feature"))), lambda x: F.struct(x.feature.alias("feature"), (-x.gain).alias("importance"), (-x.n).alias("splits"))).alias("importances"))
    metrics = done.join(found, "window_id", "left").join(listed, "window_id")
    return {"portfolio": rank_portfolio(scored), "importance": importance, "metrics": metrics.select("window_id", "start", "end", "test", "rounds", *[c for c in found.columns if c != "window_id"], "importances")}


def feature_importance(spark, model: Boosted) -> DataFrame:
    """(feature, importance, splits): gain and number of splits of each feature."""
    return spark.createDataFrame(model.importance(), IMPORTANCE)


def regression_metrics(rows: DataFrame, label: str, score: str, by: list[str]) -> DataFrame:
    """rmse and r2 over rows that have both."""
    rows = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    gap = F.col(label) - F.col(score)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sqrt(F.avg(gap * gap)).alias("rmse"), (1 - div(F.avg(gap * gap), F.var_pop(label))).alias("r2"))


def class_metrics(rows: DataFrame, label: str, score: str, by: list[str], cut: float = 0.5) -> DataFrame:
    """accuracy, f1 and the area under the ROC curve (by ranks with ties averaged)."""
    rows = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).withColumn("_rank", average_rank(score, by))
    truth, said = F.col(label) == 1, F.col(score) >= cut
    count = lambda c: F.sum(c.cast("long"))
    out = rows.groupBy(*by).agg(F.count("*").alias("n"), count(truth == said).alias("_right"), count(truth & said).alias("_tp"), count(said).alias("_said"), count(truth).alias("_pos"), F.sum(F.when(truth, F.col("_rank"))).alias("_ranks"))
    pos = F.col("_pos")
    return out.select(*by, "n", div(F.col("_right").cast("double"), F.col("n").cast("double")).alias("accuracy"), div(2.0 * F.col("_tp"), (F.col("_said") + pos).cast("double")).alias("f1"), div(F.col("_ranks") - pos * (pos + 1) / 2.0, (pos * (F.col("n") - pos)).cast("double")).alias("auc"))


def rank_portfolio(scored: DataFrame, score: str = "score", by: str = "time", top: int | None = None) -> DataFrame:
    """Adds `rank` by score, best first, per date; the first `top` only, if given."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last(score), "code")))
    return out if top is None else out.where(F.col("rank") <= top)


def training_table(descriptors: DataFrame, columns: list[str], industry: DataFrame, values: list[str], labelled: DataFrame) -> DataFrame:
    """Z-scored descriptors and industry dummies with labels: code, time, columns, dummies, country, label columns.
    The industry is that of the code, or of the day if the industry table varies in time."""
    rows = dummies(with_industry(descriptors.select("code", "time", *columns), industry, how="left"), "L1", values)
    inputs = [*columns, *[f"L1_{v}" for v in values], "country"]
    known = labelled.select("code", "time", "close", "close_future", "return_ratio", "class_label")
    return zscore_many(rows.drop("L1").join(known, ["code", "time"], "left"), inputs)
