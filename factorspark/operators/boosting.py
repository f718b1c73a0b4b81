"""Boosted trees grown leaf by leaf from gradient histograms that Spark sums.

Rows are binned once, by quantiles of the training rows, and packed into blocks of up to BLOCK rows: a matrix of one byte
per feature, feature by feature, beside labels, weights and scores. A pass over the blocks sums first and second derivatives and rows by
(node, feature, bin) for all nodes whose split is not known yet; tasks send one histogram per node and feature, Spark
deals them out by node and feature, and a task returns the best split of each of its own. The driver gets a row per node
and feature and keeps the tree.

Growth is by the best gain of all leaves. Which leaf is next can depend on children that are not summed yet, so a pass
sums the children of every leaf that could be split before the tree has `leaves` leaves; what turns out not to be
needed is left out. A tree takes about as many passes as it is deep, and equals one that is grown split by split.

Scores are brought up to date and checkpointed every SAVED rounds; between, the trees since then are applied in
each pass, so neither lineage nor work per pass grows with the rounds.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.io import shared_folder

BLOCK, SAVED = 1 << 16, 16
BINS, MISSING = 256, 255  # the last bin holds NULL and NaN
_BLOCKS = "n int, codes binary, label binary, weight binary, train binary, key binary, score binary"
_SPLITS = "node int, feature int, gain double, bin int, missing_left boolean, sums array<double>"


@dataclass(frozen=True)
class Options:
    """Settings of a learner; `goal` is `regression` (squares) or `binary` (logistic loss)."""

    goal: str = "regression"
    rounds: int = 1000
    rate: float = 0.01
    leaves: int = 31
    least_rows: int = 20
    least_hessian: float = 1e-3
    l1: float = 0.0
    l2: float = 0.0
    features: float = 0.9
    bagging: float = 0.8
    bagging_rounds: int = 5
    patience: int = 50
    seed: int = 42


@dataclass
class Tree:
    """Node k splits on `feature[k]` at `bin[k]` into `left[k]` and `right[k]`, or has the value `value[k]`."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, empty in ((self.feature, -1), (self.bin, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, 0.0), (self.gain, 0.0)):
            column.append(empty)
        return len(self.feature) - 1

    def leaf(self, codes: np.ndarray) -> np.ndarray:
        """The node where each row of bins ends."""
        node = np.zeros(len(codes), np.int32)
        todo = [(0, np.arange(len(codes)))] if self.feature else []
        while todo:
            k, at = todo.pop()
            node[at] = k
            if self.feature[k] >= 0:
                own = codes[at, self.feature[k]]
                left = np.where(own == MISSING, self.missing_left[k], own <= self.bin[k])
                todo += [(self.left[k], at[left]), (self.right[k], at[~left])]
        return node

    def predict(self, codes: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.leaf(codes)]


@dataclass
class Boosted:
    """A model: trees over bins, the bins' upper edges by feature, and the start of the scores."""

    columns: list[str]
    edges: list[np.ndarray]
    start: float
    options: Options
    trees: list[Tree] = field(default_factory=list)
    losses: list[tuple[float, float]] = field(default_factory=list)  # of training and validation rows before each round

    def raw(self, values: np.ndarray) -> np.ndarray:
        codes = binned(values, self.edges)
        return sum((t.predict(codes) for t in self.trees), np.full(len(codes), self.start))

    def score(self, df: DataFrame, name: str = "score", inputs: dict[str, Column] | None = None) -> DataFrame:
        """Adds the prediction, or the probability of label 1; `inputs` are expressions that stand for columns."""
        given = inputs or {}
        model = self

        @F.pandas_udf("double")
        def predicted(*columns: pd.Series) -> pd.Series:
            raw = model.raw(np.stack([c.to_numpy(float) for c in columns], 1))
            return pd.Series(1 / (1 + np.exp(-raw)) if model.options.goal == "binary" else raw)

        return df.withColumn(name, predicted(*[given.get(c, F.col(c)).cast("double") for c in self.columns]))

    def importance(self) -> list[tuple[str, float, int]]:
        """(feature, gain, splits), most splits first."""
        gain, splits = np.zeros(len(self.columns)), np.zeros(len(self.columns), int)
        for tree in self.trees:
            for f, g in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    gain[f] += g
                    splits[f] += 1
        return sorted(zip(self.columns, gain.tolist(), splits.tolist(), strict=True), key=lambda r: (-r[2], -r[1], r[0]))


def bin_edges(rows: DataFrame, columns: list[str], error: float = 1e-3) -> list[np.ndarray]:
    """Upper edges of up to MISSING bins of each column, by approximate quantiles."""
    finite = [F.when(F.isnan(c), None).otherwise(F.col(c).cast("double")).alias(c) for c in columns]
    found = rows.select(*finite).approxQuantile(columns, [k / MISSING for k in range(1, MISSING)], error)
    return [np.unique(np.array(x, float)) for x in found]


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    codes = np.empty(values.shape, np.uint8, order="F")  # a feature's bins stand together
    for k, own in enumerate(edges):
        codes[:, k] = np.where(np.isnan(values[:, k]), MISSING, np.searchsorted(own, values[:, k], "left"))
    return codes


def _pack(columns: list[str], edges: list[np.ndarray], start: float):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def block(table: pa.Table) -> pa.RecordBatch:
            plain = lambda c, kind: table[c].to_pandas().to_numpy(kind)
            codes = binned(np.stack([plain(c, float) for c in columns], 1), edges)
            parts = (codes, plain("_label", float), plain("_weight", float), plain("_train", np.uint8), plain("_key", np.int64), np.full(len(codes), start))
            return pa.RecordBatch.from_arrays([pa.array([len(codes)], pa.int32()), *[pa.array([x.T.tobytes()], pa.binary()) for x in parts]], names=[c.split()[0] for c in _BLOCKS.split(", ")])

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            while size >= BLOCK:
                table = pa.Table.from_batches(held)
                yield block(table.slice(0, BLOCK))
                held, size = table.slice(BLOCK).to_batches(), size - BLOCK
        if size:
            yield block(pa.Table.from_batches(held))

    return pack


def _unpack(batch: pa.RecordBatch, k: int) -> list[np.ndarray]:
    n = batch.column("n")[k].as_py()
    codes, *rest = (np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in (("codes", np.uint8), ("label", float), ("weight", float), ("train", np.uint8), ("key", np.int64), ("score", float)))
    return [codes.reshape(-1, n).T if n else codes.reshape(0, 1), *rest]


def derivatives(goal: str, label: np.ndarray, weight: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and second derivatives of the loss by the score, and the loss."""
    if goal == "binary":
        p = 1 / (1 + np.exp(-score))
        return weight * (p - label), weight * p * (1 - p), weight * (np.logaddexp(0, score) - label * score)
    return weight * (score - label), weight, weight * (score - label) ** 2


def in_bag(key: np.ndarray, turn: int, share: float, seed: int) -> np.ndarray:
    """Which rows a bag holds, by their keys."""
    x = key.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + turn * 0xBF58476D1CE4E5B9) % (1 << 64))
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return (x >> np.uint64(11)) < np.uint64(share * (1 << 53))


def histograms(codes: np.ndarray, place: np.ndarray, nodes: int, features: list[int], g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Sums (node, feature, g / h / rows, bin); rows of place -1 are left out."""
    out = np.zeros((nodes, len(features), 3, BINS))
    at = np.flatnonzero(place >= 0)
    place, g, h = place[at].astype(np.int64) * BINS, g[at], h[at]
    for j, f in enumerate(features):
        own = place + codes[at, f]
        for k, w in enumerate((g, h, None)):
            out[:, j, k] = np.bincount(own, w, nodes * BINS).reshape(nodes, BINS)
    return out


def strength(g, h, l1: float, l2: float):
    """What a leaf gains: the square of the sum of g, less l1, over that of h and l2."""
    return np.maximum(np.abs(g) - l1, 0) ** 2 / (h + l2)


def best_split(sums: np.ndarray, o: Options) -> tuple[float, int, bool, list[float]] | None:
    """(gain, bin, whether missing values go left, sums left and right) of a histogram (3, BINS), the first of the best."""
    whole = sums.sum(1)
    best = None
    for missing_left in (True, False):
        left = np.cumsum(sums[:, :MISSING], 1) + (sums[:, MISSING:] if missing_left else 0)
        right = whole[:, None] - left
        ok = (left[2] >= o.least_rows) & (right[2] >= o.least_rows) & (left[1] >= o.least_hessian) & (right[1] >= o.least_hessian)
        if ok.any():
            gain = np.where(ok, strength(left[0], np.where(ok, left[1], 1), o.l1, o.l2) + strength(right[0], np.where(ok, right[1], 1), o.l1, o.l2), -np.inf)
            k = int(np.argmax(gain))
            value = float(gain[k] - strength(whole[0], whole[1], o.l1, o.l2))
            if value > 0 and (best is None or value > best[0]):
                best = (value, k, missing_left, [*left[:, k].tolist(), *right[:, k].tolist()])
        if not sums[2, MISSING]:
            break
    return best


def _pass(tree: Tree, nodes: list[int], features: list[int], recent: list[Tree], turn: int, o: Options):
    """Histograms of `nodes` over a task's blocks, and in the first pass of a tree the losses."""

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, loss, any_row = np.zeros((len(nodes), len(features), 3, BINS)), np.zeros(4), False
        where = np.full(len(tree.feature), -1, np.int32)
        where[nodes] = np.arange(len(nodes))
        for batch in batches:
            for k in range(batch.num_rows):
                codes, label, weight, train, key, score = _unpack(batch, k)
                score = sum((t.predict(codes) for t in recent), score)
                g, h, lost = derivatives(o.goal, label, weight, score)
                late = train == 0
                loss += (lost[~late].sum(), weight[~late].sum(), lost[late].sum(), weight[late].sum())
                place = where[tree.leaf(codes)]
                place[late | (~in_bag(key, turn, o.bagging, o.seed) if o.bagging < 1 else False)] = -1
                total += histograms(codes, place, len(nodes), features, g, h)
                any_row = True
        if any_row:
            ids = [(n, f, total[i, j].tobytes()) for i, n in enumerate(nodes) for j, f in enumerate(features)]
            ids += [(-1, -1, loss.tobytes())] if nodes == [0] else []
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in ids], pa.int32()), pa.array([x[1] for x in ids], pa.int32()), pa.array([x[2] for x in ids], pa.binary())], names=["node", "feature", "sums"])

    return passed


def _best(o: Options):
    schema = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("gain", pa.float64()), ("bin", pa.int32()), ("missing_left", pa.bool_()), ("sums", pa.list_(pa.float64()))])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best split of each node and feature of a partition, which has all their histograms."""
        parts: dict[tuple[int, int], list[bytes]] = {}
        for batch in batches:
            for node, feature, sums in zip(*(batch.column(c).to_pylist() for c in ("node", "feature", "sums")), strict=True):
                parts.setdefault((node, feature), []).append(sums)
        rows = []
        for (node, feature), own in parts.items():
            total = sum(np.frombuffer(x, float) for x in sorted(own))  # sums do not depend on the order of the tasks
            found = (0.0, 0, False, total.tolist()) if node < 0 else best_split(total.reshape(3, BINS), o)
            if found is not None:
                rows.append({"node": node, "feature": feature, "gain": found[0], "bin": found[1], "missing_left": found[2], "sums": found[3]})
        yield pa.RecordBatch.from_pylist(rows, schema)

    return best


def grow(splits: Callable[[Tree, list[int]], dict[int, tuple]], o: Options) -> Tree:
    """A tree by best gain. `splits` gives the best (gain, feature, bin, missing left, sums) of nodes of a tree, if any."""
    made, known, sums = Tree(), {}, {}
    wanted = [made.add()]
    while wanted:
        found = splits(made, wanted)
        for k in wanted:
            known[k] = found.get(k)
        chosen, wanted = [], []
        heap = [(-known[0][0], 0)] if known[0] else []
        leaves, sure = 1, True
        while heap and leaves < o.leaves:
            _, k = heapq.heappop(heap)
            leaves += 1
            if made.left[k] < 0:
                gain, feature, at, missing, parts = known[k]
                made.feature[k], made.bin[k], made.missing_left[k], made.gain[k] = feature, at, missing, gain
                made.left[k], made.right[k] = made.add(), made.add()
                for child, own in ((made.left[k], parts[:3]), (made.right[k], parts[3:])):
                    sums[child] = own
                    if own[2] < 2 * o.least_rows or own[1] < 2 * o.least_hessian:
                        known[child] = None  # too small for a split
            chosen.append(k)
            for child in (made.left[k], made.right[k]):
                if child not in known:
                    wanted.append(child)
                    sure = False
                elif known[child]:
                    heapq.heappush(heap, (-known[child][0], child))
        if sure:
            break
    if not known[0]:
        return Tree()
    out, todo = Tree(), [(0, None, None)]
    kept = set(chosen)
    while todo:
        k, parent, side = todo.pop()
        own = out.add()
        if parent is not None:
            (out.left if side else out.right)[parent] = own
        if k in kept:
            out.feature[own], out.bin[own], out.missing_left[own], out.gain[own] = made.feature[k], made.bin[k], made.missing_left[k], made.gain[k]
            todo += [(made.right[k], own, False), (made.left[k], own, True)]
        else:
            g, h, _ = sums[k]
            out.value[own] = -o.rate * math.copysign(max(abs(g) - o.l1, 0), g) / (h + o.l2)
    return out


def _saved(blocks: DataFrame, trees: list[Tree]) -> DataFrame:
    """Blocks with the scores after `trees`."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = []
            for k in range(batch.num_rows):
                codes, *_, score = _unpack(batch, k)
                scores.append(sum((t.predict(codes) for t in trees), score).tobytes())
            yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(scores, pa.binary()))

    return blocks.mapInArrow(add, _BLOCKS).checkpoint()


def fit(rows: DataFrame, columns: list[str], label: str, o: Options = Options(), weight: str | None = None, train: str = "is_train", key: list[str] | None = None) -> Boosted:
    """Trains on the rows of `train` with a label and stops where the loss of the other ones has not fallen for `patience`
    rounds; the model keeps the rounds up to the lowest. `key` names the columns by which rows are bagged, all by default.
    NULL and NaN features are a bin of their own, which goes to the better side of each split."""
    spark = rows.sparkSession
    shared_folder(spark)
    named = [F.col(label).cast("double").alias("_label"), (F.lit(1.0) if weight is None else F.col(weight).cast("double")).alias("_weight"), F.col(train).cast("int").alias("_train"), F.xxhash64(*(key or rows.columns)).alias("_key")]
    rows = rows.where(F.col(label).isNotNull() & F.col(train).isNotNull()).select(*[F.col(c).cast("double").alias(c) for c in columns], *named)
    early = rows.where("_train = 1")
    of_early = lambda c: F.sum(F.when(F.col("_train") == 1, c))
    every, n, total, known = rows.agg(F.count("*"), F.count_if(F.col("_train") == 1), of_early(F.col("_weight") * F.col("_label")), of_early(F.col("_weight"))).first()
    if not n:
        raise ValueError("no training rows with a label")
    mean = total / known
    start = mean if o.goal == "regression" else math.log(max(mean, 1e-15) / max(1 - mean, 1e-15))
    model = Boosted(columns, bin_edges(early, columns), start, o)
    parts = -(-every // BLOCK)
    blocks = rows.repartition(parts, "_key").mapInArrow(_pack(columns, model.edges, start), _BLOCKS).checkpoint()
    rng = np.random.default_rng(o.seed)
    recent: list[Tree] = []
    best, best_at = math.inf, 0
    for k in range(o.rounds + 1):
        features = sorted(rng.permutation(len(columns))[: max(1, math.ceil(o.features * len(columns)))].tolist())
        loss: list[float] = []

        def splits(tree: Tree, nodes: list[int], features=features, turn=k // o.bagging_rounds, loss=loss) -> dict[int, tuple]:
            found = blocks.mapInArrow(_pass(tree, nodes, features, recent, turn, o), "node int, feature int, sums binary").repartition("node", "feature").mapInArrow(_best(o), _SPLITS).collect()
            out: dict[int, tuple] = {}
            for r in sorted(found, key=lambda r: (r["node"], r["feature"])):
                if r["node"] < 0:
                    loss[:] = r["sums"]
                elif r["node"] not in out or r["gain"] > out[r["node"]][0]:
                    out[r["node"]] = (r["gain"], r["feature"], r["bin"], r["missing_left"], r["sums"])
            return out

        tree = grow(splits, o)
        mine, late = loss[0] / loss[1], loss[2] / loss[3] if loss[3] else loss[0] / loss[1]
        model.losses.append((mine, late))
        if late < best:
            best, best_at = late, k
        if k == o.rounds or k - best_at >= o.patience or not tree.feature:
            break
        model.trees.append(tree)
        recent.append(tree)
        if len(recent) == SAVED:
            blocks, recent = _saved(blocks, recent), []
    model.trees = model.trees[:best_at] if loss[3] else model.trees
    return model
