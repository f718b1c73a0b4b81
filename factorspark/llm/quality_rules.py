"""Quality filter by learned decision lists (operator 7).

`text_stats` takes whole-text statistics. `learn_rules` covers the documents labelled 0 one rule after
another: a rule grows threshold by threshold on two thirds of the sample while the information gain rises,
and is pruned on the rest; covering ends when a new rule is right in under `precision` of what it covers.
The list becomes one ordered chain of Spark conditionals (`as_column`) that can be read and edited.

Defined results: NULL texts count as empty; a document without words has zero statistics; NaN cannot
occur, as all ratios divide by at least 1. Lines and windows of words are compared by 64-bit hashes that are
no polynomial (`arrays.span_hash`). The labelled sample is bounded by `most` documents, chosen by a hash of
the id, one row per id. With no labels of either class the list is empty and keeps all. Rows are judged one
by one, also where they share an id or have none; other columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrays import Words, distinct, mix, slices, span_hash, utf8
from .graph import checkpointed

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_chars", "n_upper", "n_digits", "n_marks", "n_distinct")
SYMBOLS = b"#*$%&|<>"
MARKS = b"!?=~^+@/\\_"
# What rules may test: a count, or a ratio of two.
FEATURES = (("n_words", None), ("word_chars", "n_words"), ("n_symbols", "n_words"), ("n_dup_lines", "n_lines"), ("n_repeat_words", "n_words"), ("n_upper", "n_chars"), ("n_digits", "n_chars"), ("n_marks", "n_words"), ("n_distinct", "n_words"))


def _has(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(characters, np.uint8)] = True
    return table


_SYMBOL, _MARK = _has(SYMBOLS), _has(MARKS)
_UPPER, _DIGIT = _has(bytes(range(65, 91))), _has(bytes(range(48, 58)))


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        data, offsets = utf8(part.column("text"))
        rows = part.num_rows
        words = Words(data, offsets)
        each = lambda row: np.bincount(row, minlength=rows).astype(np.int64)
        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        total = lambda table: np.diff(np.concatenate(([0], np.cumsum(table[data])))[offsets])
        word_chars = np.bincount(words.row, points[words.end] - points[words.start], rows).astype(np.int64)
        # lines that have a word
        cut = np.concatenate((offsets[:-1], np.flatnonzero(data == 10) + 1))
        start = np.unique(cut[cut < len(data)]) if len(data) else np.zeros(0, np.int64)
        line_row = np.searchsorted(offsets, start, "right") - 1
        follow = np.concatenate((start[1:], [len(data)]))[: len(start)]
        end = np.minimum(follow, offsets[line_row + 1])
        end = end - ((end > start) & (data[np.maximum(end - 1, 0)] == 10)) if len(start) else end
        full = np.searchsorted(words.start, end) > np.searchsorted(words.start, start)
        line_row, value = line_row[full], span_hash(data, start[full], end[full])
        n_lines = each(line_row)
        n_dup_lines = n_lines - each(distinct(line_row, value)[0])
        # words in windows of three that occur again in the text
        n = len(words.hash)
        repeated = np.zeros(n, bool)
        at = np.flatnonzero(words.row[2:] == words.row[:-2]) if n > 2 else np.zeros(0, np.int64)
        if len(at):
            window = mix(mix(mix(words.hash[at]) + words.hash[at + 1]) + words.hash[at + 2])
            order = np.lexsort((window, words.row[at]))
            same = (window[order][1:] == window[order][:-1]) & (words.row[at][order][1:] == words.row[at][order][:-1])
            again = np.zeros(len(at), bool)
            again[order[1:][same]] = True
            again[order[:-1][same]] = True
            for j in range(3):
                repeated[at[again] + j] = True
        columns = (each(words.row), word_chars, total(_SYMBOL), n_dup_lines, each(words.row[repeated]), n_lines, np.diff(points[offsets]), total(_UPPER), total(_DIGIT), total(_MARK), each(distinct(words.row, words.hash)[0]))
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c.astype(np.int64)) for c in columns]], names=["doc_id", *COUNTS])


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the whole-text counts COUNTS of every document."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_stats, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))


def feature(name: int) -> Column:
    top, bottom = FEATURES[name]
    return F.col(top).cast("double") if bottom is None else F.col(top) / F.greatest(F.col(bottom), F.lit(1))


@dataclass(frozen=True)
class Test:
    feature: int
    above: bool
    threshold: float

    def holds(self, x: np.ndarray) -> np.ndarray:
        value = x[:, self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def column(self) -> Column:
        return feature(self.feature) > self.threshold if self.above else feature(self.feature) <= self.threshold


Rule = tuple[Test, ...]


def _covers(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for test in rule:
        out &= test.holds(x)
    return out


def _cuts(value: np.ndarray, steps: int) -> np.ndarray:
    """Thresholds half way between neighbouring values, at about `steps` quantiles."""
    values = np.unique(value)
    at = np.unique(np.searchsorted(values, np.quantile(value, np.linspace(0, 1, steps), method="lower")))
    at = at[at + 1 < len(values)]
    return (values[at] + values[at + 1]) / 2


def _grow(x: np.ndarray, bad: np.ndarray, steps: int = 24) -> Rule:
    """Adds the test with the largest gain until the rule covers none of the others."""
    rule, inside = (), np.ones(len(x), bool)
    while len(rule) < 4:
        p0, n0 = (bad & inside).sum(), inside.sum()
        if not p0 or p0 == n0:
            break
        best, gain = None, 1e-9
        for f in range(x.shape[1]):
            for t in _cuts(x[inside, f], steps):
                for above in (True, False):
                    test = Test(f, above, float(t))
                    held = inside & test.holds(x)
                    p, n = (bad & held).sum(), held.sum()
                    if p and (g := p * (np.log2(p / n) - np.log2(p0 / n0))) > gain:
                        best, gain = test, g
        if best is None:
            break
        rule, inside = (*rule, best), inside & best.holds(x)
    return rule


def learn_rules(x: np.ndarray, bad: np.ndarray, precision: float = 0.9, support: int = 5, most: int = 12) -> list[Rule]:
    """An ordered list of rules whose documents are bad; what no rule covers is good."""
    turn = np.arange(len(x)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < most and (bad & left).any():
        rule = _grow(x[left & ~turn], bad[left & ~turn])
        worth = lambda r: (lambda c: ((bad & c).sum() - (~bad & c).sum()) / max(1, c.sum()))(_covers(r, x) & left & turn)
        rule = max((rule[:n] for n in range(len(rule), 0, -1)), key=worth, default=())
        held = _covers(rule, x) & left
        if not rule or held.sum() < support or (bad & held).sum() < precision * held.sum():
            break
        rules.append(rule)
        left &= ~held
    return rules


def as_column(rules: list[Rule]) -> Column:
    """The list as one ordered conditional: false for the documents of a rule, else true."""
    out = F.lit(True)
    for rule in reversed(rules):
        test = F.lit(True)
        for t in rule:
            test = test & t.column()
        out = F.when(test, F.lit(False)).otherwise(out)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, label) of at most `most` labelled documents, chosen by a hash of the id: one row per id,
    with the largest of its labels and the least of its texts (NULL first)."""
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    return checkpointed(rows.groupBy("doc_id").agg(F.min(F.struct("text", "label")).alias("one")).select("doc_id", "one.text", "one.label"))


def quality_verdicts(docs: DataFrame, labels: DataFrame, base: Column, most: int = 20_000) -> DataFrame:
    """doc_id, COUNTS and `good`: the verdict of a list learned from `labels` (doc_id, quality) on the
    labelled documents of which `base` does not hold; at most `most` labelled documents are read."""
    sample = labelled_sample(docs, labels, "quality", most)
    kept = text_stats(sample).join(sample.select("doc_id", "label"), "doc_id").where(~base)
    rows = kept.select("doc_id", *[feature(f).alias(f"f{f}") for f in range(len(FEATURES))], "label").distinct().orderBy("doc_id").toPandas()
    x = rows[[f"f{f}" for f in range(len(FEATURES))]].to_numpy(float)
    rules = learn_rules(x, rows["label"].to_numpy() == 0) if len(rows) else []
    return text_stats(docs).withColumn("good", as_column(rules))
