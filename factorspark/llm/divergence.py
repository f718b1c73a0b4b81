"""Divergence of the sources of a language from each other and from the language (operator 12).

Terms are counted where the texts lie. A slice's terms are packed by length: up to 8 bytes are one big-endian 64-bit
word, up to 16 bytes two, and longer terms go to buckets whose width is the next power of two, as byte strings. Words
are put in order by a stable radix sort on 16-bit digits, byte strings by numpy's own sort; runs of equal terms give
the occurrences and the documents of each (source, term). Spark sums those over the table.

Sums over all kept terms of a pair of sources never visit terms that neither has. With f symmetric, p0 the share of an
absent term and V the number of kept terms,

    sum(a, b) = V f(p0a, p0b) + h(a, b) + h(b, a) + sum over terms of both of
                f(pa, pb) - f(pa, p0b) - f(p0a, pb) + f(p0a, p0b)
    h(a, b)   = sum over terms of a of f(pa, p0b) - f(p0a, p0b), by the distinct counts of a.

The last sum is made in tasks that have all sources of a term; they return sums per pair, not pairs per term.

Defined results: NULL text, lang and source are ''; each row is a document, whatever its id; a lang without kept terms
has pairs of value 0 and no terms; a lang with one source has no pairs; an empty table gives no rows. Counts may reach
9 * 10^15 in all before a share's arithmetic leaves 64 bits. Other columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .arrays import U64, lower_ascii, ragged, slices, utf8, word_spans
from .graph import checkpointed, whole_groups, with_ids

SLICE = 1 << 23
_TERM = np.zeros(256, bool)
_TERM[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def radix_order(words: list[np.ndarray]) -> np.ndarray:
    """Stable ascending order of rows of unsigned words, the most significant word first."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 8 * word.itemsize, 16):
            digit = (word >> word.dtype.type(shift)).astype(np.uint16)
            if digit.min() != digit.max():  # one value needs no pass
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _packed(data: np.ndarray, start: np.ndarray, size: np.ndarray, words: int) -> list[np.ndarray]:
    """Terms of up to 8 * words bytes as big-endian words, filled up with zero bytes (which no term has)."""
    raw = np.concatenate((data, np.zeros(8 * words, np.uint8)))
    chunks = np.ndarray(len(raw) - 7, ">u8", raw, 0, (1,))
    out = []
    for k in range(words):
        spare = U64(8) * np.clip(8 * (k + 1) - size, 0, 7).astype(U64)
        out.append((chunks[start + 8 * k].astype(U64) >> spare) << spare)
    return out


def _strings(data: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    out = np.zeros((len(start), width), np.uint8)
    out.reshape(-1)[ragged(np.arange(len(start)) * width, size)] = data[ragged(start, size)]
    return out.reshape(-1).view(f"S{width}")


def term_runs(data: np.ndarray, offsets: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(group, start, end, count, docs) of each distinct (group of the row, term) of a lower-cased slice; start and end
    are those of one occurrence."""
    start, end, row = word_spans(data, offsets, _TERM)
    order = radix_order([group[row].astype(np.uint32)]) if len(row) else row
    start, end, row = start[order], end[order], row[order]  # by group, then row
    size = end - start
    found = []
    wide = np.where(size <= 8, 1, np.where(size <= 16, 2, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)))
    for width in np.unique(wide).tolist():
        at = np.flatnonzero(wide == width)
        if width <= 2:
            words = _packed(data, start[at], size[at], width)
            order = radix_order(words)
            words = [w[order] for w in words]
        else:
            term = _strings(data, start[at], size[at], width)
            order = np.argsort(term, kind="stable")
            words = [term[order]]
        at = at[order]
        rows, groups = row[at], group[row[at]]
        fresh = np.ones(len(at), bool)
        fresh[1:] = groups[1:] != groups[:-1]
        for w in words:
            fresh[1:] |= w[1:] != w[:-1]
        doc = fresh.copy()
        doc[1:] |= rows[1:] != rows[:-1]
        first = np.flatnonzero(fresh)
        found.append((groups[first], start[at[first]], end[at[first]], np.diff(np.append(first, len(at))), np.add.reduceat(doc.astype(np.int64), first)))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (row,) * 5


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text", SLICE):
        lang, source = part.column("lang").dictionary_encode(), part.column("source").dictionary_encode()
        own = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
        kinds, group = np.unique(own, return_inverse=True)
        data, offsets = utf8(part.column("text"))
        data = lower_ascii(data)
        group, start, end, count, docs = term_runs(data, offsets, group)
        size = end - start
        ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        term = pa.Array.from_buffers(pa.string(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[ragged(start, size)]) if len(size) else b"")])
        at = kinds[group]
        yield pa.RecordBatch.from_arrays(
            [lang.dictionary.take(pa.array(at // len(source.dictionary))), source.dictionary.take(pa.array(at % len(source.dictionary))), term, pa.array(count, pa.int64()), pa.array(docs, pa.int64())],
            names=["lang", "source", "term", "count", "docs"],
        )


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the terms of two sources add to the pair's sum over what each adds alone."""
    for table in whole_groups(batches, ["lang", "term"], 1 << 16):
        table = table.combine_chunks()
        lang, term, source = (table[c].combine_chunks().dictionary_encode() for c in ("lang", "term", "source"))
        own = np.stack((lang.indices.to_numpy(), term.indices.to_numpy()))
        code, share, none = source.indices.to_numpy().astype(np.int64), table["p"].to_numpy(), table["p0"].to_numpy()
        pairs, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for apart in range(1, len(code)):
            a = np.flatnonzero((own[:, apart:] == own[:, :-apart]).all(0))
            if not len(a):
                break
            b = a + apart
            value = _apart(share[a], share[b]) - _apart(share[a], none[b]) - _apart(none[a], share[b]) + _apart(none[a], none[b])
            key, at = np.unique((own[0][a] * len(source.dictionary) + code[a]) * len(source.dictionary) + code[b], return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, at, value)
            pairs.append(key)
            values.append(total)
        key, at = np.unique(np.concatenate(pairs), return_inverse=True)
        total = np.zeros(len(key), np.int64)
        np.add.at(total, at, np.concatenate(values))
        n = len(source.dictionary)
        yield pa.RecordBatch.from_arrays([lang.dictionary.take(pa.array(key // (n * n))), source.dictionary.take(pa.array(key // n % n)), source.dictionary.take(pa.array(key % n)), pa.array(total)], names=["lang", "source", "item", "value"])


def _whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(count: Column, total: Column, kinds: Column) -> Column:
    """1 + floor(10^9 (count + 2) / (total + 2 kinds)), three digits at a time, so that nothing leaves 64 bits."""
    low = F.greatest(total + 2 * kinds, F.lit(1))
    left, out = count + 2, F.lit(0).cast("long")
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + _whole(left, low), left % low
    return out + 1


def distance(p: Column, q: Column) -> Column:
    return _whole((p - q) * (p - q), p + q)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences and documents of every term, lower-cased in A-Z."""
    texts = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    found = texts.mapInArrow(_runs, "lang string, source string, term string, count long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def source_divergence(docs: DataFrame, least: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance of every pair of sources of a language (part `pair`), and
    the `top` terms that a source has more of than its language (part `term`). Terms of fewer than `least` documents of
    the language are left out."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    word = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"whole": F.sum("count").over(word), "_docs": F.sum("docs").over(word), "head": F.min("source").over(word) == F.col("source")})
    kept = checkpointed(counts.where(F.col("_docs") >= least).drop("_docs", "docs"))
    groups = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct()
    own = kept.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    langs = kept.where("head").groupBy("lang").agg(F.count("*").alias("kinds"), F.sum("whole").alias("all"))
    sizes = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "kinds", "all"])
    sizes = checkpointed(sizes.withColumn("p0", share(F.lit(0).cast("long"), F.col("total"), F.col("kinds"))))
    rows = with_ids(kept, sizes, ["lang", "source"], "inner").withColumn("p", share(F.col("count"), F.col("total"), F.col("kinds")))

    rank = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = rows.withColumn("q", share(F.col("whole"), F.col("all"), F.col("kinds"))).where("p > q")
    terms = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value")).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top)

    other = sizes.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    beside = lambda df: with_ids(df, other, "lang", "inner").where("source <> item")  # noqa: E731  pairs of sources, as the result has them
    none = distance(F.col("p0"), F.col("q0"))
    absent = beside(sizes).select("lang", "source", "item", (F.col("kinds") * none).alias("value"))
    alone = rows.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("n"))
    alone = beside(alone).groupBy("lang", "source", "item").agg(F.sum(F.col("n") * (distance(F.col("p"), F.col("q0")) - none)).alias("value"))
    both = rows.select("lang", "term", "source", "p", "p0").repartition(n, "lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_shared, "lang string, source string, item string, value long")
    turned = alone.unionByName(both)
    turned = turned.unionByName(turned.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    pairs = absent.unionByName(turned).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(rank))
    return pairs.unionByName(terms)
