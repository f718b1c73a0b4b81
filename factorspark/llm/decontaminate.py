"""Benchmark decontamination by spaced seeds (operator 9).

Texts are lower-cased (A-Z) and cut into words at ASCII white space. A document is contaminated by an item if,
on one shift between the two texts, at least four in five of all the item's words are equal, or `words` words
or more are equal in a stretch of the item in which four in five words are equal. So one substitution in five
is tolerated, wherever it stands; items of fewer than five words have to be there whole.

Each fixed mask picks some words of a row of words and ignores the others, so that a substituted word at an
ignored place leaves the hash equal. The masks of SPAN words ignore any two places, and every match of an
item of SPAN words or more has SPAN words in a row with at most two substitutions, but for one case at 15 words
that has a mask of its own. Shorter items have masks of their own length that ignore each place in turn.
Benchmark seeds are looked up at every position of every document; a hit names an item and the shift, and
there the words are compared one by one.

Seeds of the benchmark stay a table. What every task of the documents gets of it is a Bloom filter of at most
2^FILTER_BITS bits, whatever the size of the benchmark; where the filter is full, more places of the documents pass it
and nothing is lost. Places that pass are joined with the benchmark's seeds by hash, in one pass over the documents
for any benchmark, and each (text, item, shift) comes to its text once: texts and their candidates are streamed side
by side, sorted, and a text of over PART_PLACES candidates is dealt to several tasks. Equal texts are judged once.

NULL and empty texts are clean, and items without words are in no document. An item with a NULL id is named NULL. Rows
are returned as they come, one per input row, with repeated ids kept; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import U64, Words, lower_ascii, mix, ragged, slices, utf8
from .graph import BROADCAST_IDS, checkpointed, with_ids

SPAN = 9
# Which words in a row each mask keeps. Masks of SPAN words serve all items from SPAN words on, the
# others items of just their length.
MASKS = ("111000110", "101100101", "100011011", "010111100", "011011001", "001110110", "010101011", "110110010")
MASKS += tuple("1" * n for n in range(1, 5)) + tuple("1" * k + "0" + "1" * (n - k - 1) for n in range(5, SPAN) for k in range(n)) + ("111111000111111",)
#: Bits of the filter for each seed, and at most (as a power of two); candidates of a text in one task.
BITS_PER_SEED, FILTER_BITS, PART_PLACES = 64, 28, 1 << 20
# Where in a seed each probe of the filter starts.
_PROBES = (0, 18, 36)
_HIT = "digest binary, seed long, place long"
_PAIR = "digest binary, part int, text string, item binary, shift long, hashes binary"


def _words(texts: pa.Array) -> Words:
    data, offsets = utf8(texts)
    return Words(lower_ascii(data), offsets)


def _seeds(words: Words, masks: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask: positions and hashes of its windows."""
    n = len(words.hash)
    for k in masks:
        span = len(MASKS[k])
        at = np.flatnonzero(words.row[span - 1 :] == words.row[: n - span + 1]) if n >= span else np.zeros(0, np.int64)
        total = np.full(len(at), k + 1, U64)
        for j, keep in enumerate(MASKS[k]):
            if keep == "1":
                total = total * U64(0x9E3779B97F4A7C15) + words.hash[at + j]
        yield at, mix(total)


def equal_words(equal: np.ndarray, length: int, least: int) -> int:
    """Most equal words in a stretch of an overlap with an item of `length` words, or in all of it, in which
    four in five words are equal; 0 if the item is shorter and not there by that, and too few are equal."""
    count = np.concatenate(([0], np.cumsum(equal)))
    score = 5 * count - 4 * np.arange(len(count))
    # the longest stretch up to each place starts where the score was first as low
    run = int((count - count[np.searchsorted(-np.minimum.accumulate(score), -score)]).max())
    whole = int(count[-1])
    return max(run, whole) if 5 * whole >= 4 * length else run if run >= least else 0


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """mask, seed, item and place of each seed of the items: of the masks that serve their lengths."""
    for part in slices(batches, "text"):
        words = _words(part.column("text"))
        length = np.diff(words.first)
        masks = [k for k, mask in enumerate(MASKS) if (length >= SPAN if len(mask) == SPAN else length == len(mask)).any()]
        for k, (at, seed) in zip(masks, _seeds(words, masks), strict=True):
            if len(MASKS[k]) != SPAN:
                own = length[words.row[at]] == len(MASKS[k])
                at, seed = at[own], seed[own]
            row = words.row[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(seed.view(np.int64)), part.column("item").take(pa.array(row)), pa.array(at - words.first[row])], names=["mask", "seed", "item", "at"])


def _item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        words = _words(part.column("text"))
        hashes = [words.hash[a:b].tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("item"), pa.array(hashes, pa.binary())], names=["item", "hashes"])


def seed_filter(seeds: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the seeds as 64-bit words, put together by Spark: at most 2^FILTER_BITS bits."""
    bits = min(FILTER_BITS, max(16, (BITS_PER_SEED * count - 1).bit_length()))
    probes = F.array(*(F.expr(f"shiftrightunsigned(seed, {low}) & {(1 << bits) - 1}L") for low in _PROBES))
    spread = seeds.select("seed").distinct().select(F.explode(probes).alias("bit")).select(F.expr("shiftright(bit, 6)").alias("word"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("bit"))
    found = spread.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), U64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(U64)
    return out


def _passed(table: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Places of the seeds that may be in the filter."""
    at = np.arange(len(seed))
    for low in _PROBES:
        bit = (seed[at] >> U64(low)) & U64(64 * len(table) - 1)
        at = at[((table[bit >> U64(6)] >> (bit & U64(63))) & U64(1)).astype(bool)]
    return at


def _hits(table, masks: list[int]):
    """Places of the documents whose seeds pass the filter; of masks without an ignored word one for each seed of a
    text, as all its places match alike."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = utf8(part.column("text"))
            words = Words(lower_ascii(data), offsets)
            for k, (at, seed) in zip(masks, _seeds(words, masks), strict=True):
                live = _passed(table.value, seed)
                at, seed = at[live], seed[live]
                row = words.row[at]
                if "0" not in MASKS[k] and len(at):
                    order = np.lexsort((seed, row))
                    row, at, seed = row[order], at[order], seed[order]
                    first = np.concatenate(([True], (row[1:] != row[:-1]) | (seed[1:] != seed[:-1])))
                    row, at, seed = row[first], at[first], seed[first]
                if len(at):
                    rows, of = np.unique(row, return_inverse=True)
                    digest = pa.array([hashlib.sha256(data[offsets[r] : offsets[r + 1]].data).digest() for r in rows.tolist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([digest.take(pa.array(of)), pa.array(seed.view(np.int64)), pa.array(at - words.first[row])], names=["digest", "seed", "place"])

    return search


def equal_at(words: Words, hashes: np.ndarray, ends: np.ndarray, shift: np.ndarray, least: int) -> np.ndarray:
    """Equal words of one text with each item (words hashes[ends[k]:ends[k + 1]]) on its shift, 0 where the item does not
    contaminate. If four in five words of the item are equal, they count; else the longest stretch does."""
    length = np.diff(ends)
    low, high = np.maximum(0, -shift), np.minimum(length, len(words.hash) - shift)
    size = np.maximum(high - low, 0)
    equal = hashes[ragged(ends[:-1] + low, size)] == words.hash[ragged(shift + low, size)]
    count, stop = np.concatenate(([0], np.cumsum(equal))), np.concatenate(([0], np.cumsum(size)))
    whole = count[stop[1:]] - count[stop[:-1]]
    out = np.where(5 * whole >= 4 * length, whole, 0)
    for k in np.flatnonzero((out == 0) & (whole >= least)).tolist():
        out[k] = equal_words(equal[stop[k] : stop[k + 1]], int(length[k]), least)
    return out


def _verify(least: int):
    """digest, item and n_equal where an item contaminates a text: the rows come sorted, each text before its candidates."""
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Words | None = None
        for batch in batches:
            texts = np.flatnonzero(batch.column("item").is_null().to_numpy(zero_copy_only=False))
            starts = sorted({0, *texts.tolist(), *(texts + 1).tolist()})
            is_text = set(texts.tolist())
            for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
                if a in is_text:
                    words = _words(batch.column("text").slice(a, 1))
                    continue
                for part in slices(iter([batch.slice(a, b - a)]), "hashes"):
                    raw, offsets = utf8(part.column("hashes"))
                    n = equal_at(words, np.frombuffer(raw.tobytes(), U64), offsets // 8, part.column("shift").to_numpy(), least)
                    kept = pa.array(np.flatnonzero(n))
                    yield pa.RecordBatch.from_arrays([part.column("digest").take(kept), part.column("item").take(kept), pa.array(n[n > 0])], names=["digest", "item", "n"])

    return verify


def contaminated(docs: DataFrame, benchmark: DataFrame, words: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per document: doc_id, items (ids of the benchmark items in it, ascending, NULL last), n_equal (most
    equal words of one in a stretch), contaminated."""
    spark = docs.sparkSession
    digest = F.unhex(F.sha2("text", 256))
    named = benchmark.select(F.col(item_col).cast("long").alias("id"), F.col("text")).where("text is not null").withColumn("item", digest)
    items = named.select("item", "text").dropDuplicates(["item"])
    seeds = checkpointed(items.mapInArrow(_item_seeds, "mask int, seed long, item binary, at long"))
    masks = sorted(r.mask for r in seeds.select("mask").distinct().collect())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = rows.select("text").where("text is not null")
    table = spark.sparkContext.broadcast(seed_filter(seeds, seeds.count()))
    hits = texts.mapInArrow(_hits(table, masks), _HIT)
    shifts = hits.join(seeds, "seed").select("digest", "item", (F.col("place") - F.col("at")).alias("shift")).distinct()
    shifts = checkpointed(shifts)
    parts = checkpointed(shifts.groupBy("digest").agg(F.ceil(F.count("*") / PART_PLACES).cast("int").alias("parts")))
    wanted = with_ids(texts.withColumn("digest", digest), parts, "digest", "inner").dropDuplicates(["digest"])
    wanted = wanted.select("digest", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "text")
    pairs = with_ids(shifts, parts, "digest", "inner").withColumn("part", F.pmod(F.xxhash64("item", "shift"), F.col("parts")).cast("int"))
    pairs = pairs.join(items.mapInArrow(_item_words, "item binary, hashes binary"), "item")
    stream = wanted.unionByName(pairs.select("digest", "part", "item", "shift", "hashes"), allowMissingColumns=True).select([c.split()[0] for c in _PAIR.split(", ")])
    stream = stream.repartition("digest", "part").sortWithinPartitions("digest", "part", "item")
    judged = stream.mapInArrow(_verify(words), "digest binary, item binary, n long").join(named.select("item", "id"), "item")
    found = checkpointed(judged.groupBy("digest").agg(F.array_sort(F.transform(F.collect_set(F.struct("id")), lambda s: s["id"])).alias("items"), F.max("n").alias("n_equal")))
    weight = found.agg(F.sum(F.size("items").cast("long"))).first()[0] or 0
    out = rows.select("doc_id", digest.alias("digest")).join(F.broadcast(found) if weight <= BROADCAST_IDS else found, "digest", "left")
    return out.select("doc_id", F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("n_equal", F.lit(0).cast("long")).alias("n_equal"), F.col("items").isNotNull().alias("contaminated"))
