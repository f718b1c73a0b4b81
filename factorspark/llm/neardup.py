"""MinHash near-duplicate groups by a multi-index Hamming join (operator 4).

A document's set holds the hashes of its distinct k-word shingles. Its signature has SLOTS minima of
hashed shingles, b = 16 bits each; of two sets with Jaccard similarity s, each slot differs with
probability 1 - s. Pairs whose signatures differ in at most ERRORS slots are found without loss:

* the slots are cut into CHUNKS chunks. By pigeonhole, two signatures within ERRORS have a chunk with at
  most ERRORS // CHUNKS differing slots; each chunk is indexed under every choice of slots left out, so
  such a pair shares a key. Keys that hold the same documents count once;
* pairs within ERRORS are linked in the buckets of equal whole chunks first, which connects most of a large group in a
  quarter of the keys; buckets of the keys with slots left out then compare only members of different components, and
  buckets of one component are dropped before their members are joined. Components of all links are clusters;
* within a cluster the full sets decide: linked are pairs with 100 * |A & B| >= percent * |A | B|.

At a similarity of 0.8 a pair differs in 12.8 of 64 slots on average, and in over 28 of them with a
probability of 4e-6, which bounds what the signatures can miss. Equal sets are collapsed first, so copies
cost nothing; large buckets and clusters are cut into tiles of two blocks, so that no task gets a group
whole, each tile returns a spanning forest of its links instead of all pairs, and pairs that are connected
already are not compared again (`graph.connected`). Shingles are compared by 64-bit hashes that are no
polynomial, so no pattern of words makes different shingles equal.

Defined results: NULL, empty or blank texts have an empty set and are linked with nothing; a text of
fewer than k words has one shingle, the whole sequence; rows with equal ids are documents of their own
that share an id; rows without an id are linked with nothing and have no component. Other columns of the input are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import U64, Forest, Words, distinct, lower_ascii, mix, slices, utf8
from .graph import LARGER, across, checkpointed, connected, key_filter, passes, spanning, whole_groups, with_ids

SLOTS, ERRORS, CHUNKS = 64, 28, 15
# Members of a block: signatures in a bucket, sets in a cluster; and shingles of a block of sets.
BUCKET_BLOCK, CLUSTER_BLOCK, CLUSTER_SHINGLES = 256, 128, 1 << 20
_MULTIPLIERS = mix(np.arange(1, SLOTS + 1, dtype=U64)) | U64(1)


def shingle_sets(part: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, hashes) of the distinct shingles of each row of a slice with a column `text`."""
    data, offsets = utf8(part.column("text"))
    row, value = distinct(*Words(lower_ascii(data), offsets).shingles(k))
    return np.searchsorted(row, np.arange(part.num_rows + 1)), value


def digests(offsets: np.ndarray, value: np.ndarray) -> list[bytes]:
    """A digest of each set, equal for equal sets."""
    out = np.zeros((len(offsets) - 1, 2), U64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        at = offsets[:-1][full]
        out[full, 0] = np.add.reduceat(mix(value + U64(1)), at)
        out[full, 1] = np.bitwise_xor.reduceat(mix(value ^ U64(0x5BD1E995)), at)
    return [x.tobytes() for x in out]


def _signatures(k: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            offsets, value = shingle_sets(part, k)
            count = np.diff(offsets)
            full = np.flatnonzero(count)
            minima = np.zeros((part.num_rows, SLOTS), np.uint16)
            if len(full):
                at = offsets[:-1][full]
                for j in range(SLOTS):
                    least = np.minimum.reduceat((value * _MULTIPLIERS[j]) >> U64(16), at)
                    minima[full, j] = mix(least).astype(np.uint16)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(count), pa.array(digests(offsets, value), pa.binary()), pa.array([x.tobytes() for x in minima], pa.binary())],
                names=["id", "n_shingles", "digest", "signature"],
            )

    return sign


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SLOTS)


def _index(fewer: int, table=None):
    """Keys of each signature: its chunks under every choice of `fewer` slots left out; those that pass the filter, if given."""
    cut = [SLOTS * c // CHUNKS for c in range(CHUNKS + 1)]
    chosen = [[j for j in range(cut[c], cut[c + 1]) if j not in left_out] for c in range(CHUNKS) for left_out in combinations(range(cut[c], cut[c + 1]), fewer)]

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signature = _matrix(batch.column("signature")).astype(U64)
            keys = np.empty((len(signature), len(chosen)), U64)
            for n, slots in enumerate(chosen):
                key = np.full(len(signature), n + 1, U64)
                for j in slots:
                    key = mix(key * U64(0x9E3779B97F4A7C15) + signature[:, j])
                keys[:, n] = key
            keys = keys.reshape(-1)
            at = np.arange(len(keys)) if table is None else np.flatnonzero(passes(table.value, keys))
            kind, known = (batch.column(c).to_numpy()[at // len(chosen)] for c in ("kind", "known"))
            yield pa.RecordBatch.from_arrays([pa.array(keys[at].view(np.int64)), pa.array(kind), pa.array(known)], names=["key", "kind", "known"])

    return index


_KEYS = "key long, kind long, known long"


def _buckets(kinds: DataFrame, fewer: int) -> DataFrame:
    """(key, kind, known, n, largest, within) of the keys whose `n` members are in several components, `within` of them in
    the `largest`; keys of the same members count once.

    Of most keys all members are in one component. Which have several is asked first, in the one exchange of the whole
    index, with two numbers to a key; a filter of those keys goes to the tasks, and what passes it is all that is summed
    and joined then."""
    signed = kinds.select("kind", "known", "signature")
    parts = signed.mapInArrow(_index(fewer), _KEYS).groupBy("key").agg(F.min("known").alias("low"), F.max("known").alias("high"))
    mixed = checkpointed(parts.where("low < high").select("key"))
    index = signed.mapInArrow(_index(fewer, kinds.sparkSession.sparkContext.broadcast(key_filter(mixed, "key"))), _KEYS)
    parts = index.groupBy("key", "known").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("kind")).alias("who"))
    most = F.max(F.struct("m", "known")).alias("most")
    several = parts.groupBy("key").agg(F.sum("m").alias("n"), F.bit_xor("who").alias("who"), F.count("*").alias("parts"), most).where("parts > 1")
    once = several.groupBy("n", "who").agg(F.min(F.struct("key", "most")).alias("first"))
    once = checkpointed(once.select("first.key", "n", F.col("first.most.known").alias("largest"), F.col("first.most.m").alias("within")))
    return checkpointed(index.join(once, "key"))


_LINKS = "a long, b long, loose boolean"


def _links(found: list[tuple[int, int]], loose: list[tuple[int, int]]) -> pa.RecordBatch:
    rows = found + loose
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.int64()), pa.array([x[1] for x in rows], pa.int64()), pa.array([False] * len(found) + [True] * len(loose), pa.bool_())], names=["a", "b", "loose"])


def _spread(near: np.ndarray, ids: np.ndarray, pivot: np.ndarray, group: int, tile: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Links of a tile of a large group, and its loose members; those of the pivots are told by the first tile only."""
    forest, loose = spanning(near, pivot)
    if tile > 1:
        loose &= ~pivot
    return [(int(ids[a]), int(ids[b])) for a, b in forest], [(group, k) for k in ids[loose].tolist()]


def _tiles(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the rows, and where each tile begins, and the end."""
    key = np.stack([table[c].to_numpy() for c in keys], 1)
    return key, np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(1), [True])))


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest, over the components known, of the pairs within ERRORS in each bucket's tile."""
    forest = Forest()
    for table in whole_groups(batches, ["key", "ti", "tj"], 8192):
        key, edge = _tiles(table, ["key", "ti", "tj"])
        ids, known, pivot, many = (table[c].to_numpy() for c in ("kind", "known", "pivot", "many"))
        signature = _matrix(table["signature"])
        found, loose = [], []
        few = np.ones(len(ids), bool)
        for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            own = signature[low:high]
            if many[low]:
                near = np.stack([(own != row).sum(1) <= ERRORS for row in own])
                more, left = _spread(near, ids[low:high], pivot[low:high], int(key[low, 0]), int(key[low, 2]))
                found += [(a, b) for a, b in more if forest.union(a, b)]
                loose += left
            elif pivot[low:high].any():
                for at in (np.flatnonzero(pivot[low:high]) + low).tolist():
                    near = np.flatnonzero(((own != signature[at]).sum(1) <= ERRORS) & (known[low:high] != known[at])) + low
                    found += [(int(known[at]), b) for b in np.unique(known[near]).tolist() if forest.union(int(known[at]), b)]
            else:
                continue
            few[low:high] = False
        rest = np.flatnonzero(few)
        ends, signature, group = known[rest], signature[rest], np.repeat(np.arange(len(edge) - 1), np.diff(edge))[rest]
        for apart in range(1, len(ends)):
            left = np.flatnonzero(group[apart:] == group[:-apart])
            if not len(left):
                break
            near = left[(signature[left] != signature[left + apart]).sum(1) <= ERRORS]
            found += [(a, b) for a, b in zip(ends[near].tolist(), ends[near + apart].tolist(), strict=True) if forest.union(a, b)]
        yield _links(found, loose)


def _sets(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            offsets, value = shingle_sets(part, k)
            data = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((offsets * 8).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(value))])
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(digests(offsets, value), pa.binary()), data], names=["id", "digest", "set"])

    return sets


def _linked(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest of the links in each cluster's tile, from the full sets."""
        for table in whole_groups(batches, ["cluster", "ti", "tj"], 256):
            key, edge = _tiles(table, ["cluster", "ti", "tj"])
            ids, pivot, many = (table[c].to_numpy() for c in ("id", "pivot", "many"))
            found: list[tuple[int, int]] = []
            loose: list[tuple[int, int]] = []
            for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                near = alike(table["set"].slice(low, high - low).to_pylist(), percent)
                more, left = _spread(near, ids[low:high], pivot[low:high], int(key[low, 0]), int(key[low, 2]))
                found += more
                loose += left if many[low] else []
            yield _links(found, loose)

    return linked


def alike(sets: list[bytes], percent: int) -> np.ndarray:
    """Which pairs of sets are similar enough; every pair is compared."""
    size = np.array([len(x) // 8 for x in sets])
    start = np.cumsum(size) - size
    word = np.unique(np.frombuffer(b"".join(sets), U64), return_inverse=True)[1]
    mark = np.zeros(len(word) + 1, np.int32)
    near = np.zeros((len(sets), len(sets)), bool)
    for i in range(len(sets) - 1):
        own = word[start[i] : start[i] + size[i]]
        mark[own] = 1
        rest = start[i + 1]
        both = np.add.reduceat(mark[word[rest:]], start[i + 1 :] - rest)
        mark[own] = 0
        near[i, i + 1 :] = 100 * both >= percent * (size[i] + size[i + 1 :] - both)
    return near | near.T


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the smallest id reachable through links)."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = checkpointed(texts.mapInArrow(_signatures(k), "id long, n_shingles long, digest binary, signature binary"))
    # one member per distinct set
    kinds = base.where("n_shingles > 0 and id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("copies"))
    kinds = checkpointed(kinds.withColumn("kind", F.monotonically_increasing_id()))

    def close(of: DataFrame):
        def links(tiles: DataFrame) -> DataFrame:
            tiles = tiles.select("key", "ti", "tj", "kind", "pivot", "many").join(of.select("kind", "known", "signature"), "kind")
            return tiles.repartition(n, "key", "ti", "tj").sortWithinPartitions("key", "ti", "tj", "kind").mapInArrow(_close, _LINKS)

        return links

    kinds = kinds.withColumn("known", F.col("kind"))
    whole = _buckets(kinds, 0).withColumn("blocks", F.ceil(F.col("n") / BUCKET_BLOCK).cast("int"))
    first = connected(whole.select("key", "kind", "blocks"), "key", "kind", close(kinds), rest=False).withColumnRenamed("id", "kind")
    kinds = checkpointed(kinds.drop("known").join(first, "kind", "left").withColumn("known", F.coalesce("component", "kind")))
    second = across(_buckets(kinds, ERRORS // CHUNKS), "key", "kind", "known", BUCKET_BLOCK * LARGER, close(kinds)).select(F.col("id").alias("known"), F.col("component").alias("cluster"))
    clusters = checkpointed(kinds.join(second, "known", "left").withColumn("cluster", F.coalesce("cluster", "component")).where("cluster is not null").select("kind", "cluster", "digest", "id", "n_shingles"))
    blocks = F.greatest(F.ceil(F.count("*") / CLUSTER_BLOCK), F.ceil(F.sum("n_shingles") / CLUSTER_SHINGLES)).cast("int")
    members = checkpointed(clusters.join(clusters.groupBy("cluster").agg(blocks.alias("blocks")), "cluster").select("kind", "cluster", "blocks", "digest", "id"))
    # rows that repeat an id and a text
    repeated = base.join(members, ["id", "digest"], "left_semi").count() > members.count()

    def same(tiles: DataFrame) -> DataFrame:
        tiles = tiles.join(members.select("kind", "id", "digest"), "kind")
        sets = with_ids(texts, tiles.select("id").distinct(), "id").mapInArrow(_sets(k), "id long, digest binary, set binary")
        sets = sets.dropDuplicates(["id", "digest"]) if repeated else sets
        tiles = tiles.join(sets, ["id", "digest"]).select("cluster", "ti", "tj", F.col("kind").alias("id"), "pivot", "many", "set")
        return tiles.repartition(n, "cluster", "ti", "tj").sortWithinPartitions("cluster", "ti", "tj", "id").mapInArrow(_linked(percent), _LINKS)

    group = connected(members.select("cluster", "kind", "blocks"), "cluster", "kind", same).withColumnRenamed("id", "kind").join(kinds.select("kind", "digest", "id"), "kind")
    least = group.groupBy("component").agg(F.min("id").alias("component_id"))
    named = group.join(least, "component").select("digest", "component_id")
    copied = kinds.where("copies > 1").join(named, "digest", "left").select("digest", F.coalesce("component_id", "id").alias("component_id"))
    named = checkpointed(named.unionByName(copied).distinct())
    out = with_ids(base.select("id", "n_shingles", "digest"), named, "digest", "left")
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component_id")), "id")).alias("component_id"))
