"""Prefix trie of conversations by ternary search trees over range shards (operator 11).

Distinct turns (role, text) get a number from a dictionary, and conversations become arrays of numbers; texts leave the
executors' scans only as digests. Equal conversations are one row with a count. The rows are put in order of their
arrays by a range exchange, and each shard is read in pieces of about PIECE turns: a piece builds one ternary search
tree, its rows inserted median first, and passes over the nodes from the last made to the first, adding members, leaves
and savings to the parent. Nodes that a neighbouring piece has too lie on the first or the last row's path, down to the
length that this row shares with the neighbour's nearest one. Those lengths (two numbers per shard) go through the driver;
with them a piece knows which of its nodes an earlier piece has counted and whether its last row goes on in the next
one, so that all figures of such nodes are plain sums over the pieces, merged by a digest of the path.

Conversations are rebuilt first: conversation c takes the first h turns of conversation c - c % 5 and its own from h on,
h = crc32(c) % 9, so most of them share prefixes.

Defined results: NULL role and text are empty; NULL turns come first; turns of equal number follow role, then the SHA-256
of role and text, so repeated rows are turns of their own; rows without conv_id belong to no conversation; an empty table
has no nodes, not even a root. The numbers of one conversation's turns are held in one row, its texts are not. Ids of
conversations that end at a node are hashed as a stream in one task. Other columns of the input are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .graph import checkpointed, with_ids

PIECE = 1 << 16
GROUP, HEADS = 5, 9
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = "key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


class TernaryTree:
    """Ternary search tree over sequences of numbers. Node 0 is the empty prefix; every other node is one prefix, in the
    search tree `low`/`high` of its siblings, with its children below `down`. Parents are made before their children."""

    def __init__(self) -> None:
        self.key, self.low, self.high, self.down, self.parent, self.depth = [0], [-1], [-1], [-1], [-1], [0]
        self.size, self.members, self.least = [0], [0], [None]

    def _new(self, key: int, parent: int, size: int) -> int:
        for column, value in ((self.key, key), (self.low, -1), (self.high, -1), (self.down, -1), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.size, size), (self.members, 0), (self.least, None)):
            column.append(value)
        return len(self.key) - 1

    def _count(self, at: int, members: int, least: int) -> None:
        self.members[at] += members
        if self.least[at] is None or least < self.least[at]:
            self.least[at] = least

    def insert(self, keys: list[int], sizes: list[int], members: int, least: int) -> int:
        """Adds a sequence that `members` conversations have; returns the node where it ends."""
        key, low, high, down = self.key, self.low, self.high, self.down
        at = 0
        self._count(0, members, least)
        for k, size in zip(keys, sizes, strict=True):
            side, holder, here = down, at, down[at]
            while here >= 0 and key[here] != k:
                side, holder = (low, here) if k < key[here] else (high, here)
                here = side[here]
            if here < 0:
                here = self._new(k, at, size)
                side[holder] = here
            at = here
            self._count(at, members, least)
        return at

    def path(self, end: int) -> list[int]:
        """Nodes from the root to `end`."""
        out = []
        while end >= 0:
            out.append(end)
            end = self.parent[end]
        return out[::-1]


def median_order(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle of each range before its halves."""
    todo = [(0, n)]
    while todo:
        low, high = todo.pop()
        if low < high:
            mid = (low + high) // 2
            yield mid
            todo += [(mid + 1, high), (low, mid)]


def _digest(key: bytes, turn: int) -> bytes:
    return hashlib.blake2b(key + turn.to_bytes(8, "little", signed=True), digest_size=16).digest()


def piece_nodes(rows: list[tuple], before: int, after: int) -> list[tuple]:
    """Nodes (NODE) of consecutive rows (keys, sizes, members, least, ends). `before` and `after`: how many turns the
    first row shares with the row before and the last one with the row after, -1 where there is none. Nodes within
    those lengths are parts: they have a key, and their figures are to be summed over the pieces."""
    tree, ends, last = TernaryTree(), {}, {}
    for k in median_order(len(rows)):
        keys, sizes, members, least, said = rows[k]
        last[k] = tree.insert(keys, sizes, members, least)
        ends[last[k]] = said
    n = len(tree.key)
    first, final = tree.path(last[0]), tree.path(last[len(rows) - 1])
    counted = set(first[: before + 1])
    shared = counted | set(final[: after + 1])
    on = final[-1] if after == len(final) - 1 else -1  # goes on in the next piece
    children, leaves, saved = [0] * n, [0] * n, [0] * n
    for at in range(n - 1, -1, -1):
        fresh = at not in counted
        if tree.down[at] < 0 and at != on:
            leaves[at] += 1
        saved[at] += (tree.members[at] - fresh) * tree.size[at]
        up = tree.parent[at]
        if up >= 0:
            children[up] += fresh
            leaves[up] += leaves[at]
            saved[up] += saved[at]
    name = {0: b""}
    for at in sorted(shared):
        if at:
            name[at] = _digest(name[tree.parent[at]], tree.key[at])
    out = []
    for at in range(n):
        up = tree.parent[at]
        inner = up >= 0 and up not in shared
        out.append((name[at] if at in shared else None, name[up] if up in shared else None, tree.depth[at], tree.least[at], tree.least[up] if inner else None, tree.members[at], children[at], leaves[at], saved[at], ends.get(at)))
    return out


def common(a: list[int], b: list[int]) -> int:
    """Length of the common prefix."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _grow(borders: dict[int, tuple[int, int]]):
    schema = pa.schema([(c.split()[0], {"binary": pa.binary(), "long": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in NODE.split(", ")])

    def table(rows: list[tuple], before: int, after: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*piece_nodes(rows, before, after), strict=True), schema, strict=True)], schema=schema)

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        turns, shard, before = 0, None, -1
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("ids", "sizes", "n_convs", "conv_id", "ends", "shard")]
            for *row, own in zip(*columns, strict=True):
                if own != shard:
                    if held:
                        yield table(held, before, borders[shard][1])
                    held, turns, shard, before = [], 0, own, borders[own][0]
                elif turns >= PIECE:
                    after = common(held[-1][0], row[0])
                    yield table(held, before, after)
                    held, turns, before = [], 0, after
                held.append(tuple(row))
                turns += len(row[0]) + 1
        if held:
            yield table(held, before, borders[shard][1])

    return grow


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of the ids of each key, which come in order."""
    own, state = None, hashlib.sha256()
    for batch in batches:
        done = []
        for key, conv in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if key != own:
                if own is not None:
                    done.append((own, state.hexdigest()))
                own, state = key, hashlib.sha256(str(conv).encode())
            else:
                state.update(b",%d" % conv)
        yield _hashed(done)
    if own is not None:
        yield _hashed([(own, state.hexdigest())])


def _hashed(rows: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows], pa.binary()), pa.array([x[1] for x in rows], pa.string())], names=["path", "ends"])


def coded_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (id, bytes) with the dictionary's number of (role,
    text) and the text's bytes in UTF-8."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), F.octet_length(text).alias("bytes"))
    words = checkpointed(rows.select("digest").distinct().withColumn("id", F.monotonically_increasing_id()))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "digest"))
    placed = with_ids(rows, words, "digest", "inner").select("conv_id", place.alias("place"), "id", "bytes")
    listed = F.sort_array(F.collect_list(F.struct("place", "id", "bytes")))
    return placed.groupBy("conv_id").agg(F.transform(listed, lambda x: F.struct(x.id.alias("id"), x.bytes.alias("bytes"))).alias("turns"))


def rebuilt(coded: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): the first h turns of conversation c - c % GROUP, then the own turns after the first h."""
    h = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    heads = coded.select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    both = coded.withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP).join(heads, "base", "left")
    tail = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    whole = both.select("conv_id", F.concat(F.coalesce(F.slice("head", F.lit(1), h), F.slice("turns", 1, 0)), tail).alias("all"))
    return whole.select("conv_id", F.col("all.id").alias("ids"), F.col("all.bytes").alias("sizes"))


def _shared_length(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    differ = F.array_position(F.zip_with(F.slice(a, F.lit(1), least), F.slice(b, F.lit(1), least), lambda x, y: x != y), True)
    return F.when(a.isNotNull() & b.isNotNull(), F.when(differ > 0, differ - 1).otherwise(least))


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """A row per distinct prefix of the sequences (conv_id, ids, sizes), each as long as `ids`: conv_id (the smallest
    member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    n = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sequences = checkpointed(sequences.withColumn("path", F.unhex(F.sha2(F.array_join("ids", ","), 256))))
    ends = sequences.select("path", "conv_id").repartition(n, "path").sortWithinPartitions("path", "conv_id").mapInArrow(_ended, "path binary, ends string")
    kinds = sequences.groupBy("path").agg(F.first("ids").alias("ids"), F.first("sizes").alias("sizes"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    ordered = kinds.join(ends, "path").drop("path").repartitionByRange(n, "ids").sortWithinPartitions("ids")
    ordered = checkpointed(ordered.withColumn("shard", F.spark_partition_id()))
    row = Window.orderBy("shard")  # a row per shard
    edges = ordered.groupBy("shard").agg(F.min("ids").alias("first"), F.max("ids").alias("last"))
    edges = edges.select("shard", "first", "last", F.lag("last").over(row).alias("left"), F.lead("first").over(row).alias("right"))
    met = lambda a, b: F.coalesce(_shared_length(F.col(a), F.col(b)), F.lit(-1))
    borders = {r[0]: (r[1], r[2]) for r in edges.select("shard", met("left", "first"), met("last", "right")).collect()}
    nodes = checkpointed(ordered.mapInArrow(_grow(borders), NODE))

    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = nodes.where("key is not null").groupBy("key").agg(F.first("parent_key").alias("parent_key"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    parts = checkpointed(parts.withColumn("parent_conv_id", F.lit(None).cast("long")))
    rows = nodes.where("key is null").drop("key").unionByName(parts.drop("key"))
    below = with_ids(rows.where("parent_key is not null").drop("parent_conv_id"), parts.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id")), "parent_key", "inner")
    out = rows.where("parent_key is null").unionByName(below)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The prefix trie of the rebuilt conversations of a table (conv_id, turn, role, text)."""
    return prefix_trie(rebuilt(coded_turns(turns)))
