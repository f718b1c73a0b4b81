"""Shared steps over links between documents: lineage cuts, bounded joins and filters, tiles and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..sources.io import shared_folder
from .arrays import U64

BROADCAST_IDS = 1_000_000
#: Bits of a filter for each key, and at most (as a power of two); bits that Spark puts together in one row.
BITS_PER_KEY, FILTER_BITS, ROW_BITS = 16, 28, 15
PART_LINKS = 1 << 18
#: Blocks of members that are left over, and of those that they meet, over the first blocks.
LARGER = 4


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` cut from its lineage in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_ids(df: DataFrame, ids: DataFrame, on: str | list[str], how: str = "left_semi") -> DataFrame:
    """`df` joined with `ids` on `on`: a broadcast of up to BROADCAST_IDS rows, a shuffle of more."""
    return df.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, on, how)


def key_filter(keys: DataFrame, key: str) -> np.ndarray:
    """A bitmap of hashed keys, as bytes, put together by Spark: at most 2^FILTER_BITS bits, however many keys there are.
    A full one lets more keys pass (`passes`) that are not among them; none of them is ever held back."""
    bits = min(FILTER_BITS, max(ROW_BITS + 1, (BITS_PER_KEY * keys.count() - 1).bit_length()))
    spread = keys.select(F.expr(f"`{key}` & {(1 << bits) - 1}L").alias("bit")).select(F.shiftright("bit", ROW_BITS).alias("row"), (F.col("bit") % (1 << ROW_BITS)).alias("place"))
    found = spread.repartition("row").groupBy("row").agg(F.bitmap_construct_agg("place").alias("bits")).toArrow()
    out = np.zeros((1 << (bits - ROW_BITS), 1 << (ROW_BITS - 3)), np.uint8)
    for row, own in zip(found["row"].to_pylist(), found["bits"].to_pylist(), strict=True):
        out[row] = np.frombuffer(own, np.uint8)
    return out.reshape(-1)


def passes(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which unsigned keys may be in the filter."""
    bit = key & U64(8 * len(table) - 1)
    return (table[bit >> U64(3)] >> (bit & U64(7)).astype(np.uint8) & np.uint8(1)).astype(bool)


def _block(member: str, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(member), blocks).cast("int")


def connected(members: DataFrame, group: str, member: str, links: Callable[[DataFrame], DataFrame], rest: bool = True) -> DataFrame:
    """(id, component) by the links between members of each group.

    `members` has `group`, `member` and `blocks`: into how many blocks the group is dealt. `links` gets tiles
    (group, ti, tj, member, pivot, many) of two blocks at most and returns rows (a, b, loose): a spanning forest of each
    tile, and for tiles with `many`, as (group, member, true), the members that the tile does not connect with the
    largest component of its pivots (`spanning`).

    Every block meets the first one, whose members are its pivots: in a group of near copies that connects all.
    Members that are left over then meet every other block, so that no pair is left out that may connect two
    components; the work is quadratic only in those members. Without `rest` they do not, for a first step that another
    one (`across`) completes.
    """
    deal = members.withColumn("_own", _block(member, F.col("blocks"))).withColumn("many", F.col("blocks") > 1)
    tile = F.when((F.col("_own") == 0) & F.col("many"), F.sequence(F.lit(1), F.greatest(F.lit(2), "blocks") - 1)).otherwise(F.array("_own"))
    tiles = deal.withColumn("pivot", (F.col("_own") == 0) & F.col("many")).withColumn("tj", F.explode(tile)).withColumn("ti", F.lit(0))
    found = checkpointed(links(tiles.drop("_own", "blocks")))
    forest = found.where("not loose").select("a", "b")
    if not rest:
        return checkpointed(components(forest))
    loose = found.where("loose").select(F.col("a").alias(group), F.col("b").alias(member)).distinct()
    outside = checkpointed(loose.groupBy(group).agg(F.count("*").cast("int").alias("_left")))
    if not outside.isEmpty():
        rows = with_ids(members, outside, group, "inner")
        most = F.ceil(F.count("*") / F.first("blocks")) * LARGER
        sizes = rows.groupBy(group).agg(most.alias("_most"), F.count("*").cast("int").alias("_all"))
        deal = rows.join(sizes, group).join(loose.withColumn("_loose", F.lit(True)), [group, member], "left")
        forest = forest.unionByName(links(_against(deal, group, member)).where("not loose").select("a", "b"))
    return checkpointed(components(forest))


def _against(deal: DataFrame, group: str, member: str) -> DataFrame:
    """Tiles (group, ti, tj, member, pivot, many) in which the `_left` members with `_loose` meet all `_all` of their group,
    as their pivots; `_most` to a block."""
    first, rest = F.ceil(F.col("_left") / F.col("_most")).cast("int"), F.greatest(F.ceil((F.col("_all") - F.col("_left")) / F.col("_most")), F.lit(1)).cast("int")
    deal = deal.withColumns({"_first": first, "_rest": rest, "_loose": F.coalesce("_loose", F.lit(False))})
    own = F.when(F.col("_loose"), _block(member, F.col("_first"))).otherwise(F.col("_first") + _block(member, F.col("_rest")))
    others = F.when(F.col("_loose"), F.sequence(F.lit(0), F.col("_first") + F.col("_rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("_first") - 1))
    tiles = deal.withColumn("_own", own).withColumn("_other", F.explode(others))
    return tiles.select(group, member, F.least("_own", "_other").alias("ti"), F.greatest("_own", "_other").alias("tj"), F.col("_loose").alias("pivot"), F.lit(False).alias("many"))


def across(members: DataFrame, group: str, member: str, known: str, block: int, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, component) over the components `known`, by the links between members of each group that are in different ones.

    `members` has `group`, `member`, `known`, and of the group: `n` members, `largest`, the component with most of them,
    and `within`, how many those are. The members outside the largest component meet all, in tiles of two blocks of about
    `block` members, as for `connected`; `links` returns the linked pairs (a, b) of components. Pairs within the largest
    component are not compared, so a group that is nearly all one component costs little more than its members.
    """
    deal = members.withColumns({"_loose": F.col(known) != F.col("largest"), "_left": F.col("n") - F.col("within"), "_all": F.col("n"), "_most": F.lit(block)})
    return checkpointed(components(links(_against(deal, group, member)).select("a", "b")))


def spanning(near: np.ndarray, pivot: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A spanning forest of a tile (pairs of places), given which pairs are linked, and which places are not connected
    with the largest component of the pivots' own links."""
    def reach(start: int, allowed: np.ndarray, links: list[tuple[int, int]] | None) -> np.ndarray:
        seen = np.zeros(len(near), bool)
        seen[start] = True
        todo = [start]
        while todo:
            at = todo.pop()
            new = np.flatnonzero(near[at] & allowed & ~seen)
            seen[new] = True
            todo += new.tolist()
            if links is not None:
                links += [(at, int(k)) for k in new]
        return seen

    best, left = np.zeros(len(near), bool), pivot.copy()
    while left.any():
        own = reach(int(np.flatnonzero(left)[0]), pivot, None)
        best = own if own.sum() > best.sum() else best
        left &= ~own
    forest: list[tuple[int, int]] = []
    main = np.zeros(len(near), bool)
    left = np.ones(len(near), bool)
    while left.any():
        own = reach(int(np.flatnonzero(left)[0]), left, forest)
        main |= own if (own & best).any() else False
        left &= ~own
    return forest, ~main


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Tables of about `rows` rows or more that end at the end of a group; the batches are sorted by `keys`."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < rows:
            continue
        table = pa.Table.from_batches(held)
        last = [table[k][-1].as_py() for k in keys]
        cut = table.num_rows
        step = [table[k].to_pylist() for k in keys]
        while cut and all(c[cut - 1] == v for c, v in zip(step, last, strict=True)):
            cut -= 1
        if cut:
            yield table.slice(0, cut)
        held, size = table.slice(cut).combine_chunks().to_batches(), table.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id that is reachable, for every id in `links` (columns a, b).

    Alternating large-star and small-star steps: each step hangs neighbours on the smallest id in reach,
    through aggregates with partial sums and joins that can be split, so a hot id is no one task's work. What is left of
    the links is kept in as many parts as their number asks for, so that few links make few files.
    """
    found = checkpointed(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    parts = found.count() // PART_LINKS + 1
    edges = found.coalesce(parts)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        edges = checkpointed(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct().coalesce(parts))
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        star = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = checkpointed(star.where("u <> v").distinct().coalesce(parts))
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
