"""SimHash near-duplicate groups by tiled exact comparison (operator 13).

A document's fingerprint has a bit set if it is set in over half of the XXH64 hashes of its k-word shingles. Equal
fingerprints are one row. The others are put in order by the population counts of their four 16-bit quarters (in Morton
order, so that neighbours have similar counts) and cut into tiles of about `tile` rows. Two fingerprints within `radius`
bits differ by `radius` at most in the sum of the differences of those counts, so a pair of tiles is skipped if the
ranges of their counts are further apart; all other pairs of tiles are compared whole by exclusive-or and bit counts,
again without the parts that are too far apart. Each pair of tiles returns a spanning forest of its links.

What is compared is exact, and its share falls as the tiles get narrower, but it grows with the square of the number of
different fingerprints. The plan of the tiles goes through the driver; it has a row per vector of four counts, 17^4 at
most, and TILES tiles.

Defined results: NULL, empty and blank texts have fingerprint zero and are linked as any other; rows that share an id are
documents of their own; a NULL id names no component unless all ids in it are NULL. Other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .arrays import NO_SPACE, U64, Forest, lower_ascii, slices, utf8, word_spans
from .graph import checkpointed, components, with_ids

SEED = 42
TILE, SUB, TILES = 1 << 14, 512, 2048
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").reshape(-1)  # bit i in byte i
_MOST = 255  # as many additions as a byte bears


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every k-word shingle of a lower-cased slice, in row order; a row of fewer words has one, of all."""
    start, end, row = word_spans(data, offsets, NO_SPACE)
    if not len(start):
        return row, np.zeros(0, U64)
    keep = NO_SPACE[data]
    gap = end[end < len(data)]
    keep[gap] = True  # one blank after each word
    place = np.concatenate(([0], np.cumsum(keep)))
    plain = np.where(NO_SPACE[data], data, np.uint8(0x20))[keep].tobytes()
    start, end = place[start], place[end]
    first = np.searchsorted(row, np.arange(len(offsets)))
    last = np.minimum(np.arange(len(row)) + k, first[row + 1]) - 1
    own = (np.arange(len(row)) == first[row]) | (np.arange(len(row)) + k <= first[row + 1])
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(plain[a:b], SEED) for a, b in zip(start[own].tolist(), end[last[own]].tolist(), strict=True)), U64, int(own.sum()))
    return row[own], hashes


def majority(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """For each row a word of the bits that are set in over half of its hashes; `row` ascends."""
    out = np.zeros(rows, U64)
    if not len(row):
        return out
    full, first = np.unique(row, return_index=True)
    size = np.diff(np.append(first, len(row)))
    run = np.arange(len(row)) - np.repeat(first, size)
    cut = np.flatnonzero(run % _MOST == 0)  # parts whose sums fit in bytes
    owner = np.searchsorted(first, cut, "right") - 1
    part = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    for k in range(8):
        sums = np.add.reduceat(SPREAD[octets[:, k]], cut).view(np.uint8).reshape(-1, 8)
        total = np.add.reduceat(sums, part, axis=0, dtype=np.int64)
        bits = np.packbits(2 * total > size[:, None], axis=1, bitorder="little").reshape(-1)
        out[full] |= bits.astype(U64) << U64(8 * k)
    return out


def _prints(k: int):
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            data, offsets = utf8(part.column("text"))
            row, hashes = shingle_hashes(lower_ascii(data), offsets, k)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(majority(row, hashes, part.num_rows).view(np.int64))], names=["id", "print"])

    return prints


def quarters(prints: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit quarters, a row for each fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(prints).view(np.uint16).reshape(-1, 4)).astype(np.int16)


def _morton(counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts), np.int64)
    for bit in range(5):
        for k in range(4):
            out |= ((counts[:, k].astype(np.int64) >> bit) & 1) << (4 * bit + k)
    return out


def tile_plan(cells: pd.DataFrame, tile: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Cells (c0..c3, n) in Morton order cut into tiles: (c0..c3, first, parts), the rows of a cell being dealt to tiles
    first .. first + parts - 1; and the least and greatest counts of each tile."""
    counts = cells[["c0", "c1", "c2", "c3"]].to_numpy(np.int16)
    order = np.argsort(_morton(counts), kind="stable")
    counts, n = counts[order], cells["n"].to_numpy()[order]
    tile = max(tile, -(-int(n.sum()) // TILES)) if len(n) else tile
    parts = -(-n // tile)
    first, at, held = [], 0, 0
    for size, split in zip(n.tolist(), parts.tolist(), strict=True):
        if held and held + size > tile:
            at, held = at + 1, 0
        first.append(at)
        at, held = (at + split, 0) if split > 1 else (at, held + size)
    first = np.array(first, np.int64)
    boxes = np.zeros((int((first + parts).max(initial=0)), 8), np.int16)
    boxes[:, :4] = 99
    for a, b, c in zip(first.tolist(), (first + parts).tolist(), counts, strict=True):
        boxes[a:b, :4], boxes[a:b, 4:] = np.minimum(boxes[a:b, :4], c), np.maximum(boxes[a:b, 4:], c)
    plan = pd.DataFrame(counts, columns=["c0", "c1", "c2", "c3"]).astype("int32")
    return plan.assign(first=first.astype("int32"), parts=parts.astype("int32")), boxes


def gaps(one: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The least sum of differences of counts between a box and each of `boxes`."""
    return np.maximum(np.maximum(one[:4] - boxes[:, 4:], boxes[:, :4] - one[4:]), 0).sum(1)


def _packed(rows: pa.Table) -> pa.Table:
    prints = rows["print"].to_numpy()
    prints = prints[np.argsort(_morton(quarters(prints)), kind="stable")]
    return pa.table({"tile": rows["tile"].slice(0, 1).cast(pa.int32()), "prints": pa.array([prints.tobytes()], pa.binary())})


def _meet(boxes: np.ndarray, radius: int):
    """Sends each tile to every tile that its counts allow, itself included."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column("tile")[k].as_py()
                for at in np.flatnonzero(gaps(boxes[own], boxes) <= radius).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([min(own, at)], pa.int32()), pa.array([max(own, at)], pa.int32()), pa.array([own], pa.int32()), batch.column("prints").slice(k, 1)], names=["ti", "tj", "tile", "prints"])

    return meet


def _boxes(prints: np.ndarray) -> np.ndarray:
    counts, at = quarters(prints), np.arange(0, len(prints), SUB)
    return np.concatenate((np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)), 1)


def forest(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest (pairs of fingerprints) of the links between a and b, or within a if b is a."""
    same = a is b
    one, two = a.view(U64), b.view(U64)
    shift = 0 if same else len(a)
    label = np.arange(len(a) + (0 if same else len(b)))
    own, found = Forest(), []
    left, right = _boxes(a), _boxes(b)
    for i in range(len(left)):
        for j in np.flatnonzero(gaps(left[i], right) <= radius).tolist():
            if same and j < i:
                continue
            x, y = one[i * SUB : (i + 1) * SUB], two[j * SUB : (j + 1) * SUB]
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            p, q = np.nonzero(near)
            p, q = label[p + i * SUB], label[q + j * SUB + shift]
            apart = p != q
            if not apart.any():
                continue
            pairs = np.unique(np.stack((p[apart], q[apart]), 1), axis=0)
            for u, v in pairs.tolist():
                if own.union(u, v):
                    found.append((u, v))
            kinds = np.unique(pairs)
            moved = np.arange(len(label))
            moved[kinds] = [own.root(k) for k in kinds.tolist()]
            label = moved[label]
    every = a if same else np.concatenate((a, b))
    return [(int(every[u]), int(every[v])) for u, v in found]


def _compare(radius: int):
    def compare(rows: pa.Table) -> pa.Table:
        sides = dict(zip(rows["tile"].to_pylist(), (np.frombuffer(x, np.int64) for x in rows["prints"].to_pylist()), strict=True))
        a = sides[rows["ti"][0].as_py()]
        found = forest(a, sides[rows["tj"][0].as_py()], radius)
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()), "b": pa.array([x[1] for x in found], pa.int64())})

    return compare


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, print): the fingerprint of each document as a signed 64-bit number."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_prints(k), "id long, print long")


def linked_prints(kinds: DataFrame, radius: int, tile: int = TILE) -> DataFrame:
    """(a, b): links between the different fingerprints `print` that connect what is within `radius`."""
    n = int(kinds.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = {f"c{k}": F.bit_count(F.shiftrightunsigned("print", 16 * k).bitwiseAND(0xFFFF)) for k in range(4)}
    counted = kinds.select("print").withColumns(counts)
    cells = counted.groupBy(*counts).agg(F.count("*").alias("n")).toPandas()  # 17^4 rows at most
    if cells.empty:
        return kinds.select(F.col("print").alias("a"), F.col("print").alias("b"))
    plan, boxes = tile_plan(cells, tile)
    dealt = counted.join(F.broadcast(kinds.sparkSession.createDataFrame(plan)), list(counts))
    dealt = dealt.select("print", (F.col("first") + F.pmod(F.xxhash64("print"), F.col("parts"))).cast("int").alias("tile"))
    tiles = dealt.groupBy("tile").applyInArrow(_packed, "tile int, prints binary")
    met = tiles.mapInArrow(_meet(boxes, radius), "ti int, tj int, tile int, prints binary").repartition(n, "ti", "tj")
    return met.groupBy("ti", "tj").applyInArrow(_compare(radius), "a long, b long")


def simhash_groups(docs: DataFrame, k: int = 4, radius: int = 4, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable through links)."""
    base = checkpointed(fingerprints(docs, k, id_col, text_col))
    kinds = checkpointed(base.groupBy("print").agg(F.min("id").alias("least")))
    group = components(linked_prints(kinds, radius, tile)).withColumnsRenamed({"id": "print"})
    group = checkpointed(group.join(kinds, "print"))
    named = group.join(group.groupBy("component").agg(F.min("least").alias("smallest")), "component").select("print", "smallest")
    named = checkpointed(kinds.join(named, "print", "left").select("print", F.coalesce("smallest", "least").alias("component_id")))
    return with_ids(base, named, "print", "inner").select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
