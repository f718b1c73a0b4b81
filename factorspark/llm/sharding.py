"""Byte-balanced shards by Karmarkar-Karp differencing (operator 5).

Documents with equal texts form a group, which stays together. Differencing starts with one partial
partition per group and, again and again, combines the two with the largest spread in opposite order, so
that the largest part of one meets the smallest of the other. It nests: the groups are dealt out by a hash
into buckets of about BUCKET, each bucket is differenced into `shards` parts on its own, in parallel, and so
are the parts of the buckets, level by level, until one bucket is left. The law is `bytes`.

A group larger than a shard's share of all bytes cannot stay whole without spoiling the balance; it is
cut into pieces of about equal row counts (a piece per 1 / (32 * shards) of the bytes). A group with many rows
stays whole but is joined in SALTS parts, so that no task gets it whole.

Defined results: NULL texts have size 1 and are in the group of the empty text. Rows with equal ids, and with
a NULL id, are separate rows. An empty table has no rows. Other columns of the input are dropped.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .graph import checkpointed

BUCKET, SALTS = 10_000, 64


def difference(parts: list[tuple[list[int], object]]) -> tuple[list[int], dict]:
    """Combines partial partitions (sums in descending order, payload) down to one.

    Returns its sums and, for each payload, where its places went: `where[payload][i]` is the final place
    of the payload's i-th largest sum.
    """
    heap = [(-(sums[0] - sums[-1]), k, sums, [[(payload, i)] for i in range(len(sums))]) for k, (sums, payload) in enumerate(parts)]
    heapq.heapify(heap)
    k = len(heap)
    while len(heap) > 1:
        _, _, a, own_a = heapq.heappop(heap)
        _, _, b, own_b = heapq.heappop(heap)
        joined = [(a[i] + b[-1 - i], i) for i in range(len(a))]
        joined.sort(key=lambda x: (-x[0], x[1]))
        owners = []
        for _, i in joined:
            small, large = sorted((own_a[i], own_b[-1 - i]), key=len)
            large.extend(small)
            owners.append(large)
        sums = [s for s, _ in joined]
        heapq.heappush(heap, (-(sums[0] - sums[-1]), k, sums, owners))
        k += 1
    where: dict = {}
    _, _, sums, owners = heap[0]
    for place, own in enumerate(owners):
        for payload, i in own:
            where.setdefault(payload, {})[i] = place
    return sums, where


def _within(shards: int):
    def within(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        """One bucket of parts (`part`, `bytes`): the place of each, and the sum of that place."""
        table = table.sort_by([("bytes", "descending"), ("part", "ascending")])
        size = table["bytes"].to_pylist()
        sums, where = difference([([s, *[0] * (shards - 1)], k) for k, s in enumerate(size)])
        place = [where[k][0] for k in range(len(size))]
        return pa.table({"part": table["part"], "bucket": pa.array([key[0].as_py()] * len(size), pa.int64()), "place": pa.array(place, pa.int32()), "sum": pa.array([sums[p] for p in place], pa.int64())})

    return within


def _placed(parts: DataFrame, shards: int) -> DataFrame:
    """(part, place) for parts (part, bytes): differenced in buckets, and the buckets' parts likewise."""
    buckets = -(-parts.count() // BUCKET)
    bucket = F.pmod(F.xxhash64("part"), F.lit(max(1, buckets))).alias("bucket")
    own = checkpointed(parts.select("part", "bytes", bucket).groupBy("bucket").applyInArrow(_within(shards), "part string, bucket long, place int, sum long"))
    if buckets <= 1:
        return own.select("part", "place")
    name = F.concat_ws(":", "bucket", "place")
    above = _placed(checkpointed(own.groupBy("bucket", "place").agg(F.first("sum").alias("bytes")).select(name.alias("part"), "bytes")), shards)
    return own.select("part", name.alias("above")).join(above.withColumnRenamed("part", "above"), "above").select("part", "place")


def balanced_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, size (bytes + 1), text_crc32, law, shard, slot (gapless in a shard)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = checkpointed(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("digest"), F.monotonically_increasing_id().alias("row")))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    fine, most = max(1, total // (32 * shards)), total // shards
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    groups = groups.withColumn("pieces", F.when(F.col("bytes") > most, F.ceil(F.col("bytes") / F.lit(fine))).otherwise(1).cast("int"))
    groups = groups.withColumn("salts", F.when(F.col("n") > count // (4 * shards), SALTS).otherwise(1))
    groups = checkpointed(groups)
    large = F.broadcast(groups.where("pieces > 1 or salts > 1").select("digest", "pieces", "salts"))  # fewer than 5 * shards groups
    deal = lambda seed, parts: F.pmod(F.xxhash64(F.lit(seed), "doc_id", "row"), F.coalesce(parts, F.lit(1))).cast("int")
    rows = rows.join(large, "digest", "left").withColumn("piece", deal(1, "pieces")).withColumn("salt", deal(2, "salts")).drop("pieces", "salts")
    sizes = rows.groupBy("digest", "piece").agg(F.sum("size").alias("bytes"))
    placed = _placed(checkpointed(sizes.select(F.concat_ws("/", "digest", "piece").alias("part"), "bytes")), shards)
    cut = F.split("part", "/")
    named = placed.select(cut[0].alias("digest"), cut[1].cast("int").alias("piece"), F.col("place").alias("shard"))
    named = named.join(large.select("digest", "salts"), "digest", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    dealt = rows.join(named.select("digest", "piece", "salt", "shard"), ["digest", "piece", "salt"]).select("doc_id", "size", "text_crc32", "shard", "row")
    # slots: number the rows of each shard within blocks of rows, then shift each block by those before it
    blocks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = checkpointed(dealt.withColumn("block", F.pmod(F.xxhash64("doc_id", "row"), F.lit(blocks)).cast("int")))
    counts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n"))
    shift = F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")
    starts = F.broadcast(counts.select("shard", "block", shift.alias("start")))  # shards * blocks rows
    number = F.row_number().over(Window.partitionBy("block", "shard").orderBy("doc_id", "text_crc32", "size")) - 1
    return dealt.withColumn("number", number).join(starts, ["shard", "block"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("number")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
