"""The corpus pipeline: stages over `documents`, each one operator of factorspark.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
`documents`. Stages work on whatever their predecessor kept. Each row is judged by its own text and
goes or stays by itself, whether its id is NULL or shared with other rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from factorspark.llm.bpe import encode_documents
from factorspark.llm.decontaminate import contaminated
from factorspark.llm.graph import checkpointed, with_ids
from factorspark.llm.neardup import near_duplicates
from factorspark.llm.queries import table
from factorspark.llm.secrets import redacted
from factorspark.llm.toxicity import toxicity_scores

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
REJECT = 0.7
ROW = "_row"


def _keyed(docs: DataFrame) -> DataFrame:
    """`docs` with a key of each row, fixed by a checkpoint."""
    return checkpointed(docs.withColumn(ROW, F.monotonically_increasing_id()))


def _without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return with_ids(rows, checkpointed(keys.select(ROW)), ROW, "left_anti").select([c for c in rows.columns if c != ROW])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a toxicity score of REJECT or more."""
    rows = _keyed(docs)
    return _without(rows, toxicity_scores(rows, table(spark, sf_dir, "labels"), key_col=ROW).where(F.col("score") >= REJECT))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group with a similarity of 0.8 or more on five-word shingles: that of the smallest id
    (NULL last), and of rows with that id the first by row key."""
    rows = _keyed(docs)
    found = checkpointed(near_duplicates(rows, k=5, percent=80, id_col=ROW).select(F.col("doc_id").alias(ROW), "component_id"))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", ROW))
    first = found.join(rows.select(ROW, "doc_id"), ROW).groupBy("component_id").agg(least.alias("least")).select(F.col(f"least.{ROW}").alias(ROW))
    return _without(rows, found.join(first, ROW, "left_anti"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item."""
    rows = _keyed(docs)
    return _without(rows, contaminated(rows, table(spark, sf_dir, "benchmark"), id_col=ROW).where("contaminated").withColumnRenamed("doc_id", ROW))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts the kind in angle brackets in the place of each secret; n_chars follows the new text."""
    out = docs.withColumn("text", redacted("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (decimal, joined by commas) of each document."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "n_tokens", "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]
#: The stages are not expressible in SQL; tests/llm/test_pipeline.py holds them against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
