"""Rows that every operator has to bear: nulls, empty and long texts, repeats, clashing column names."""

from pyspark.sql import functions as F

EDGES = [
    (1_000_001, None),
    (1_000_002, ""),
    (1_000_003, " \n\t "),
    (1_000_004, "one"),
    (1_000_005, "A b c \U0001f600 " * 3),
    (1_000_006, "long words again and again. " * 4000),
    (1_000_007, "twice the same text, told again to the letter, with enough bytes for a window"),
    (1_000_008, "twice the same text, told again to the letter, with enough bytes for a window"),
    (1_000_008, "twice the same text, told again to the letter, with enough bytes for a window"),
    (None, "no id"),
]


def with_edges(spark, sf_dir, limit=None):
    """Rows of the documents table and EDGES, with columns named as the operators' own."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()][:limit] + EDGES
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "g", "bucket", "key", "label", "score", "size", "digest", "items", "n_words", "shard", "spans"):
        docs = docs.withColumn(name, F.lit("x"))
    return rows, docs


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")
