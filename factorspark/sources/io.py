"""Sources and sinks: tables of one or many files in, result tables out."""

from __future__ import annotations

import datetime as dt
import hashlib
import tempfile
from collections.abc import Callable
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..functions.columns import finite
from .schemas import RENAMES

#: Input bytes to a bucket of the derived tables, which are smaller than their inputs.
BUCKET_BYTES = 256 << 20


def read_table(spark: SparkSession, path: str | list[str], schema: StructType | None = None, form: str = "parquet") -> DataFrame:
    """One table from a file, a folder or a list of them (a file per code or per period)."""
    reader = spark.read.format(form)
    if schema is not None:
        reader = reader.schema(schema)
    return (reader.option("header", True) if form == "csv" else reader).load(path)


def canonical_names(df: DataFrame, back: bool = False) -> DataFrame:
    """Vendor column names to canonical ones, or back (where several vendor names share one, the first)."""
    names = RENAMES
    if back:
        names = {}
        for vendor, own in RENAMES.items():
            names.setdefault(own, vendor)
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns and b not in df.columns})


def parse_dates(df: DataFrame, columns: list[str], drop_null: bool = True) -> DataFrame:
    """yyyymmdd numbers or strings to dates; rows without a date are dropped."""
    out = df.withColumns({c: F.to_date(F.try_to_timestamp(F.col(c).cast("string"), F.lit("yyyyMMdd"))) for c in columns})
    return out.dropna(subset=columns) if drop_null else out


def nulls_for_nan(df: DataFrame) -> DataFrame:
    """NaN and infinities to NULL in all floating columns."""
    return df.withColumns({c: finite(c) for c, kind in df.dtypes if kind in ("double", "float")})


def write_table(df: DataFrame, path: str, form: str = "parquet", by_year_of: str | None = None) -> None:
    """Writes a result; with `by_year_of`, partitioned by that date's year: years that `df` lacks stay as they are."""
    writer = (df.withColumn("year", F.year(by_year_of)) if by_year_of else df).write.mode("overwrite").format(form)
    writer = writer.option("header", True) if form == "csv" else writer
    (writer.option("partitionOverwriteMode", "dynamic").partitionBy("year") if by_year_of else writer).save(path)


def write_range(df: DataFrame, path: str, by: str, start: dt.date, end: dt.date) -> None:
    """Puts the rows of `df` from `start` to `end` (inclusive) in the place of those of a table by year (Parquet); all
    other rows stay. Only the years of the range are written, from a copy of what stays of them."""
    spark = df.sparkSession
    inside = F.col(by).between(F.lit(start), F.lit(end))
    rows = df.where(inside)
    years = F.col("year").between(start.year, end.year)
    had: set[int] = set()
    if (old := existing(spark, path)) is not None:
        shared_folder(spark)
        had = {r[0] for r in old.where(years).select("year").distinct().collect()}  # a row per year
        rest = old.where(years & ~F.coalesce(inside, F.lit(False))).drop("year").select(df.columns).checkpoint()
        rows = rows.unionByName(rest)
    write_table(rows, path, by_year_of=by)
    for year in had - {r[0] for r in rows.select(F.year(by)).distinct().collect()}:
        delete(spark, f"{path}/year={year}")


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at `path`, or None."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    return None


def delete(spark: SparkSession, path: str) -> None:
    """Removes a file or folder in any store that Spark reaches."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def fingerprint(spark: SparkSession, inputs: list[str]) -> tuple[str, int]:
    """A hash of the names, sizes and times of all files of the inputs, and their bytes; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(inputs).select("path", "length", "modificationTime")
    marks = [F.bit_xor(F.xxhash64(F.lit(k), *files.columns)) for k in range(2)]
    n, size, *found = files.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), *marks).first()
    return hashlib.sha1(repr((sorted(inputs), n, size, found)).encode()).hexdigest(), size


def load_or_compute(spark: SparkSession, path: str, compute: Callable[[], DataFrame], inputs: list[str] | None = None) -> DataFrame:
    """The table at `path`, written first if Spark finds none there. With `inputs`, the files that it is computed from,
    a table of other inputs, or of inputs that have changed since, does not count and is replaced."""
    if inputs is not None:
        folder, path = path, f"{path}/inputs={fingerprint(spark, inputs)[0]}"
    if (found := existing(spark, path)) is not None:
        return found
    if inputs is not None:
        delete(spark, folder)
    write_table(compute(), path)
    return spark.read.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; in local mode, where that is unset, a folder of our own."""
    context = spark.sparkContext
    if not context.getConf().get("spark.checkpoint.dir") and context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="factorspark-"))
    return context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()


class Stages:
    """Derived tables of some input files, each written to the shared folder when it is first asked for and read from
    then on, by all that have the same application and unchanged inputs.

    A table is known by its name, which stands for what is computed and its parameters, by the `fingerprint` of the
    inputs, and by the number of buckets, which follows from the inputs' bytes. Where an input has changed, a table is
    computed anew, and the one of the former inputs is dropped. `drop` removes all tables of the application.
    """

    def __init__(self, spark: SparkSession, inputs: list[str]):
        self.spark, self.inputs = spark, inputs

    @cached_property
    def mark(self) -> tuple[str, int]:
        return fingerprint(self.spark, self.inputs)

    @cached_property
    def buckets(self) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-self.mark[1] // BUCKET_BYTES))

    @cached_property
    def database(self) -> str:
        name = "factorspark_" + hashlib.sha1(self.spark.sparkContext.applicationId.encode()).hexdigest()[:12]
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS {name} LOCATION '{shared_folder(self.spark)}/{name}'")
        return name

    def keep(self, name: str, compute: Callable[[], DataFrame], bucket_by: str | None = None, sort_by: tuple[str, ...] = (), dealt: bool = False) -> DataFrame:
        """The table `name`; with `bucket_by` it is bucketed by that column, so that windows, aggregates and joins within
        it need no exchange. `dealt` says that the rows come out of an exchange by that column and need no further one."""
        own = "t" + hashlib.sha1(f"{sorted(self.inputs)}/{name}".encode()).hexdigest()[:16]
        table = f"{own}_{hashlib.sha1(f'{self.mark[0]}/{self.buckets}'.encode()).hexdigest()[:16]}"
        if not self.spark.catalog.tableExists(f"{self.database}.{table}"):
            df, n = compute(), self.buckets
            writer = (df if dealt else df.repartition(n, bucket_by)).write.bucketBy(n, bucket_by).sortBy(bucket_by, *sort_by) if bucket_by else df.write
            writer.mode("overwrite").saveAsTable(f"{self.database}.{table}")
            for old in self.spark.catalog.listTables(self.database, f"{own}_*"):
                if old.name != table:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self.database}.{old.name}")
        return self.spark.table(f"{self.database}.{table}")

    def folder(self, name: str) -> str:
        """A folder for files of `name` that follow from the inputs, beside the tables and dropped with them."""
        mark = hashlib.sha1(f"{sorted(self.inputs)}/{name}/{self.mark[0]}".encode()).hexdigest()[:24]
        return f"{shared_folder(self.spark)}/{self.database}/files-{mark}"

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")
        delete(self.spark, f"{shared_folder(self.spark)}/{self.database}")
        del self.database  # made again by the next use


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metrics and importances of the training windows as JSON, a folder per window."""
    metrics.write.mode("overwrite").partitionBy("window_id").json(path)
