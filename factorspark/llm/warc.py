"""WARC archives with deduplicated payloads and a merged capture index (operator 8).

Writing: one record per page through Spark's text sink, whose line separator is the blank line that ends
a record, so the files are WARC 1.1 on any file system that Spark writes to. They are not compressed, so that
the `offset` of the index is a place to read from (the sink cannot write a gzip member per record). Of the
pages with equal payloads of at least `least` bytes, the one with the largest page_id is a response; the
others are revisits without a body that name it. Payloads are not exchanged: digests that occur once need no
join, and the others are joined by the digest, broadcast where they are few.

Reading: each file is parsed record by record, the payload of a response is checked against its digest, and
its captures are sorted by URL key (host reversed, scheme dropped) and time into a run. The runs are cut at
sampled key boundaries, and each key range merges its pieces of all runs with a loser tree, which takes one
comparison per level for each capture. The ranges in order are the globally ordered capture histories; there
are so many of them that one has about RANGE captures, however many there are.

Defined results: a NULL html is an empty payload, a NULL url an empty one; line breaks in a url are
percent-encoded; equal page_ids are records of their own. A page is dated page_id seconds after 2020-01-01;
beyond the years that a date has room for (1 to 9999), at the first or last second, so that the order of the
dates is that of the ids. A NULL page_id has an empty urn, is dated as page 0 and read back as NULL, first
among equal keys; its record is always a response, and no revisit names it. Other columns of the input are
dropped. A file holds FILE_BYTES on average.
"""

from __future__ import annotations

import hashlib
import uuid
from base64 import b32encode
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.io import shared_folder
from .graph import checkpointed, with_ids

FILE_BYTES, RANGE = 32 << 20, 50_000
EPOCH, FIRST, LAST = 1_577_836_800, -62_135_596_800, 253_402_300_799  # 2020-01-01 and the bounds of a date, in seconds
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_INDEX = "run string, url_key string, timestamp string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary or string column: each five hex digits are four letters."""
    digest = F.sha1(data)
    letters = []
    for i in range(8):
        bits = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(ALPHABET), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def records(pages: DataFrame, least: int = 0) -> tuple[DataFrame, int]:
    """The WARC records of pages (page_id, url, html) as text without the final blank line, and their mean size."""
    payload = F.coalesce("html", F.lit(""))
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.octet_length(payload).alias("size"), base32_sha1(payload).alias("digest"))
    mean = 400 + int(page.agg(F.avg("size")).first()[0] or 0)
    several = page.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1")
    several = checkpointed(several.select("digest", "owner"))
    page = with_ids(page, several, "digest", "left")
    revisit = (F.col("size") >= least) & (F.col("page_id") < F.col("owner"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    date = F.date_format(F.timestamp_seconds(EPOCH + F.greatest(F.least(F.coalesce("page_id", F.lit(0)), F.lit(LAST - EPOCH)), F.lit(FIRST - EPOCH))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    header = [
        ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        ("WARC-Target-URI", url),
        ("WARC-Date", date),
        ("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit(">"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        ("WARC-Payload-Length", F.col("size").cast("string")),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(revisit, "0").otherwise(F.col("size").cast("string"))),
    ]
    lines = [F.lit("WARC/1.1\r\n"), *[x for name, value in header for x in (F.lit(f"{name}: "), value, F.lit("\r\n"))]]
    refers = F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), "owner", F.lit(">\r\n"))).otherwise("")
    return page.select(F.concat(*lines, refers, F.lit("\r\n"), F.when(revisit, "").otherwise(F.col("payload"))).alias("value")), mean


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes the pages as WARC files under `path`."""
    rows, mean = records(pages, least)
    rows.write.options(lineSep="\r\n\r\n", compression="none", maxRecordsPerFile=max(1, FILE_BYTES // mean)).text(path)


def url_key(url: str) -> str:
    """Sort key of a URL: host labels reversed, then path and query, without scheme, port and fragment."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").lower()
    except ValueError:
        return url
    labels = host.removeprefix("www.").split(".")[::-1]
    return ",".join(labels) + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def parse(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, header fields, body) of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines[1:])
        stop = end + 4 + int(fields["Content-Length"])
        yield at, fields, data[end + 4 : stop]
        if data[stop : stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} does not end where its length says")
        at = stop + 4


def _page(urn: str) -> int | None:
    page = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(page) if page else None


def _order(page: int | None) -> tuple[bool, int]:
    """Sort key of a page_id: NULL first, as in Spark."""
    return page is not None, page or 0


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            rows = []
            for at, fields, body in parse(content.as_py()):
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(fields["WARC-Payload-Length"])
                revisit = fields["WARC-Type"] == "revisit"
                if not revisit and (len(body) != size or b32encode(hashlib.sha1(body).digest()).decode() != digest):
                    raise ValueError(f"{path}: the payload at byte {at} does not match its digest")
                url = fields["WARC-Target-URI"]
                rows.append((path, url_key(url), fields["WARC-Date"], _page(fields["WARC-Record-ID"]), url, fields["WARC-Type"], _page(fields["WARC-Refers-To"]) if revisit else None, size, digest, at))
            rows.sort(key=lambda r: (*r[1:3], _order(r[3]), r[9]))
            names = [c.split()[0] for c in _INDEX.split(", ")]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=_schema())


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in _INDEX.split(", "))])


class LoserTree:
    """Merges sorted runs: each inner node holds the loser of its match, the top the overall winner."""

    def __init__(self, runs: list[list[tuple]]):
        self.runs = runs
        self.at = [0] * len(runs)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.loser = [-1] * self.size
        self.winner = self._build(1)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run `a` is next before run `b`; runs that are used up come last."""
        if b < 0 or self.at[b] >= len(self.runs[b]):
            return True
        if a < 0 or self.at[a] >= len(self.runs[a]):
            return False
        return (self.runs[a][self.at[a]], a) < (self.runs[b][self.at[b]], b)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size if node - self.size < len(self.runs) else -1
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self._beats(a, b):
            self.loser[node] = b
            return a
        self.loser[node] = a
        return b

    def __iter__(self) -> Iterator[tuple]:
        while self.winner >= 0 and self.at[self.winner] < len(self.runs[self.winner]):
            run = self.winner
            yield self.runs[run][self.at[run]]
            self.at[run] += 1
            node, best = (run + self.size) // 2, run
            while node:
                if not self._beats(best, self.loser[node]):
                    best, self.loser[node] = self.loser[node], best
                node //= 2
            self.winner = best


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One key range: its pieces of the runs, each in order, merged."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    table = pa.Table.from_batches(held)
    url, time, page, offset = (table[c].to_pylist() for c in ("url_key", "timestamp", "page_id", "offset"))
    keys = list(zip(url, time, map(_order, page), offset, range(table.num_rows), strict=True))
    runs: dict[str, list[tuple]] = {}
    for key, run in zip(keys, table["run"].to_pylist(), strict=True):
        runs.setdefault(run, []).append(key)
    order = [key[-1] for key in LoserTree(list(runs.values()))]
    yield from table.take(pa.array(order, pa.int64())).combine_chunks().to_batches()


def capture_index(spark: SparkSession, path: str) -> DataFrame:
    """The archives' captures in global order of URL key and time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    runs = checkpointed(files.mapInArrow(_read, _INDEX))
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE))
    cut = runs.repartitionByRange(ranges, "url_key", "timestamp", "page_id")
    return cut.sortWithinPartitions("run", "url_key", "timestamp", "page_id", "offset").mapInArrow(_merge, _INDEX)


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes `pages` to archives in the shared checkpoint folder, reads them back and returns their index."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least)
    return capture_index(spark, path)
