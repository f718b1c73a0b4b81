"""Secret scan: keyword automaton, anchored expressions at the hits, checksum validation (operator 6).

An Aho-Corasick automaton finds the keywords of all kinds in one pass over each whole text. Only where a
keyword ends is the expression of its kind tried, anchored at the keyword's start. Kinds:

* `assign`: a name such as password or api_key, then : or =, then a value of 6 or more characters;
* `access`: AKIA and more capitals and digits, 20 characters or more in all;
* `hex`: a run of 24 or more lower-case hex digits. It has no keyword, so the run itself is searched for;
* `crc`: a platform token, prefix + 30 + 6 base62 characters, of which the last six must be the CRC-32
  of the 30 before them: the embedded checksum rules out look-alikes.

Matches of a kind do not overlap and are taken from the left; a match that fails its length test is
dropped after it has used up its characters, as if found by one scan of the expression. Positions are
code points. NULL and empty texts have no spans. Other columns of the input are dropped.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

# The kinds in order, their keywords and expressions.
KINDS = ("assign", "access", "hex", "crc")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_automaton: ahocorasick.Automaton | None = None


def _keywords() -> ahocorasick.Automaton:
    global _automaton
    if _automaton is None:
        _automaton = ahocorasick.Automaton()
        for kind, words in (("assign", NAMES), ("access", ("akia",)), ("crc", PREFIXES)):
            for word in words:
                _automaton.add_word(word, (kind, len(word)))
        _automaton.make_automaton()
    return _automaton


def checksum62(body: str) -> str:
    """CRC-32 of `body` as six base62 digits."""
    value, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = BASE62[digit] + out
    return out


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of each secret, in order."""
    folded = text.encode().lower().decode() if not text.isascii() else text.lower()  # A-Z only: positions stay
    hits: dict[str, list[int]] = {"assign": [], "access": [], "crc": []}
    for end, (kind, size) in _keywords().iter(folded):
        hits[kind].append(end + 1 - size)
    out, used = [], 0
    for start in sorted(hits["assign"]):
        if start >= used and (m := ASSIGN.match(text, start)):
            used = m.end()
            if m.end(2) - m.start(2) >= 6:
                out.append((start, 0, used))
    used = 0
    for start in hits["access"]:
        if start >= used and (m := ACCESS.match(text, start)):
            used = m.end()
            if used - start >= 20:
                out.append((start, 1, used))
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for start in hits["crc"]:
        if (m := CHECKED.match(text, start)) and checksum62(m[1]) == m[2]:
            out.append((start, 3, m.end()))
    return sorted(out)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """`text` with each secret replaced by its kind in angle brackets; overlapping ones by the first."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join(out) + text[at:]


@F.pandas_udf(T.StringType())
def redacted(text: pd.Series) -> pd.Series:
    """The column's texts without secrets; NULL stays NULL."""
    return text.map(lambda t: redact(t, found) if t and (found := find_secrets(t)) else t)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, spans (array of kind, start, end, in order), digest (SHA-256 of the spans of
    the kinds assign, access and hex as kind:start:end, joined by commas), redacted (the text without secrets)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                spans, digests, redacted = [], [], []
                for text in part.column("text").to_pylist():
                    found = find_secrets(text) if text else []
                    spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in found])
                    digests.append(hashlib.sha256(",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in found if k < 3]).encode()).hexdigest())
                    redacted.append(redact(text, found) if found else text)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(spans, spans_type), pa.array(digests, pa.string()), pa.array(redacted, pa.string())], names=["doc_id", "spans", "digest", "redacted"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(scan, "doc_id long, spans array<struct<kind: string, start: long, end: long>>, digest string, redacted string")
