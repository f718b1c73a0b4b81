"""Vectorised helpers for the Arrow batches that Spark hands to Python tasks.

Everything works on one slice of a batch at a time (`slices`), so a task's memory is bounded by
`SLICE_BYTES` plus the longest single text, whatever the size of the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 21
LONG_SPAN = 512
U64 = np.uint64
_BASE, _ALL = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
NO_SPACE = np.ones(256, bool)
NO_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_powers = [np.ones(1, U64), np.ones(1, U64)]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix: a bijection that spreads low entropy over all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """b^0..b^n and b^0..b^-n modulo 2^64 for the odd base of all rolling hashes."""
    if len(_powers[0]) <= n:
        size = 1 << max(16, int(n).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=U64)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] = sum of (byte + 1) * b^i over s <= i < e, modulo 2^64: a rolling hash, which picks
    places in a text and decides nothing (different bytes can be made to collide)."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(len(data))[0][:-1], dtype=U64, out=out[1:])
    return out


def rolling_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] from the prefix hash of data: cheap, for what is compared byte by byte then."""
    inverse = powers(len(prefix))[1]
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of data[start:end], equal for equal bytes wherever they stand.

    Eight bytes at a time go through `mix` with all that came before, so no pattern in the bytes cancels out.
    Spans of over LONG_SPAN bytes are hashed by BLAKE2b one by one.
    """
    size = (end - start).astype(np.int64)
    out = mix(size.astype(U64) + U64((seed + 1) * _BASE & _ALL))
    if not len(size):
        return out
    raw = np.concatenate((data, np.zeros(8, np.uint8)))
    chunks = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at, left = start[live], size[live]
    while len(live):
        spare = (U64(8) * np.maximum(8 - left, 0).astype(U64)).astype(U64)
        out[live] = mix((out[live] + U64(_BASE)) ^ ((chunks[at] << spare) >> spare))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_SPAN).tolist():
        digest = hashlib.blake2b(raw[start[k] : end[k]].data, digest_size=8, salt=seed.to_bytes(4, "little"))
        out[k] = U64(int.from_bytes(digest.digest(), "little"))
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[a:a + size] and data[b:b + size] are equal, for each of the pairs."""
    out = np.ones(len(a), bool)
    raw = np.concatenate((data, np.zeros(8, np.uint8)))
    chunks = np.ndarray(len(raw) - 7, "<u8", raw, 0, (1,))
    live, done = np.flatnonzero(size > 0), 0
    while len(live):
        spare = U64(8) * np.maximum(8 - (size[live] - done), 0).astype(U64)
        out[live] = (chunks[a[live] + done] << spare) == (chunks[b[live] + done] << spare)
        done += 8
        live = live[out[live] & (size[live] > done)]
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string or binary column; NULL is the empty string."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = pc.fill_null(column, b"" if wide == pa.large_binary() else "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of the batches with at most `most` bytes of `column` each (a longer text comes alone)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        _, offsets = utf8(batch.column(at))
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1)
            yield batch.slice(start, stop - start)
            start = stop


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of the maximal runs of bytes for which `inside` (by byte value) holds, within each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    word = inside[data]
    start = np.flatnonzero(word & (edge[:-1] | np.concatenate(([True], ~word[:-1]))))
    end = np.flatnonzero(word & (edge[1:] | np.concatenate((~word[1:], [True])))) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a slice: byte spans, row, hash and each row's first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.start, self.end, self.row = word_spans(data, offsets, NO_SPACE)
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))
        self.hash = span_hash(data, self.start, self.end)

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash) of every k-word window; a row of fewer words has one, of all its words."""
        count = np.diff(self.first)
        n = len(self.hash)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        at = np.flatnonzero(np.arange(n) + k <= self.first[self.row + 1])
        total = np.full(len(at), k, U64)
        for j in range(k):
            total = mix(total + self.hash[at + j])
        rows, hashes = [self.row[at]], [total]
        for few in range(1, k):
            short = np.flatnonzero(count == few)
            if len(short):
                total = np.full(len(short), few, U64)
                for j in range(few):
                    total = mix(total + self.hash[self.first[short] + j])
                rows.append(short)
                hashes.append(total)
        row, out = np.concatenate(rows), np.concatenate(hashes)
        if len(rows) > 1:
            order = np.argsort(row, kind="stable")
            row, out = row[order], out[order]
        return row, out


def distinct(row: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, value), in order of both."""
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[keep], value[keep]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0] .. starts[0] + lengths[0] - 1, starts[1] .., one after another."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    full = lengths > 0
    starts, lengths = starts[full], lengths[full]
    if not total:
        return out
    out[0] = starts[0]
    ends = np.cumsum(lengths)[:-1]
    out[ends] = starts[1:] - (starts[:-1] + lengths[:-1] - 1)
    return np.cumsum(out)


def binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary column of data[offsets[i]:offsets[i + 1]]."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


class Forest:
    """Union-find over 64-bit ids, for the links that one task has seen."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, a: int) -> int:
        parent = self.parent
        top = a
        while (up := parent.get(top, top)) != top:
            top = up
        while a != top:
            parent[a], a = top, parent.get(a, a)
        return top

    def union(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.parent[max(a, b)] = min(a, b)
        return True
