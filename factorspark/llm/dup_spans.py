"""Suffix-array deduplication of repeated byte strings (operator 2).

`remove_repeats` removes every byte that is covered by a `length`-byte string which also starts in a
document with a smaller id. The earlier copy always stays.

Longest previous factors of a whole corpus cannot come from one suffix array, so the array is cut by
content. Each window of `length` bytes has an anchor: the position of the smallest hash among the
k-grams in it, which depends on the window's bytes alone. Windows of one anchor that follow each other
form a snippet of at most 2 * length - k bytes, and equal windows, wherever they stand, lie in snippets
with equal anchors. So it is enough to suffix-sort the snippets of each anchor bucket:

1. documents are dealt out by a hash of their id into groups; each group sends its anchors' hashes
   (4 bytes for some 16 bytes of text), to buckets dealt out by that hash, and hears which are shared;
2. for shared anchors it sends the snippet, once per distinct snippet, with the smallest id that has it;
3. a bucket lays the distinct snippets behind each other in order of the ids and builds the suffix array to
   depth `length`. The nearest entries before and after a suffix in that order whose document is smaller are
   where its longest previous factor stands: the factor reaches `length` if one of the two shares that many
   bytes. The bucket answers with a bit for each window;
4. the group marks the windows in its texts.

A string in a third of all documents reaches a bucket once per group, not once per document. Only
hashes of k-grams and the bytes of shared snippets are shuffled, besides one exchange of the texts that
all passes share. No answer rests on a hash: snippets of equal hashes are compared byte by byte. The
number of groups and of buckets follows the bytes of the texts, so a task's memory does not grow with them.

Defined results: a NULL or empty text has no bytes and no spans; texts under `length` bytes stay whole;
rows with the same id never cover each other; other columns of the input are dropped.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import SLICE_BYTES, U64, binary, mix, powers, prefix_hash, ragged, rolling_hash, same_bytes, utf8

GRAM = 20
#: Text of a group, and text for which there is one bucket (the number of shuffle partitions at least).
GROUP_BYTES, BUCKET_BYTES = 32 << 20, 128 << 20
#: Parts of a bucket that are suffix-sorted one after another, which bounds a task's memory.
PARTS = 8
_HIGH, _LOW = U64(0xFFFFFFFF00000000), U64(0xFFFFFFFF)


def _windows(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Snippets of a group: anchor hash, snippet hash, first window, number of windows, row."""
    out = []
    for a, b in _row_slices(offsets):
        low = offsets[a]
        part, ends = data[low : offsets[b]], offsets[a : b + 1] - low
        n = len(part)
        if n >= length:
            prefix = prefix_hash(part)
            grams = mix((prefix[gram:] - prefix[:-gram]) * powers(n)[1][: n - gram + 1])
            least = (grams & _HIGH) | np.arange(len(grams), dtype=U64)
            size, wide = 1, length - gram + 1
            while size < wide:
                step = min(size, wide - size)
                least = np.minimum(least[:-step], least[step:])
                size += step
            row = np.repeat(np.arange(b - a), np.diff(ends))[: len(least)]
            at = np.arange(len(least))
            fits = at + length <= ends[row + 1]
            anchor = (least & _LOW).astype(np.int64)
            change = np.ones(len(least), bool)
            change[1:] = (anchor[1:] != anchor[:-1]) | ~fits[:-1]
            first = np.flatnonzero(fits & change)
            stop = np.ones(len(least), bool)
            stop[:-1] = change[1:] | ~fits[1:]
            last = np.flatnonzero(fits & stop)
            out.append((grams[anchor[first]], rolling_hash(prefix, first, last + length), first + low, last - first + 1, row[first] + a))
    if not out:
        return np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _slot(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> U64(32)) % U64(buckets * PARTS)) << U64(32) | (anchor & _LOW)


def _cuts(slot: np.ndarray, buckets: int, parts: int = 1) -> np.ndarray:
    """Where each bucket (or part of one) begins in ordered slots, and the end."""
    return np.searchsorted((slot >> U64(32)) // U64(PARTS // parts), np.arange(buckets * parts + 1, dtype=U64))


def _changes(data: np.ndarray, start: np.ndarray, size: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Of snippets ordered by `keys`, which ones differ from the one before, in a key or in a byte."""
    new = np.ones(len(start), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in (*keys, size)])
    alike = np.flatnonzero(~new)
    new[alike] = ~same_bytes(data, start[alike], start[alike - 1], size[alike])
    return new


class _Group:
    """What each pass derives again from a group's texts, the same each time."""

    def __init__(self, table: pa.Table, length: int, buckets: int):
        self.table = table.sort_by("doc_id")
        self.ids = self.table["doc_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        self.data, self.offsets = utf8(self.table["text"])
        anchor, self.content, self.first, self.count, self.row = _windows(self.data, self.offsets, length, GRAM)
        self.slot, self.length, self.buckets = _slot(anchor, buckets), length, buckets

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct slots in order, and whether several documents of the group have one."""
        order = np.lexsort((self.row, self.slot))
        slot, doc = self.slot[order], self.ids[self.row[order]]
        new = np.ones(len(slot), bool)
        new[1:] = slot[1:] != slot[:-1]
        at = np.flatnonzero(new)
        return slot[at], (np.minimum.reduceat(doc, at) != np.maximum.reduceat(doc, at)) if len(at) else new

    def entries(self, answers: dict[int, bytes]):
        """Distinct snippets of shared anchors: slot, a row that has it (the smallest id), and for each
        occurrence its index and entry."""
        slot, _ = self.anchors()
        cut = _cuts(slot, self.buckets)
        shared = np.zeros(len(slot), bool)
        for k in range(self.buckets):
            if cut[k] < cut[k + 1]:
                shared[cut[k] : cut[k + 1]] = np.unpackbits(np.frombuffer(answers[k], np.uint8), count=int(cut[k + 1] - cut[k])).astype(bool)
        use = np.flatnonzero(shared[np.searchsorted(slot, self.slot)]) if len(slot) else np.zeros(0, np.int64)
        order = use[np.lexsort((self.row[use], self.content[use], self.slot[use]))]
        new = _changes(self.data, self.first[order], self.count[order] + self.length - 1, self.slot[order], self.content[order])
        return order[new], order, np.cumsum(new) - 1


def _ask(length: int, buckets: int):
    def ask(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        slot, many = _Group(table, length, buckets).anchors()
        cut = _cuts(slot, buckets)
        rows = [k for k in range(buckets) if cut[k] < cut[k + 1]]
        low = (slot & _LOW).astype(np.uint32) ^ ((slot >> U64(32)) % U64(PARTS) << U64(29)).astype(np.uint32)
        return pa.table({"bucket": pa.array(rows, pa.int32()), "g": pa.array([key[0].as_py()] * len(rows), pa.int32()), "anchors": pa.array([low[cut[k] : cut[k + 1]].tobytes() for k in rows], pa.binary()), "many": pa.array([np.packbits(many[cut[k] : cut[k + 1]]).tobytes() for k in rows], pa.binary())})

    return ask


def _share(table: pa.Table) -> pa.Table:
    parts = [np.frombuffer(x, np.uint32) for x in table["anchors"].to_pylist()]
    many = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(p)) for x, p in zip(table["many"].to_pylist(), parts, strict=True)])
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    value = every[order]
    shared = np.zeros(len(every), bool)
    same = value[1:] == value[:-1]
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    shared |= many.astype(bool)
    ends = np.cumsum([len(p) for p in parts])
    bits = [np.packbits(shared[e - len(p) : e]).tobytes() for e, p in zip(ends, parts, strict=True)]
    return pa.table({"bucket": table["bucket"], "g": table["g"], "bits": pa.array(bits, pa.binary())})


def _send(length: int, buckets: int):
    def send(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        names = ("bucket", "g", "ids", "counts", "snippets")
        types = (pa.int32(), pa.int32(), *[pa.list_(pa.binary())] * 3)
        out = {n: [] for n in names}
        if docs.num_rows:
            group = _Group(docs, length, buckets)
            entry, _, _ = group.entries(dict(zip(answers["bucket"].to_pylist(), answers["bits"].to_pylist(), strict=True)))
            cut = _cuts(group.slot[entry], buckets, PARTS)
            for k in range(0, buckets * PARTS, PARTS):
                if cut[k] < cut[k + PARTS]:
                    ids, counts, snippets = [], [], []
                    for low, high in zip(cut[k : k + PARTS], cut[k + 1 : k + PARTS + 1], strict=True):
                        own = entry[low:high]
                        ids.append(group.ids[group.row[own]].astype(np.int64).tobytes())
                        counts.append(group.count[own].astype(np.uint8).tobytes())
                        snippets.append(zlib.compress(group.data[ragged(group.first[own], group.count[own] + length - 1)].tobytes(), 1))
                    for n, x in zip(names, (k // PARTS, key[0].as_py(), ids, counts, snippets), strict=True):
                        out[n].append(x)
        return pa.table({n: pa.array(out[n], t) for n, t in zip(names, types, strict=True)})

    return send


def prefix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Rank of the suffix at each position in the suffix order to depth `length` (at least 8), by prefix doubling;
    positions in the last length - 1 bytes have none that counts.

    A rank is the place of the first suffix that is equal to the depth so far; only suffixes that have others beside
    them at their place are sorted again at the next depth.
    """
    n = len(text) - 7
    key = np.zeros(n, U64)
    for j in range(8):
        key = (key << U64(8)) | text[j : n + j].astype(U64)
    rank, size = np.zeros(n + length, np.int64), 8
    active, old = np.argsort(key), None
    key = key[active]
    while True:
        new = np.ones(len(active), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(active)))
        if old is None:
            place = np.repeat(first, count)
        else:  # places within what was equal before
            head = np.ones(len(active), bool)
            head[1:] = old[1:] != old[:-1]
            start = np.flatnonzero(head)
            start = np.repeat(start, np.diff(np.append(start, len(active))))
            place = old + np.repeat(first, count) - start
        rank[active] = place
        if size >= length:
            return rank[:n]
        step = min(size, length - size)
        active = active[np.repeat(count > 1, count)]
        key = rank[active].astype(U64) << U64(32) | rank[active + step].astype(U64)
        order = np.argsort(key)
        active, key = active[order], key[order]
        old = (key >> U64(32)).astype(np.int64)
        size += step


def smaller_before(value: np.ndarray) -> np.ndarray:
    """For each place, the nearest one before it with a smaller value, or -1: up a tree of minima to the first
    smaller left neighbour, then down it to the last place."""
    n = len(value)
    size = 1 << max(1, (n - 1).bit_length())
    tree = np.full(2 * size, np.iinfo(np.int64).max)
    tree[size : size + n] = value
    level = size
    while level > 1:
        np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2], out=tree[level // 2 : level])
        level //= 2
    node = np.arange(size, size + n)
    climbing = np.arange(n)
    while len(climbing):
        at = node[climbing]
        found = (at & 1 == 1) & (tree[at - 1] < value[climbing])
        node[climbing] = np.where(found, at - 1, at >> 1)
        climbing = climbing[~found & (at >> 1 > 1)]
    none = node <= 1
    down = np.flatnonzero(~none & (node < size))
    while len(down):
        right = 2 * node[down] + 1
        node[down] = np.where(tree[right] < value[down], right, right - 1)
        down = down[node[down] < size]
    return np.where(none, -1, node - size)


def longest_previous(rank: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each suffix has the full depth, in suffix order: `rank` tells to
    that depth which suffixes are equal, and previous are those of a smaller owner. The longest common prefix with
    any of them is that with the nearest one before or after in suffix order."""
    out = np.zeros(len(rank), bool)
    same = rank[1:] == rank[:-1]
    # the common prefix with a neighbour is the longest there is: without one of full depth, no factor has it
    some = np.flatnonzero(np.concatenate((same, [False])) | np.concatenate(([False], same))) if len(rank) else out
    rank, owner, n = rank[some], owner[some], len(some)
    before = smaller_before(owner)
    after = n - 1 - smaller_before(owner[::-1])[::-1]
    out[some] = ((before >= 0) & (rank[before] == rank)) | ((after < n) & (rank[np.minimum(after, n - 1)] == rank))
    return out


def covered_windows(doc: np.ndarray, count: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """For each snippet (its document, its number of windows, its bytes), a bit for each window that a
    snippet of a smaller document also has."""
    size = count + length - 1
    start = np.cumsum(size) - size
    content = rolling_hash(prefix_hash(data), start, start + size)
    # equal snippets are suffix-sorted once, for the smallest id
    order = np.lexsort((doc, content))
    new = _changes(data, start[order], size[order], content[order])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(new) - 1
    head = order[new]
    by_id = np.argsort(doc[head], kind="stable")
    head = head[by_id]
    place = np.empty(len(head), np.int64)
    place[by_id] = np.arange(len(head))
    kind = place[kind]
    text = data[ragged(start[head], size[head])]
    begin = np.cumsum(count[head]) - count[head]
    window = ragged(np.cumsum(size[head]) - size[head], count[head])
    owner = np.repeat(doc[head], count[head])
    rank = prefix_ranks(text, length)[window]
    suffix_array = np.argsort(rank, kind="stable")
    covered = np.zeros(len(window), bool)
    covered[suffix_array] = longest_previous(rank[suffix_array], owner[suffix_array])
    bit = (np.arange(len(window)) - np.repeat(begin, count[head])).astype(U64)
    mask = np.bitwise_or.reduceat(np.where(covered, U64(1) << bit, U64(0)), begin)
    full = (U64(1) << count.astype(U64)) - U64(1)
    return np.where(doc > doc[head][kind], full, mask[kind]).astype(np.uint32)


def _match(length: int):
    def match(table: pa.Table) -> pa.Table:
        rows = {c: table[c].to_pylist() for c in ("ids", "counts", "snippets")}
        masks: list[list[bytes]] = [[] for _ in range(table.num_rows)]
        for part in range(PARTS):
            ids = [np.frombuffer(x[part], np.int64) for x in rows["ids"]]
            doc = np.concatenate(ids)
            if not len(doc):
                continue
            count = np.concatenate([np.frombuffer(x[part], np.uint8) for x in rows["counts"]]).astype(np.int64)
            data = np.frombuffer(b"".join([zlib.decompress(x[part]) for x in rows["snippets"]]), np.uint8)
            answer = covered_windows(doc, count, data, length)
            ends = np.cumsum([len(x) for x in ids])
            for mask, e, x in zip(masks, ends, ids, strict=True):
                mask.append(answer[e - len(x) : e].tobytes())
        return pa.table({"bucket": table["bucket"], "g": table["g"], "masks": pa.array([b"".join(m) for m in masks], pa.binary())})

    return match


_OUT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _row_slices(offsets: np.ndarray) -> list[tuple[int, int]]:
    out, a = [], 0
    while a < len(offsets) - 1:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + SLICE_BYTES, "right")) - 1)
        out.append((a, b))
        a = b
    return out


def _hits(group: _Group, shared: dict[int, bytes], masks: dict[int, bytes]) -> np.ndarray:
    """1 at each byte of the group's texts where a covered window starts."""
    hit = np.zeros(len(group.data), np.int8)
    entry, occurrence, kind = group.entries(shared)
    if len(entry):
        own = np.frombuffer(b"".join(masks[k] for k in sorted(masks)), np.uint32)[kind].astype(U64)
        count = group.count[occurrence]
        later = group.ids[group.row[occurrence]] > group.ids[group.row[entry]][kind]
        own = np.where(later, (U64(1) << count.astype(U64)) - U64(1), own)
        some = own > 0
        first, count, own = group.first[occurrence][some], count[some], own[some]
        for low in range(0, len(first), 1 << 16):
            f, c, o = (x[low : low + (1 << 16)] for x in (first, count, own))
            where = ragged(f, c)
            hit[where[(np.repeat(o, c) >> (where - np.repeat(f, c)).astype(U64)) & U64(1) > 0]] = 1
    return hit


def _cover(group: _Group, hit: np.ndarray, a: int, b: int) -> list[pa.Array]:
    """n_bytes, spans and kept of the rows a to b."""
    offsets = group.offsets[a : b + 1] - group.offsets[a]
    data, hit = (x[group.offsets[a] : group.offsets[b]] for x in (group.data, hit))
    n, length = len(data), group.length
    total = np.concatenate((np.zeros(length, np.int32), np.cumsum(hit, dtype=np.int32)))
    covered = total[length:] > total[:n]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(covered & (edge[:n] | ~np.concatenate(([False], covered))[:n]))
    end = np.flatnonzero(covered & (edge[1:] | ~np.concatenate((covered, [False]))[1:])) + 1
    row = np.searchsorted(offsets, start, "right") - 1
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(start - offsets[row]), pa.array(end - offsets[row])], ["start", "end"]))
    return [pa.array(np.diff(offsets)), spans, binary(data[~covered], np.concatenate(([0], np.cumsum(~covered)))[offsets])]


def _mark(length: int, buckets: int):
    def mark(key: tuple[pa.Scalar, ...], docs: pa.Table, answers: pa.Table) -> pa.Table:
        group = _Group(docs, length, buckets)
        shared, masks = {}, {}
        for k, bits, mask in zip(*(answers[c].to_pylist() for c in ("bucket", "bits", "masks")), strict=True):
            if mask is None:
                shared[k] = bits
            else:
                masks[k] = mask
        hit = _hits(group, shared, masks)
        parts = [_cover(group, hit, *x) for x in _row_slices(group.offsets)]
        names = ["doc_id", "n_bytes", "spans", "kept"]
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([group.table["doc_id"].combine_chunks().slice(a, b - a), *x], names=names) for (a, b), x in zip(_row_slices(group.offsets), parts, strict=True)])

    return mark


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_bytes, spans (removed byte ranges, maximal, in order), kept (the other bytes)."""
    if not GRAM < length <= GRAM + 31:
        raise ValueError(f"length must be {GRAM + 1} to {GRAM + 31}")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = docs.agg(F.sum(F.octet_length(text_col).cast("long"))).first()[0] or 0
    groups, buckets = max(2 * n, -(-size // GROUP_BYTES)), max(n, -(-size // BUCKET_BYTES))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int").alias("g"), "doc_id", "text").repartition(max(n, groups // 2), "g")
    asked = texts.groupBy("g").applyInArrow(_ask(length, buckets), "bucket int, g int, anchors binary, many binary")
    shared = asked.groupBy("bucket").applyInArrow(_share, "bucket int, g int, bits binary")
    sent = texts.groupBy("g").cogroup(shared.groupBy("g")).applyInArrow(_send(length, buckets), "bucket int, g int, ids array<binary>, counts array<binary>, snippets array<binary>")
    masks = sent.groupBy("bucket").applyInArrow(_match(length), "bucket int, g int, masks binary")
    answers = shared.select("bucket", "g", "bits", F.lit(None).cast("binary").alias("masks")).unionByName(masks.select("bucket", "g", F.lit(None).cast("binary").alias("bits"), "masks"))
    return texts.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(_mark(length, buckets), _OUT)

