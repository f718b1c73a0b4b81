"""Operators 11 to 13 against brute force, and their edges."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from factorspark.llm import divergence, simhash, turn_trie
from tests.llm.helpers import empty, with_edges

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# operator 11
def plain_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    nodes = defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = abs(c) // 5 * 5 * (1 if c >= 0 else -1)
        seq = own.get(base, [])[:h] + turns[h:]
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append((c, len(seq) == d))
    kids = defaultdict(list)
    for path in nodes:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(nodes, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        saved[path] = sum(saved[k] for k in kids[path]) + (len(nodes[path]) - 1) * (len(path[-1][1].encode()) if path else 0)
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c, here in sorted(members) if here)
        parent = min(c for c, _ in nodes[path[:-1]]) if path else None
        out.append((min(c for c, _ in members), len(path), parent, len(members), len(kids[path]), leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r))


def conversation_rows(seed=3):
    rng = random.Random(seed)
    words = ["hi", "what is é?", "", "yes", "no", None]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(words)) for c in range(-12, 60) for t in range(rng.randrange(0, 7))]
    rows += [(c, t, "user", "same") for c in range(100, 180) for t in range(12)]  # equal conversations
    rows += [(200, None, "user", "no turn number"), (200, 1, "a", "x"), (200, 1, "a", "x"), (200, 1, "a", "w"), (None, 1, "user", "no conversation"), (203, t := 1, "user", "t" * 100_000)]
    rows += [(301, k, "user", f"turn {k}") for k in range(500)] + [(300, k, "user", f"turn {k}") for k in range(300)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece", [1 << 16, 40, 1])
def test_trie_equals_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(turn_trie, "PIECE", piece)
    rows = conversation_rows()
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    for name in ("id", "ids", "path", "shard", "key", "bytes", "digest"):
        turns = turns.withColumn(name, F.lit("x"))
    out = turn_trie.conversation_trie(turns)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert ordered(out.collect()) == ordered(plain_trie(rows))


def test_trie_pieces_meet_wherever_they_are_cut():
    """The sums of the parts equal the nodes of one tree, for every size of piece."""
    rng = random.Random(5)
    seqs = sorted({tuple(rng.randrange(3) for _ in range(rng.randrange(0, 7))) for _ in range(90)})
    rows = [(list(s), [k + 1 for k in s], rng.randrange(1, 4), rng.randrange(1000), "e") for s in seqs]
    whole = {}
    for step in (len(rows), 1, 2, 7, 30):
        found = defaultdict(lambda: [0, 0, 0, 0])
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            before = turn_trie.common(rows[k - 1][0], part[0][0]) if k else -1
            after = turn_trie.common(part[-1][0], rows[k + step][0]) if k + step < len(rows) else -1
            for key, parent, depth, least, up, *figures, ends in turn_trie.piece_nodes(part, before, after):
                own = len(found) if key is None else key  # nodes without a key are whole
                found[own] = [a + b for a, b in zip(found[own], figures, strict=True)]
        figures = sorted(map(tuple, found.values()))
        whole = whole or figures
        assert figures == whole


def test_trie_of_nothing(spark):
    assert turn_trie.conversation_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    rows = [(5, 0, "a", "x"), (6, 0, "a", "y")]
    assert ordered(turn_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()) == ordered(plain_trie(rows))


def test_ternary_tree_is_balanced_by_median_insertion():
    tree = turn_trie.TernaryTree()
    assert sorted(turn_trie.median_order(1000)) == list(range(1000))
    for k in turn_trie.median_order(1000):
        tree.insert([k], [1], 1, k)
    height, todo = 0, [(tree.down[0], 1)]
    while todo:
        at, deep = todo.pop()
        if at >= 0:
            height = max(height, deep)
            todo += [(tree.low[at], deep + 1), (tree.high[at], deep + 1)]
    assert height == 10


# operator 12
def plain_divergence(rows, least, top):
    counts, docs, whole, groups = defaultdict(int), defaultdict(set), defaultdict(int), set()
    for k, (lang, source, text) in enumerate(rows):
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        for term in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(UPPER)):
            counts[lang, source, term] += 1
            whole[lang, term] += 1
            docs[lang, term].add(k)
    out = []
    for lang, source in groups:
        kept = sorted(t for (x, t), d in docs.items() if x == lang and len(d) >= least)

        def shares(count, kept=kept):
            total = sum(map(count, kept))
            return [1 + 10**9 * (count(t) + 2) // (total + 2 * len(kept)) for t in kept]

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p = shares(lambda t, lang=lang, source=source: counts.get((lang, source, t), 0))
        q = shares(lambda t, lang=lang: whole[lang, t])
        pairs = [(-sum(map(f, p, shares(lambda t, b=b, lang=lang: counts.get((lang, b, t), 0)))), b.encode()) for x, b in groups if x == lang and b != source]
        terms = [(-f(x, y), t.encode()) for t, x, y in zip(kept, p, q, strict=True) if counts.get((lang, source, t), 0) and x > y]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            out += [(lang, source, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(sorted(found)[:most])]
    return sorted(out)


def source_rows(seed=1):
    rng = random.Random(seed)
    vocab = ["a", "The", "ÉTÉ", "straße", "eightlet", "ninelette", "x" * 16, "y" * 17, "z" * 40, "Ω" * 30, "I"] + [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(12) for j in range(9)]
    rows = []
    for k in range(400):
        source = rng.choice([None, "s1", "s2", "s2", "s2", "s3", "S3"])
        lang = rng.choice(["en", "en", None, "de"])
        rows.append((lang, source, rng.choice([" ", "9", "-_"]).join(rng.choice(vocab[: 30 + 10 * len(source or "")]) for _ in range(rng.randrange(0, 25)))))
    return rows + [("fr", "only", "seul " * 30), ("fr", "other", None), ("", "", ""), ("en", "none", None), ("it", "alone", "un\x00due\x7ftre"), ("en", "s9", "long" * 50_000)]


def test_divergence_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE", 3000)
    rows = source_rows()
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    for name in ("term", "count", "docs", "item", "p", "head", "doc_id"):
        docs = docs.withColumn(name, F.lit("x"))
    found = divergence.source_divergence(docs, least=10, top=10).collect()
    assert sorted(map(tuple, found)) == plain_divergence(rows, 10, 10)


def test_divergence_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, lang string, source string, text string")
    assert divergence.source_divergence(docs).count() == 0
    few = spark.createDataFrame([("en", "a", "x"), ("en", "b", None)], "lang string, source string, text string")
    assert sorted(map(tuple, divergence.source_divergence(few).collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_do_not_overflow(spark):
    big = 4_000_000_000_000_123
    row = spark.range(1).select(divergence.share(F.lit(big), F.lit(big + 77), F.lit(1_000_003))).first()
    assert row[0] == 1 + 10**9 * (big + 2) // (big + 77 + 2 * 1_000_003)


def test_radix_order_is_stable():
    rng = np.random.default_rng(2)
    words = [rng.integers(0, 3, 5000).astype(np.uint64) << np.uint64(40), rng.integers(0, 1 << 60, 5000).astype(np.uint64) % np.uint64(70_001)]
    assert (divergence.radix_order(words) == np.lexsort(words[::-1])).all()


# operator 13
def plain_print(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    spans = [" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius):
    label = list(range(len(prints)))
    values = np.array(prints, np.uint64)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= radius).tolist():
            a, b = label[i], label[j]
            if a != b:
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


@pytest.mark.parametrize("tile", [1 << 14, 16])
def test_simhash_equals_brute_force(spark, data, tile):
    rows, docs = with_edges(spark, data)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = random.Random(4)
    base = [rng.choice(words) + str(rng.randrange(1000)) for _ in range(400)]
    near = [" ".join(base[:k] + ["changed"] + base[k + 1 :]) for k in range(120)]
    rows += [(2_000_000 + k, text) for k, text in enumerate(near)]
    docs = docs.unionByName(spark.createDataFrame(rows[-len(near) :], "doc_id long, text string"), allowMissingColumns=True)
    prints = [plain_print(text) for _, text in rows]
    label = plain_groups(prints, 4)
    least = defaultdict(list)
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            least[label[k]].append(doc)
    want = [(doc, f"{prints[k]:016x}", min(least[label[k]], default=None)) for k, (doc, _) in enumerate(rows)]
    found = simhash.simhash_groups(docs.repartition(3), tile=tile)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(want, key=key)
    assert found.where("doc_id >= 2000000").select("component_id").distinct().count() < 60  # near copies do meet


def test_fingerprints_are_those_of_xxhash64(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").where("doc_id < 40")
    words = F.regexp_extract_all(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(r"([^\x20\x09-\x0D]+)"))
    hashes = docs.select("doc_id", words.alias("w")).where("size(w) > 3").select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 3), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 4), " ")))).alias("h"))
    bits = [F.when(2 * F.sum(F.shiftrightunsigned("h", b).bitwiseAND(1)) > F.count("*"), F.lit(1)).otherwise(0).alias(f"b{b}") for b in range(64)]
    want = {r[0]: sum(r[f"b{b}"] << b for b in range(64)) for r in hashes.groupBy("doc_id").agg(*bits).collect()}
    have = {r[0]: r[1] % (1 << 64) for r in simhash.fingerprints(docs).collect()}
    assert want and all(have[k] == v for k, v in want.items())


@pytest.mark.parametrize("tile", [8, 50, 4000])
def test_tiles_lose_no_link(spark, tile):
    rng = np.random.default_rng(tile)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.unique(np.concatenate([seeds] + [seeds ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(6)] + [np.arange(60, dtype=np.uint64)]))
    kinds = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "print long")
    found = {r[0]: r[1] for r in simhash.components(simhash.linked_prints(kinds, 4, tile)).collect()}
    label = plain_groups(prints.tolist(), 4)
    group = defaultdict(set)
    for x, k in zip(prints.view(np.int64).tolist(), label, strict=True):
        group[k].add(found.get(x, x))
    assert all(len(g) == 1 for g in group.values()) and len(set().union(*group.values())) == len(group)


def test_majority_counts_beyond_a_byte():
    hashes = np.array([3] * 400 + [1] * 399 + [5] * 2, np.uint64)
    assert simhash.majority(np.zeros(801, np.int64), hashes, 2).tolist() == [1, 0]
    hashes[:1] = 7
    assert simhash.majority(np.zeros(801, np.int64), np.concatenate((hashes[:400], hashes[:400], hashes[:1])), 1).tolist() == [3]


def test_simhash_of_nothing(spark):
    assert simhash.simhash_groups(empty(spark)).count() == 0
    assert divergence.term_counts(empty(spark).withColumns({"lang": F.lit("a"), "source": F.lit("b")})).count() == 0
