import base64
import hashlib
import itertools
import random
import re
import zlib

import numpy as np

from factorspark.llm import html_extract, quality_rules, queries, sharding, toxicity, warc

from .helpers import empty, with_edges


def test_main_text_of_the_template(spark, data):
    import html

    pages = spark.read.parquet(f"{data}/pages.parquet")
    edges = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "u", ""), (10**6 + 2, "u", "<p>"), (10**6 + 3, None, "plain text, no tags at all")], "page_id long, url string, html string")
    out = {r.page_id: r for r in html_extract.main_text(pages.unionByName(edges)).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.DOTALL)
        parts = re.split(r"</?(?:p|h1|h2|h3|div)[^>]*>", inner[1]) if inner else []
        parts = [" ".join(html.unescape(re.sub("<br>", " ", re.sub("</?b>", "", x))).split()) for x in parts]
        assert out[r.page_id].text == "\n".join(x for x in parts if x), r.page_id
        assert out[r.page_id].n_chars == len(out[r.page_id].text)
    assert out[10**6].text == out[10**6 + 1].text == out[10**6 + 2].text == ""
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_labeller_uses_names_and_context(spark, data):
    pages = [r.html for r in spark.read.parquet(f"{data.replace('0.001', '0.01')}/pages.parquet").collect()]
    labeller = html_extract.train_labeller(pages)
    page = (
        '<body><header class="site-header"><p>Site name</p></header><nav><a href=x>Home</a></nav><main><h1>Title</h1><p>Real text goes here, with words.</p>'
        '<aside><p>Related stuff</p></aside><div class="notice cookie">We use cookies.</div><p>More real text is here.</p><form><p>Your name</p><button>Send</button></form>'
        '<section class="comments"><h2>Comments</h2><p>I like this, thanks.</p></section></main><footer>(c) us</footer></body>'
    )
    assert html_extract.extract(labeller, [page]) == ["Title\nReal text goes here, with words.\nMore real text is here."]
    alone = html_extract.extract(labeller, pages[:30])
    assert alone == [html_extract.extract(labeller, [p])[0] for p in pages[:30]]


def test_raw_and_hidden_elements_end():
    article = "<article><p>Text</p></article>"
    for before in (
        "<script>for(i=0;i<n;i++){t+=i}</script>", "<script>a = '<!--';</script>", "<STYLE>a<b</Style >", "<title>a <b</title>", "<textarea>a <!-- b</textarea>", "<script>x = '</scripts>'</script>",
        "<datalist><option value=a><option value=b></datalist>", "<select><option>a<option>b</select>", "<select><optgroup><option>a<optgroup><option>b</select>", "<div><button>Send</div>", "<div><object>old</div>", "<svg><path/><text>s</text></svg>",
    ):
        assert [(b.text, b.path) for b in html_extract.parse_blocks(before + article)] == [("Text", ("article", "p"))], before
    for kept, want in (
        ("<p>Area <math><mi>a</mi><mo>=</mo><mn>2</mn><annotation>a=2</annotation></math> holds.</p>", ["Area a=2 holds."]),
        ("<p>One <b>two <button>Send</button> three</b> four</p>", ["One two three four"]),
        ("<p>a <option>x</p><p>b</p>", ["a", "b"]),
    ):
        assert [b.text for b in html_extract.parse_blocks(kept)] == want
        assert {b.path for b in html_extract.parse_blocks(kept)} == {("p",)}
    assert html_extract.parse_blocks("<script>never ends <p>x</p>") == []


def test_long_pages_are_read_in_pieces(spark, data, monkeypatch):
    """A page beyond STEPS blocks has the labels that it has in one piece, and batches keep to their bounds."""
    pages = [r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()]
    labeller = html_extract.train_labeller(pages[:20], examples=100)
    page = "".join(pages[:12])
    whole = html_extract.extract(labeller, [page, *pages[:5]])
    monkeypatch.setattr(html_extract, "STEPS", 40)
    monkeypatch.setattr(html_extract, "CHUNK", 7)
    assert html_extract.extract(labeller, [page, *pages[:5]]) == whole
    sizes = [3, 0, 50, 7, 7, 7, 1, 400]
    batches = list(html_extract._batches(sizes))
    assert sorted(k for b in batches for k in b) == [0, 2, 3, 4, 5, 6, 7]
    assert all(len(b) == 1 or len(b) * max(sizes[k] for k in b) <= 40 for b in batches)
    rows = [(1, "u", "<p>x</p>")] * 3 + [(None, None, "<article><p>y</p></article>"), (2, "v", None)]
    odd = spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    out = html_extract.main_text(odd).collect()
    assert len(out) == 5 and {r.n_chars == len(r.text) for r in out} == {True}


def test_labeller_gradients():
    rng = np.random.default_rng(0)
    net = html_extract.Labeller(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = rng.normal(size=(5, 3, html_extract.INPUTS)), np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0], [1, 0, 0]], bool)
    y = (rng.random((5, 3)) > 0.5).astype(float)
    loss = lambda: -(np.where(y > 0, np.log(net.forward(x, mask)), np.log(1 - net.forward(x, mask))) * mask).sum() / mask.sum()
    for name, value in net.gradients(x, mask, y).items():
        at = tuple(rng.integers(n) for n in net.p[name].shape)
        old, step = net.p[name][at], 1e-3
        net.p[name][at] = old + step
        high = loss()
        net.p[name][at] = old - step
        assert abs((high - loss()) / (2 * step) - value[at]) < 1e-3 * max(1, abs(value[at])), name
        net.p[name][at] = old


def test_shards_balance_and_slots(spark, data):
    rows, docs = with_edges(spark, data)
    rows += [(4_000_000 + k, "hot text " * 30) for k in range(100)]  # a third of all rows
    docs = docs.unionByName(spark.createDataFrame(rows[-100:], "doc_id long, text string"), allowMissingColumns=True)
    out = sharding.balanced_shards(docs, 16).collect()
    assert len(out) == len(rows)
    texts = sorted((str(d), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in out) == texts
    sums, slots, places = {}, {}, {}
    for r in out:
        sums[r.shard] = sums.get(r.shard, 0) + r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        places.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(p) == 1 for c, p in places.items() if c != zlib.crc32(b"hot text " * 30))
    assert set(sums) <= set(range(16))
    assert max(sums.values()) <= max(1.02 * sum(sums.values()) / 16, max(t[1] for t in texts))
    assert sharding.balanced_shards(empty(spark)).count() == 0


def test_shards_of_many_rows_and_levels(spark, monkeypatch):
    """Several levels of buckets and a group of NULL texts with half the rows: balanced, groups whole."""
    monkeypatch.setattr(sharding, "BUCKET", 50)
    rng = random.Random(6)
    rows = [(k if k % 9 else None, None if k % 2 else f"{k % 700} " * rng.randint(1, 60)) for k in range(4000)]
    out = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    sums, places = {}, {}
    for r in out:
        sums[r.shard] = sums.get(r.shard, 0) + r["size"]
        places.setdefault(r.text_crc32, set()).add(r.shard)
    assert len(out) == 4000 and set(sums) == set(range(8)) and all(len(p) == 1 for p in places.values())
    assert max(sums.values()) - min(sums.values()) <= 0.01 * sum(sums.values())
    assert {(r.law, r.grown_shard) for r in out} == {("bytes", None)}
    for k in range(8):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(sum(r.shard == k for r in out)))


def test_differencing_is_a_partition_and_tight():
    rng = random.Random(3)
    sizes = [rng.randint(1, 10_000) for _ in range(2000)]
    sums, where = sharding.difference([([s, 0, 0, 0], k) for k, s in enumerate(sizes)])
    got = [0] * 4
    for k, s in enumerate(sizes):
        got[where[k][0]] += s
    assert got == sums and max(sums) - min(sums) <= 10


def plain_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    again = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(lines), len(text), sum("A" <= c <= "Z" for c in text), sum("0" <= c <= "9" for c in text), sum(c in "!?=~^+@/\\_" for c in text), len(set(words))


def test_text_stats_equal_plain_ones(spark, data):
    rows, docs = with_edges(spark, data)
    out = sorted((str(r[0]), *r[1:]) for r in quality_rules.text_stats(docs).collect())
    assert out == sorted((str(d), *plain_stats(t)) for d, t in rows)
    assert quality_rules.text_stats(empty(spark)).count() == 0


def test_quality_edges(spark, data):
    """NULL, repeated and clashing rows have verdicts; labels that repeat an id count once."""
    rows, docs = with_edges(spark, data)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    from pyspark.sql import functions as F

    out = quality_rules.quality_verdicts(docs, labels.unionByName(labels), F.lit(False)).collect()
    assert len(out) == len(rows) and all(r.good in (True, False) for r in out)
    assert quality_rules.quality_verdicts(empty(spark), labels, F.lit(False)).count() == 0
    assert quality_rules.quality_verdicts(docs, labels.limit(0), F.lit(False)).where("not good").count() == 0
    many = docs.unionByName(docs).unionByName(docs)
    sample = quality_rules.labelled_sample(many, labels.unionByName(labels), "quality", 50)
    assert sample.count() == sample.select("doc_id").distinct().count() <= 50
    twin = "".join("ab"[bin(k).count("1") & 1] for k in range(4096))
    text = twin + "\n" + twin.translate(str.maketrans("ab", "ba")) + "\n" + twin
    assert quality_rules.text_stats(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().n_dup_lines == 1


def test_wrappers_have_their_columns(spark, data):
    """The registered queries' digests follow from the operators' own results."""
    from factorspark.llm import bpe, dup_spans, neardup, secrets

    docs = spark.read.parquet(f"{data}/documents.parquet")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    import public_tokenizers

    one = {r.doc_id: (r.n_tokens, sha(r.ids.encode()), sha(bytes(r.decoded))) for r in bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op1_bpe(spark, data).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()} == one
    two = {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), sha(bytes(r.kept))) for r in dup_spans.remove_repeats(docs).collect()}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op2_suffix_dedup(spark, data).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()} == two
    four = {(r.doc_id, r.n_shingles, r.component_id, r.doc_id == r.component_id) for r in neardup.near_duplicates(docs, 4).collect()}
    assert {tuple(r) for r in queries.op4_minhash(spark, data).select("doc_id", "n_shingles", "component_id", "kept").collect()} == four
    plain = {r.doc_id: [(secrets.KINDS[k], s, e) for s, k, e in secrets.find_secrets(r.text or "")] for r in docs.collect()}
    for r in queries.op6_secrets(spark, data).collect():
        want = plain[r.doc_id]
        assert r.spans == ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == kind for k, _, _ in want) for kind in ("assign", "access", "hex")]
        assert r.base_sha256 == sha(",".join(f"{k}:{s}:{e}" for k, s, e in want if k != "crc").encode())
    assert all(r.predicted == int(r.score >= 0.7) for r in queries.op10_toxicity(spark, data).collect())


def test_rules_cover_and_translate(spark, data):
    rng = np.random.default_rng(2)
    x = rng.random((600, len(quality_rules.FEATURES)))
    bad = ((x[:, 2] > 0.7) & (x[:, 4] <= 0.4)) | (x[:, 6] > 0.9)
    rules = quality_rules.learn_rules(x, bad)
    covered = np.any([quality_rules._covers(r, x) for r in rules], axis=0)
    assert (covered == bad).mean() > 0.93
    assert quality_rules.learn_rules(x, np.zeros(600, bool)) == []
    out = queries.op7_quality(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in out]) > 0.9


def test_warc_round_trip(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    edges = spark.createDataFrame([(10**6, None, None), (10**6 + 1, "http://a.b/\r\nX: y", ""), (10**6 + 2, "http://WWW.B.com:80/q?x#y", "a\r\n\r\nWARC/1.1\r\n"), (10**6 + 3, "http://[bad", "a\r\n\r\nWARC/1.1\r\n"), (10**6 + 3, "u", "same id")], "page_id long, url string, html string")
    both = pages.unionByName(edges).selectExpr("*", "'x' digest", "'x' size", "'x' owner", "'x' value")
    rows = [(r.page_id, (r.html or "").encode()) for r in both.collect()]
    for least in (0, 20):
        owner = {}
        for page, body in rows:
            owner[body] = max(page, owner.get(body, page))
        want = []
        for page, body in rows:
            again = len(body) >= least and owner[body] != page
            want.append((page, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if again else "response", owner[body] if again else -1))
        index = warc.archive_pages(both, least)
        out = index.collect()
        assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, -1 if r.refers_to is None else r.refers_to) for r in out) == sorted(want)
        keys = [(r.url_key, r.timestamp, r.page_id) for r in out]
        assert keys == sorted(keys)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_of_null_ids(spark):
    rows = [(None, "u", "a"), (None, "u", "a"), (0, "u", "a"), (5, "u", "a"), (None, None, None), (None, "u", "own"), (None, "u", "own")]
    out = warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    have = [(r.page_id, r.url, r.payload_bytes, r.record_type, r.refers_to) for r in out]
    want = [(None, "u", 1, "response", None)] * 2 + [(0, "u", 1, "revisit", 5), (5, "u", 1, "response", None), (None, "", 0, "response", None)] + [(None, "u", 3, "response", None)] * 2
    assert sorted(map(str, have)) == sorted(map(str, want))
    keys = [(r.url_key, r.timestamp, r.page_id is not None, r.page_id or 0) for r in out]
    assert keys == sorted(keys)


def test_warc_of_any_long_id(spark):
    ids = [0, 1, 10**9, 3 * 10**11, 3 * 10**11 + 1, 10**15, 2**63 - 1, -5, -(10**12), -(2**63)]
    out = warc.archive_pages(spark.createDataFrame([(k, "u", f"text {k}") for k in ids], "page_id long, url string, html string").repartition(3)).collect()
    assert [r.page_id for r in out] == sorted(ids)
    assert all(len(r.timestamp) == 20 and r.timestamp[4] == "-" for r in out)


def test_warc_offsets_are_places_in_the_files(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://h{k % 3}.com/{k}", f"text {k} " * k) for k in range(50)], "page_id long, url string, html string").repartition(4)
    warc.write_archives(pages, str(tmp_path / "w"))
    for r in warc.capture_index(spark, str(tmp_path / "w")).collect():
        with open(r.run.removeprefix("file:"), "rb") as file:
            file.seek(r.offset)
            _, fields, body = next(warc.parse(file.read()))
        assert fields["WARC-Record-ID"] == f"<urn:page:{r.page_id}>" and body.decode() == f"text {r.page_id} " * r.page_id


def test_loser_tree_merges():
    rng = random.Random(4)
    for runs in (0, 1, 2, 3, 7, 16, 33):
        parts = [sorted((rng.randint(0, 50), k) for _ in range(rng.randint(0, 20))) for k in range(runs)]
        assert list(warc.LoserTree(parts)) == sorted(x for p in parts for x in p)


def test_toxicity_held_out_accuracy(spark):
    from conftest import DATA

    sf = DATA.replace("0.001", "0.1")
    out = queries.op10_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    hits = sum(r.predicted == 1 and r.toxic == 1 for r in out)
    assert hits >= 0.85 * sum(r.toxic == 1 for r in out) and hits >= 0.95 * sum(r.predicted == 1 for r in out)


def test_toxicity_edges(spark, data):
    rows, docs = with_edges(spark, data)
    labels = spark.read.parquet(f"{data}/labels.parquet")
    out = toxicity.toxicity_scores(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert {r.held_out for r in out if r.doc_id == 3} == {zlib.crc32(b"3") % 3 == 1}
    assert toxicity.toxicity_scores(empty(spark), labels).count() == 0
    assert toxicity.toxicity_scores(docs, labels.limit(0)).count() == len(rows)


def test_grammar_scores_clauses():
    grammar = toxicity.Grammar(["=idiot", "lowei"], ["snar"])
    assert grammar.symbols("You idiot. What an idiot! He is not an idiot; they said idiot") == [1, 1, 1, 1, 0, 0]
    assert grammar.symbols("I will kill you. I will kill time.\nloweihaft") == [1, 0, 0, 0, 1, 0]
    assert grammar.symbols("an idiotic overloweih") == [0, 0, 0, 0, 0, 0]
    assert grammar.symbols("snarly snark. not snarly; they said snark") == [0, 0, 0, 0, 0, 2]
    assert grammar.symbols("they said " + "so and " * 1000 + "idiot") == [0, 0, 0, 1, 0, 0]
    assert grammar.symbols("not a single one of you is an idiot") == [0, 0, 1, 0, 0, 0]
    assert grammar.symbols("idiot, he said") == [0, 0, 0, 1, 0, 0]
    assert grammar.symbols("I will definitely and certainly kill you. I will never kill you. Kill you, I will") == [0, 0, 1, 0, 1, 0]


def test_composed_machine_is_the_cascade():
    """The composition writes what the transducers write one after another, and what the rules say of a clause."""
    parts, whole = [toxicity.negation(), toxicity.threat(), toxicity.target(), toxicity.report()], toxicity.machine()
    rng = random.Random(8)
    for _ in range(3000):
        clauses = [[rng.choice(toxicity.CLASSES[:-1]) for _ in range(rng.randint(0, 7))] for _ in range(rng.randint(1, 3))]
        line = [s for clause in clauses for s in (*clause, toxicity.END)]
        out = line
        for part in parts:
            out = part.run(out)
        assert out == whole.run(line)
        for clause in clauses:
            plain = []
            for k, symbol in enumerate(clause):
                no = "negation" in clause[:k]
                if symbol == "insult":
                    plain.append("negated" if no else "aimed" if "target" in clause else "plain")
                elif symbol == "verb" and "intent" in clause[:k] and "target" in clause:
                    plain.append("negated" if no else "threat")
                elif symbol == "suspect" and not no and "report" not in clause:
                    plain.append("suspect")
            if "report" in clause:
                plain = ["reported" for s in plain if s != "suspect"]
            count = lambda s, x=plain: min(x.count(s), 3)
            got = whole.run([*clause, toxicity.END])
            assert [min(got.count(s), 3) for s in toxicity.SYMBOLS] == [count(s) for s in toxicity.SYMBOLS], clause


def test_composition_follows_every_path():
    double = toxicity.Transducer({(0, "a"): (1, ("x", "x")), (1, "a"): (0, ())})
    swap = toxicity.Transducer({(0, "x"): (1, ("y",)), (1, "x"): (0, ("z",))})
    both = toxicity.compose(double, swap, ("a", "b"))
    for n in range(7):
        for line in itertools.product("ab", repeat=n):
            assert both.run(list(line)) == swap.run(double.run(list(line)))


def test_beginnings_that_go_on_in_many_ways_are_suspects():
    pure = [("=scum", 50), ("scum", 50), ("=snarly", 8), ("snarly", 8), ("=snarks", 9), ("snarks", 9), ("grumb", 30), ("grumbe", 29), ("=grumbex", 6)]
    assert toxicity.choose_entries(pure, [("snar", 40), ("snark", 15), ("scum", 50)]) == (["=scum", "grumbe"], ["snar"])
    assert toxicity.choose_entries([], []) == ([], [])
