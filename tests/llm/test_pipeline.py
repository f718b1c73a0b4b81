from pyspark.sql import functions as F

import corpus_pipeline
from factorspark.llm import secrets
from factorspark.llm.bpe import Tokenizer

from .helpers import with_edges


def test_stages_take_effect(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    edges = with_edges(spark, data, 0)[1].select("doc_id", "text").selectExpr("doc_id", "text", "'en' lang", "'s' source", "length(text) n_chars")
    docs = documents.unionByName(edges)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, data)
        assert kept.columns == docs.columns, name
        assert kept.count() <= before.count()
    rows = {r.doc_id: r for r in kept.collect()}
    assert not [r for r in rows.values() if r.text and secrets.find_secrets(r.text)]
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows.values())
    assert (1_000_007 in rows) and (1_000_008 not in rows) and {1_000_001, 1_000_002, 1_000_003, None} <= set(rows)
    import public_tokenizers

    tokenizer = Tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for r in corpus_pipeline.STAGES[-1][1](spark, kept, data).collect():
        ids = [int(x) for x in r.ids.split(",") if x]
        assert tokenizer.decode(ids) == (rows[r.doc_id].text or "") and len(ids) == r.n_tokens


def test_rows_are_judged_by_themselves(spark, data):
    """NULL and shared ids: a bad row goes alone, copies go but one, and different texts stay."""
    words = lambda tag: " ".join(f"{tag}{k}" for k in range(40))
    item = spark.read.parquet(f"{data}/benchmark.parquet").first().text
    rows = [(None, item), (None, words("a")), (7, item), (7, words("b")), (7, words("c")), (None, words("d")), (None, words("d")), (9, words("e")), (None, words("e")), (9, words("e")), (8, words("e")), (5, None), (5, None)]
    docs = spark.createDataFrame([(*r, "en", "s", 1) for r in rows], spark.read.parquet(f"{data}/documents.parquet").schema)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.drop_contaminated(spark, docs, data).collect()]
    assert sorted(map(str, kept)) == sorted(str(r) for r in rows if r[1] != item)
    once = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, data).collect()]
    assert sorted(map(str, once)) == sorted(map(str, [(7, item), (None, words("a")), (7, words("b")), (7, words("c")), (None, words("d")), (8, words("e")), (5, None), (5, None)]))


def test_toxic_rows_go_alone(spark, data, monkeypatch):
    docs = spark.createDataFrame([(None, "bad"), (None, "good"), (3, "bad"), (3, "good")], "doc_id long, text string")
    keys = lambda d, labels, key_col: d.select(key_col, (F.col("text") == "bad").cast("double").alias("score"))
    monkeypatch.setattr(corpus_pipeline, "toxicity_scores", keys)
    assert sorted(map(str, (tuple(r) for r in corpus_pipeline.drop_toxic(spark, docs, data).collect()))) == ["(3, 'good')", "(None, 'good')"]


def test_run_is_the_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
    assert sorted(map(tuple, docs.collect())) == sorted(map(tuple, corpus_pipeline.run(spark, data).collect()))


def best_run(doc, item):
    """Most equal words in a positive run over all shifts: +1 for equal, -4 for another."""
    best = 0
    for shift in range(-len(item) + 1, len(doc)):
        low, high = max(0, -shift), min(len(item), len(doc) - shift)
        equal = [item[k] == doc[k + shift] for k in range(low, high)]
        if sum(equal) < 13:
            continue
        score = run = 0
        for same in equal:
            score, run = score + (1 if same else -4), run + same
            if score <= 0:
                score = run = 0
            best = max(best, run)
    return best


def test_run_equals_plain_versions(spark, data):
    from tokenizers import Tokenizer as Library

    from factorspark.llm.toxicity import toxicity_scores

    from .test_text_operators import PATH, brute_links, plain_secrets

    docs = spark.read.parquet(f"{data}/documents.parquet")
    toxic = {r.doc_id for r in toxicity_scores(docs, spark.read.parquet(f"{data}/labels.parquet")).collect() if r.score >= 0.7}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in toxic]
    first = {int(d) for d, _, group in brute_links(rows, 5) if int(d) == group}
    fold = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
    items = [fold(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    library, want = Library.from_file(PATH), []
    for doc, text in rows:
        if doc not in first or any(best_run(fold(text), i) >= min(13, len(i)) for i in items if len(i) >= 9 and len(set(i) & set(fold(text))) >= 5):
            continue
        kept, at = [], 0
        for start, kind, end in plain_secrets(text or ""):
            if start >= at:
                kept += [text[at:start], f"<{('assign', 'access', 'hex')[kind]}>"]
            at = max(at, end)
        ids = library.encode("".join(kept) + (text or "")[at:], add_special_tokens=False).ids
        want.append((doc, len(ids), ",".join(map(str, ids))))
    assert sorted(map(tuple, corpus_pipeline.run(spark, data).select("doc_id", "n_tokens", "ids").collect())) == sorted(want)
