"""Registered queries of the llm operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .bpe import encode_documents

    out = encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dup_spans import remove_repeats

    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    out = near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import balanced_shards

    return balanced_shards(table(spark, sf_dir, "documents"), shards=16)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan_secrets

    out = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    names = F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string")))
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.col("digest").alias("base_sha256"), F.array_join(names, ",").alias("spans"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_verdicts

    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), base)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("good")).alias("kept"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    out = archive_pages(table(spark, sf_dir, "pages"), least=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    out = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turn_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"), least=10, top=10)


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import simhash_groups

    return simhash_groups(table(spark, sf_dir, "documents"), k=4, radius=4)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_suffix_dedup, op3_main_text, op4_minhash, op5_sharding, op6_secrets, op7_quality, op8_warc, op9_decontaminate, op10_toxicity, op11_turn_trie, op12_divergence, op13_simhash)}
#: DuckDB, over the tables as views. Where none is given, tests hold the query against brute force.
ORACLE_SQL: dict[str, str] = {
    "op4_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
        s AS (
            SELECT DISTINCT doc_id, md5(array_to_string(words[i:i + 3], ' ')) AS shingle
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        both_have AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
        link AS (SELECT a, b FROM both_have JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
        FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) r ON r.a = d.doc_id""",
    "op8_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
        o AS (SELECT h, max(page_id) AS owner FROM p GROUP BY h)
        SELECT page_id, payload_bytes,
            array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
            CASE WHEN page_id < owner THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id < owner THEN owner END AS refers_to
        FROM p JOIN o USING (h)""",
    "op11_turn_trie": """
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(concat(octet_length(encode(coalesce(role, ''))), ':', role, text))) AS place
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (
            SELECT conv_id, list({'role': role, 'text': text} ORDER BY place) AS own, xor(4294967295, list_reduce(
                list_concat([4294967295], list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 9 AS h
            FROM t GROUP BY conv_id),
        r AS (SELECT a.conv_id, list_concat(coalesce(b.own[1:a.h], []), a.own[a.h + 1:]) AS seq FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id - a.conv_id % 5),
        p AS (SELECT conv_id, d, seq[1:d] AS path, len(seq) = d AS here FROM (SELECT *, unnest(range(0, len(seq) + 1)) AS d FROM r)),
        n AS (
            SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (here), '')) AS ends_sha256,
                (count(*) - 1) * coalesce(octet_length(encode(path[d].text)), 0) AS saved
            FROM p GROUP BY path, d),
        k AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
        m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.d = n.d AND k.path = n.path),
        s AS (
            SELECT path[1:e] AS path, e AS d, sum(saved) AS saved_tokens, sum((n_children = 0)::BIGINT) AS n_leaves
            FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM m) GROUP BY ALL)
        SELECT m.conv_id, m.d AS depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, m.ends_sha256
        FROM m JOIN s ON s.d = m.d AND s.path = m.path LEFT JOIN n u ON m.d > 0 AND u.d = m.d - 1 AND u.path = m.path[1:m.d - 1]""",
    "op12_divergence": r"""
        WITH o AS (
            SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
        w AS (SELECT doc, lang, source, unnest(terms) AS term FROM o),
        kept AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 10),
        c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM o),
        v AS (SELECT lang, count(*) AS v, sum(whole) AS whole FROM kept GROUP BY lang),
        x AS (SELECT lang, source, term, coalesce(c.n, 0) AS n, kept.whole FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
        s AS (SELECT lang, source, sum(n) AS total FROM x GROUP BY ALL),
        p AS (
            SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 2) // (s.total + 2 * v.v))::BIGINT AS p, (1 + 1000000000::HUGEINT * (x.whole + 2) // (v.whole + 2 * v.v))::BIGINT AS q
            FROM x JOIN s USING (lang, source) JOIN v USING (lang)),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::BIGINT AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
        r AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
            FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
            UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r
        QUALIFY part = 'pair' OR rank <= 10""",
}
