"""The queries of this subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.llm import bpe, chroma, decontaminate, language, pii, pivots, prefix_trie, quality, repair, secrets, simhash, token_files, url_filter
from attesta.llm.common import table

#: Default place of the public tokenizer file; a parameter of the operator.
WORD_BPE = "word_bpe_49k.json"


def vocabulary() -> str:
    """The public tokenizer file; needed only by the queries that encode."""
    import public_tokenizers

    return bpe.read_vocabulary(public_tokenizers.path(WORD_BPE))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), vocabulary()))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


#: The end-of-document id of the word tokenizer.
END_OF_DOCUMENT = 49407


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_files.count_documents(table(spark, sf_dir, "documents"), vocabulary(), END_OF_DOCUMENT)
    return counted.select("doc_id", "n_tokens")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, media): a recording per vector. Those that follow a multiple of five hold a
    part of the recording before them under noise, where there is one."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    before = vectors.filter("vec_id % 5 = 0").groupBy((F.col("vec_id") + 1).alias("vec_id")).agg(F.min("embedding").alias("before"))
    return vectors.join(before, "vec_id", "left").select("vec_id", F.struct(F.col("vec_id").alias("seed"), "embedding", "before").alias("media"))


def op7_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chroma.align(recordings(spark, sf_dir), "vec_id", "media", chroma.cut_or_own)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.digests(pii.find(docs, pii.train(docs)))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


#: The query's list: (entry, verdict).
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "rule string, verdict string")
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


def op11_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivots.search(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(*prefix_trie.graft(prefix_trie.placed(table(spark, sf_dir, "conversations"))))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.digests(repair.damage(table(spark, sf_dir, "conversations")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_language": op4_language,
    "op5_token_counts": op5_token_counts,
    "op6_secrets": op6_secrets,
    "op7_chroma": op7_chroma,
    "op8_pii": op8_pii,
    "op9_decontaminate": op9_decontaminate,
    "op10_url_filter": op10_url_filter,
    "op11_pivots": op11_pivots,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_repair": op13_repair,
}

def _crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a text of plain ASCII, bit by bit."""
    bit = "list_reduce(list_concat([xor(acc, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)), lambda acc, b: {bit}), 4294967295)"


SQL: dict[str, str] = {
    "op10_url_filter": r"""
        WITH parts AS (
            SELECT page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages),
        judged AS (
            SELECT *, CASE
                WHEN ('.' || host) LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM parts)
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
        FROM judged""",
    "op9_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM documents),
        b AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i:i + 9], ' ') AS body
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, least(len(w), 1)) + 1)) AS i FROM b)),
        sizes AS (SELECT DISTINCT size FROM windows),
        places AS (
            SELECT doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') AS body
            FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes)),
        found AS (SELECT doc_id, i, size, item_id FROM places JOIN windows USING (size, body)),
        hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM found) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op12_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p
            FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc32("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM t)),
        heads AS (SELECT c.conv_id, p, role, text FROM c JOIN t ON t.conv_id = c.base WHERE p <= h),
        given AS (SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id),
        rebuilt AS (
            FROM heads
            UNION ALL
            SELECT c.conv_id, p - h + coalesce(n, 0), role, text FROM c JOIN t USING (conv_id) LEFT JOIN given USING (conv_id) WHERE p > h),
        k AS (
            SELECT conv_id, p AS depth, length(text) AS size, string_agg(sha256(to_json([role, text])::VARCHAR), '') OVER (PARTITION BY conv_id ORDER BY p) AS key
            FROM rebuilt
            UNION ALL SELECT conv_id, 0, 0, '' FROM c),
        n AS (SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size FROM k GROUP BY depth, key),
        families AS (SELECT depth - 1 AS depth, key[:64 * (depth - 1)] AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
        below AS (
            SELECT up.depth, up.key, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, sum((n_convs - 1) * n.size)::BIGINT AS saved_tokens
            FROM n LEFT JOIN families USING (depth, key) JOIN k AS up ON up.conv_id = n.conv_id AND up.depth <= n.depth
            GROUP BY ALL),
        ends AS (SELECT depth, key, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM (SELECT conv_id, max(depth) AS depth, max_by(key, depth) AS key FROM k GROUP BY conv_id) GROUP BY ALL)
        SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
        FROM n LEFT JOIN families USING (depth, key) JOIN below USING (depth, key) LEFT JOIN ends USING (depth, key)
        LEFT JOIN n AS up ON n.depth > 0 AND up.depth = n.depth - 1 AND up.key = n.key[:64 * (n.depth - 1)]""",
    "op13_repair": rf"""
        WITH RECURSIVE src AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS f
            FROM conversations),
        damaged AS (
            SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE f WHEN 3 THEN 2 ELSE 1 END)) AS nth
            FROM src WHERE f <> 0),
        rows_ AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) AS again
            FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p FROM damaged)),
        faults AS (
            SELECT conv_id, turn, p, role, text, role[:1] AS initial, lag(role[:1]) OVER (PARTITION BY conv_id ORDER BY p) AS before,
                   CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank' WHEN again > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-
]*$') THEN 'truncated' ELSE '' END AS fault
            FROM rows_),
        counts AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
                   count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faults GROUP BY conv_id),
        grammar(q, initial, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        fresh(q, role, q2) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
        inserted AS (
            SELECT q, 0::BIGINT AS cost, '' AS labels, []::VARCHAR[] AS turns, q AS q2 FROM fresh
            UNION ALL SELECT q, 5, 'I', [role || ':'], q2 FROM fresh
            UNION ALL SELECT a.q, 10, 'II', [a.role || ':', b.role || ':'], b.q2 FROM fresh a JOIN fresh b ON b.q = a.q2),
        edits AS (
            SELECT q, 'D' AS label, 2 AS cost, NULL::VARCHAR AS initial, NULL::VARCHAR AS role, q AS q2 FROM fresh
            UNION ALL SELECT q, 'K', 0, initial, NULL, q2 FROM grammar
            UNION ALL SELECT q, 'R', 1, NULL, role, q2 FROM fresh),
        walk AS (
            SELECT conv_id, 0::BIGINT AS i, 0 AS q, {{'cost': 0::BIGINT, 'audit': '', 'turns': []::VARCHAR[]}} AS best FROM counts
            UNION ALL
            SELECT w.conv_id, w.i + 1, e.q2, min({{
                'cost': w.best.cost + m.cost + e.cost + CASE WHEN e.label <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END,
                'audit': w.best.audit || m.labels || e.label,
                'turns': list_concat(w.best.turns, m.turns, CASE e.label WHEN 'D' THEN [] ELSE [coalesce(e.role, f.role) || ':' || f.text] END)}})
            FROM walk w JOIN faults f ON f.conv_id = w.conv_id AND f.p = w.i + 1 JOIN inserted m ON m.q = w.q JOIN edits e ON e.q = m.q2
            WHERE (e.label = 'D' OR f.fault NOT IN ('blank', 'duplicate')) AND (e.label <> 'K' OR e.initial = f.initial)
            GROUP BY w.conv_id, w.i + 1, e.q2),
        ended AS (
            SELECT w.conv_id, min({{'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.labels, 'turns': list_concat(w.best.turns, m.turns)}}) AS best
            FROM walk w JOIN counts c ON c.conv_id = w.conv_id AND c.n = w.i JOIN inserted m ON m.q = w.q WHERE m.q2 IN (0, 3) GROUP BY w.conv_id)
        SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.turns, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts USING (conv_id) LEFT JOIN ended USING (conv_id)""",
}
