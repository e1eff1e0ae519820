"""The registered query of each text operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import common, conversation_trie, decontam, filter_audit, license, ngram_join, packing, pii, quality, secrets, simhash, suffix_dedup, toxicity, warc


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(common.read(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(common.read(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(common.read(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(common.read(spark, sf_dir, "documents"), secrets.train(secrets.labelled_samples(spark)))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, common.read(spark, sf_dir, "pages")).drop("url")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(common.read(spark, sf_dir, "documents"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(common.read(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.joined(common.read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, common.read(spark, sf_dir, "labels")))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(common.read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "labels"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.trie(common.read(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_pii, op3_suffix_dedup, op4_secret_scan, op5_decontamination, op6_warc, op7_quality_rules, op8_license_scan, op9_ngram_join, op10_toxicity,
        op11_simhash, op12_filter_audit, op13_conversation_trie,
    )
}

ORACLE_SQL = {
    "op5_decontamination": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
             d AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
             v AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
             b AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM v)),
             n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id)
        SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*) / n_item AS containment
        FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) / n_item >= 0.8
    """,
    "op6_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to
        FROM f
    """,
    "op12_filter_audit": r"""
        WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
             w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM t),
             f AS (SELECT part, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic,
                   [len(w) < 200, 100 * list_unique(w) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]+', '', 'g')) > 3 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(first_id < doc_id, false)] AS fails FROM w),
             g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic, len(list_filter(fails, lambda x: x)) AS k FROM f GROUP BY part, fails),
             l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
             o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM l a, l b, l c, l d, l e WHERE a.x NOT IN (b.x, c.x, d.x, e.x) AND b.x NOT IN (c.x, d.x, e.x) AND c.x NOT IN (d.x, e.x) AND d.x <> e.x),
             s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o),
             p AS (SELECT filter_order, step, instr('ABCDE', filter_order[step]) AS own, list_transform(range(1, step), lambda i: instr('ABCDE', filter_order[i])) AS before FROM s),
             e AS (SELECT g.*, filter_order, step, fails[own] AS out_now, len(list_filter(before, lambda i: fails[i])) > 0 AS out_before FROM g, p)
        SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (NOT out_now AND NOT out_before), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (out_now AND NOT out_before), 0)::BIGINT AS removed,
               coalesce(sum(n) FILTER (out_now AND out_before), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (out_now AND k = 1), 0)::BIGINT AS unique_fails,
               coalesce(sum(n_good) FILTER (out_now AND NOT out_before), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (out_now AND NOT out_before), 0)::BIGINT AS toxic_lost,
               coalesce(sum(n * (120 // greatest(k, 1))) FILTER (out_now), 0)::BIGINT AS shapley
        FROM e GROUP BY part, filter_order, step
    """,
    "op13_conversation_trie": """
        WITH ids AS (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL),
             -- CRC-32 of the decimal digits, bit by bit.
             heads AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
                       lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 6 AS h FROM ids),
             t AS (SELECT conv_id AS c, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM conversations WHERE conv_id IS NOT NULL),
             r AS (SELECT c, list(turn ORDER BY own, k) AS turns FROM (
                       SELECT h.c, t.turn, t.k, 0 AS own FROM heads h JOIN t ON t.c = h.c - h.c % 100 AND t.k <= h.h UNION ALL SELECT h.c, t.turn, t.k, 1 FROM heads h JOIN t ON t.c = h.c AND t.k > h.h) GROUP BY c),
             a AS (SELECT c, coalesce(turns, []) AS turns FROM ids LEFT JOIN r USING (c)),
             m AS (SELECT c, len(turns) AS size, d, turns[1:d] AS key FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM a)),
             n AS (SELECT key, d, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '')) AS ends_sha256 FROM m GROUP BY key, d),
             kids AS (SELECT key[1:d - 1] AS key, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
             k AS (SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE length(key[d].text) END AS saves FROM n LEFT JOIN kids USING (key, d)),
             up AS (SELECT key[1:e] AS key, e AS d, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saves) AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM k) GROUP BY 1, 2)
        SELECT k.conv_id, k.d AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
        FROM k JOIN up USING (key, d) LEFT JOIN n p ON p.d = k.d - 1 AND p.key = k.key[1:k.d - 1]
    """,
}
