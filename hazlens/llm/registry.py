"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from hazlens.llm import bpe, conversations, exact_dedup, filter_audit, line_dedup, neighbours, packing, quality, secret_scan, simhash, topk, toxicity, url_rules
from hazlens.session import table


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def op2_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_url_rules(spark, sf_dir):
    return url_rules.judged(table(spark, sf_dir, "pages"), url_rules.rules_table(spark, url_rules.RULES))


def op4_packing(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.scored(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_line_dedup(spark, sf_dir):
    """doc_id, lines_removed, dropped and the digest of the text that is left."""
    done = line_dedup.cleaned(table(spark, sf_dir, "documents"))
    return done.select("doc_id", F.col("__lines_removed").alias("lines_removed"), F.col("__dropped").alias("dropped"), F.length("text").cast("long").alias("n_chars_left"), F.sha2("text", 256).alias("text_sha256"))


def op7_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_secret_scan(spark, sf_dir):
    return secret_scan.found(table(spark, sf_dir, "documents"))


def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_exact_top_k(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_conversation_repair(spark, sf_dir):
    return conversations.audited(table(spark, sf_dir, "conversations"))


def op13_filter_audit(spark, sf_dir):
    return filter_audit.audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_neighbours": op2_neighbours,
    "op3_url_rules": op3_url_rules,
    "op4_packing": op4_packing,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash": op7_simhash,
    "op8_bpe": op8_bpe,
    "op9_secret_scan": op9_secret_scan,
    "op10_toxicity": op10_toxicity,
    "op11_exact_top_k": op11_exact_top_k,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_filter_audit": op13_filter_audit,
}

ORACLE = {
    "op1_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op3_url_rules": """
        WITH rest AS (
            SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(url, '(?s)^.*?://(.*)$', 1) ELSE '' END AS r FROM pages
        ), cut AS (
            SELECT row_number() OVER () AS n, page_id,
                   translate(regexp_extract(coalesce(r, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(r, ''), '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest
        ), rules(h, p, v) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), fit AS (
            SELECT n, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
            FROM cut JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY n
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM cut LEFT JOIN fit USING (n)
    """,
    "op6_line_dedup": """
        WITH texts AS (
            SELECT text, arg_min(coalesce(source, chr(0)), doc_id) AS site FROM documents WHERE text IS NOT NULL GROUP BY text
        ), spread AS (
            SELECT line FROM (SELECT site, unnest(string_split(text, chr(10))) AS line FROM texts)
            WHERE regexp_matches(line, '\\S') GROUP BY line HAVING count(DISTINCT site) >= 10
        ), parts AS (
            SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
        ), lines AS (
            SELECT doc_id, unnest(generate_series(1, len(ls))) AS pos, unnest(ls) AS line FROM parts
        ), marked AS (
            SELECT l.doc_id, l.pos, l.line, s.line IS NOT NULL AS shared,
                   row_number() OVER (PARTITION BY l.line ORDER BY l.doc_id, l.pos) AS turn
            FROM lines l LEFT JOIN spread s USING (line)
        ), whole AS (
            SELECT doc_id, count(*) FILTER (shared AND turn > 1) AS n,
                   coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT (shared AND turn > 1)), '') AS t
            FROM marked GROUP BY doc_id
        )
        SELECT doc_id, coalesce(n, 0) AS lines_removed, coalesce(n, 0) > 0 AND NOT regexp_matches(t, '\\S') AS dropped,
               length(t) AS n_chars_left, sha256(t) AS text_sha256
        FROM documents LEFT JOIN whole USING (doc_id)
    """,
    "op11_exact_top_k": topk.SQL,
    "op12_conversation_repair": conversations.SQL,
    "op13_filter_audit": filter_audit.SQL,
}
