"""Every query of the reference's own operators over the fixture tables, with its SQL.

The fixtures hold no safety language. ``documents`` stands for reports (source for
site, lang for category), ``labels.toxic`` for the label, ``events`` for a dated
stream of observations (user_id for team, event_type for category). Ratios of
precision and recall on them test arithmetic, not judgement.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazlens.functions import lexicon as lex
from hazlens.functions import text as words_of
from hazlens.operators import classify, dedup, evaluate, monitor, patterns, tagging
from hazlens.plans import relational  # noqa: F401  (registers its queries)
from hazlens.plans.registry import ORACLE, QUERIES, query
from hazlens.session import shared_folder, table
from hazlens.sources import reports
from hazlens.streaming import feeds

SPLIT_DAY = "2024-01-16"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


#: Member probabilities of the rule scores: a rule that applies gives its weight, else 0.1.
def _members() -> list[F.Column]:
    return [F.when(F.col("text").rlike(e.pattern), F.lit(e.weight)).otherwise(F.lit(0.1)) for e in lex.FIXTURE]


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with a rule-based prediction and score."""
    docs = _docs(spark, sf_dir).select("doc_id", "text", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return docs.withColumn("score", classify.soft_vote(_members())).withColumn("pred", classify.decided(F.col("score"), 0.3))


# ---- SQL shared by several oracles -----------------------------------------

PATTERN = {e.rule_id: e.pattern for e in lex.FIXTURE}
_HIT = {r: f"regexp_matches(text, '{p}')" for r, p in PATTERN.items()}
_SCORE = "(" + " + ".join(f"CASE WHEN {_HIT[e.rule_id]} THEN {e.weight} ELSE 0.1 END" for e in lex.FIXTURE) + f") / {float(len(lex.FIXTURE))}"
_JUDGED = f"judged AS (SELECT d.doc_id, source, lang, quality, toxic, ({_SCORE})::DOUBLE AS score, CASE WHEN ({_SCORE})::DOUBLE >= 0.3 THEN 1 ELSE 0 END AS pred FROM documents d JOIN labels USING (doc_id))"
_TAGS = "tags AS (" + " UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule_id FROM documents WHERE {_HIT[r]}" for r in PATTERN) + ")"
_EVIDENCE = "hits AS (" + " UNION ALL ".join(f"SELECT doc_id, text, '{r}' AS rule_id, regexp_extract_all(text, '{p}', 1) AS m, string_split_regex(text, '{p}') AS b FROM documents WHERE {_HIT[r]}" for r, p in PATTERN.items()) + """
), spans AS (
    SELECT doc_id, text, rule_id, m[i] AS snippet, length(m[i]) AS length,
           1 + list_sum(list_transform(b[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start
    FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM hits)
)"""
_PRF = "tp::DOUBLE / nullif(tp + fp, 0) AS precision, tp::DOUBLE / nullif(tp + fn, 0) AS recall, 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1"
_COUNTS = "count(*) FILTER (toxic = 1 AND pred = 1) AS tp, count(*) FILTER (toxic <> 1 AND pred = 1) AS fp, count(*) FILTER (toxic = 1 AND pred <> 1) AS fn, count(*) FILTER (toxic <> 1 AND pred <> 1) AS tn"
_ROUND = lambda df, *cols: df.withColumns({c: F.round(c, 9) for c in cols})
_RPRF = "round(tp::DOUBLE / nullif(tp + fp, 0), 9) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS recall, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1"


# ---- sources -----------------------------------------------------------------


@query("SELECT doc_id AS report_id, 'UA' AS report_type, text AS narrative, source AS site, lang AS category FROM documents")
def canonical_reports(spark, sf_dir):
    """Documents in the canonical schema (the columns that have values here)."""
    out = reports.normalised(_docs(spark, sf_dir), {"report_id": "doc_id", "narrative": "text", "site": "source", "category": "lang"}, "UA")
    return out.select("report_id", "report_type", "narrative", "site", "category")


@query("""
    SELECT report_type, count(*) AS n, count(category) AS with_category, sum(length(narrative))::BIGINT AS chars
    FROM (SELECT 'UA' AS report_type, text AS narrative, lang AS category FROM documents
          UNION ALL SELECT 'NEAR_MISS', text, NULL FROM conversations) GROUP BY report_type
""")
def union_report_families(spark, sf_dir):
    docs = reports.normalised(_docs(spark, sf_dir), {"report_id": "doc_id", "narrative": "text", "category": "lang"}, "UA")
    talks = reports.normalised(table(spark, sf_dir, "conversations"), {"report_id": "conv_id", "narrative": "text"}, "NEAR_MISS")
    both = reports.merged(docs, talks)
    return both.groupBy("report_type").agg(F.count("*").alias("n"), F.count("category").alias("with_category"), F.sum(F.length("narrative")).alias("chars"))


@query("SELECT provenance, count(*) AS n FROM (SELECT 'documents' AS provenance FROM documents UNION ALL SELECT 'benchmark' FROM benchmark) GROUP BY provenance")
def training_corpus(spark, sf_dir):
    docs = _docs(spark, sf_dir).select(F.col("doc_id").alias("report_id"), F.col("text").alias("narrative"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("report_id"), F.col("text").alias("narrative"))
    return reports.corpus(documents=docs, benchmark=items).groupBy("provenance").agg(F.count("*").alias("n"))


@query("SELECT doc_id, source, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def attach_labels(spark, sf_dir):
    return reports.labelled(_docs(spark, sf_dir).select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


# ---- text ----------------------------------------------------------------------


@query(r"""
    SELECT doc_id, length(text) AS chars, len(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda t: t <> '')) AS tokens,
           trim(text) = '' AS is_empty, md5(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS cleaned_md5
    FROM documents
""")
def text_stats(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.length(t).cast("long").alias("chars"), F.size(words_of.tokens(t)).cast("long").alias("tokens"), (F.trim(t) == "").alias("is_empty"), F.md5(words_of.cleaned(t)).alias("cleaned_md5"))


@query(r"""
    WITH w AS (SELECT doc_id, lang, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda t: t <> '')) AS term FROM documents),
    tf AS (SELECT lang, term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY ALL),
    n AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang),
    s AS (SELECT lang, term, tf, df, round(tf * ln((docs + 1.0) / (df + 1.0)), 6) AS weight FROM tf JOIN n USING (lang))
    SELECT lang, term, tf, df, weight, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY weight DESC, term) AS place FROM s) WHERE place <= 10
""")
def tfidf_top_terms(spark, sf_dir):
    """The ten heaviest terms of each category."""
    docs = _docs(spark, sf_dir)
    # a document is one row, so its uses and its distinct terms are counted side by side and meet in one exchange
    uses = lambda words, tf, df: F.transform(words, lambda t: F.struct(t.alias("term"), F.lit(tf).alias("tf"), F.lit(df).alias("df")))
    # a variable of the lambda, so that a text is split once
    both = F.transform(F.array(words_of.tokens(F.col("text"))), lambda w: F.concat(uses(w, 1, 0), uses(F.array_distinct(w), 0, 1)))[0]
    terms = docs.select("lang", F.explode(both).alias("u"))
    tf = terms.groupBy("lang", F.col("u.term").alias("term")).agg(F.sum("u.tf").alias("tf"), F.sum("u.df").alias("df"))
    sizes = docs.groupBy("lang").agg(F.count("*").alias("docs"))
    weight = F.round(F.col("tf") * F.log((F.col("docs") + 1.0) / (F.col("df") + 1.0)), 6)
    scored = tf.join(sizes, "lang").select("lang", "term", "tf", "df", weight.alias("weight"))
    return patterns.top_per_group(scored, ["lang"], [F.desc("weight"), F.col("term")], 10)


@query("SELECT doc_id, (lang = 'en')::INT AS is_en, (lang = 'de')::INT AS is_de, (lang = 'es')::INT AS is_es, (lang = 'fr')::INT AS is_fr FROM documents")
def onehot_category(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", *((F.col("lang") == c).cast("int").alias(f"is_{c}") for c in ("en", "de", "es", "fr")))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(text, '[.!?]+\s*'), lambda s: trim(s) <> '')) AS sentences FROM documents")
def sentence_count(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.size(words_of.sentences(F.col("text"))).cast("long").alias("sentences"))


@query("""
    WITH w AS (SELECT list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda t: t <> '') AS ws FROM documents),
    p AS (SELECT unnest(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) AS pair FROM w)
    SELECT pair, count(*) AS n FROM p GROUP BY pair ORDER BY n DESC, pair LIMIT 50
""")
def top_bigrams(spark, sf_dir):
    """The fifty most frequent pairs of words."""
    pairs = _docs(spark, sf_dir).select(F.explode(words_of.ngrams(words_of.tokens(F.col("text")), 2)).alias("pair"))
    return pairs.groupBy("pair").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "pair").limit(50)


@query("SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text")
def exact_dedup(spark, sf_dir):
    return dedup.exact(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id", "text").select("doc_id", F.md5("text").alias("text_md5"))


@query(r"""
    WITH d AS (SELECT min(doc_id) AS doc_id, string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ') AS w FROM documents GROUP BY text),
    s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS sh FROM d),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS key_a, b.doc_id AS key_b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL)
    SELECT key_a, key_b, round(c::DOUBLE / (na.n + nb.n - c), 9) AS jaccard FROM p JOIN n na ON na.doc_id = key_a JOIN n nb ON nb.doc_id = key_b WHERE c::DOUBLE / (na.n + nb.n - c) >= 0.8
""")
def jaccard_near_dup(spark, sf_dir):
    """Pairs of distinct texts with 0.8 of their five-word shingles in common."""
    return _ROUND(dedup.jaccard_pairs(_docs(spark, sf_dir), "doc_id", "text"), "jaccard")


@query(ORACLE["jaccard_near_dup"])
def minhash_pairs(spark, sf_dir):
    """The same pairs by bands of least hashes, each found with a chance of 0.9998 at least."""
    return _ROUND(dedup.minhash_pairs(_docs(spark, sf_dir), "doc_id", "text"), "jaccard")


# ---- classification --------------------------------------------------------------


def _heuristics() -> list[F.Column]:
    t = F.col("text")
    found = [F.when(t.rlike(e.pattern), 1) for e in lex.FIXTURE]
    return [*found, F.when(F.length(t) < 400, 0), F.when(F.col("lang") != "en", 0)]


@query(f"""
    SELECT doc_id, CASE WHEN v > 0 THEN (2 * o >= v)::INT END AS label FROM (
        SELECT doc_id, {" + ".join(f"({h})::INT" for h in _HIT.values())} AS o,
               {" + ".join(f"({h})::INT" for h in _HIT.values())} + (length(text) < 400)::INT + (lang <> 'en')::INT AS v FROM documents)
""")
def weak_label_vote(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", classify.vote(*_heuristics()).alias("label"))


@query(f"SELECT doc_id, (regexp_matches(text, '{lex.FIXTURE_ENERGY}') AND regexp_matches(text, '{lex.FIXTURE_CONTROL}'))::INT AS sif FROM documents")
def energy_control_rule(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", classify.energy_and_control(F.col("text"), lex.FIXTURE_ENERGY, lex.FIXTURE_CONTROL).alias("sif"))


@query(f"WITH {_JUDGED} SELECT doc_id, pred, toxic FROM judged")
def threshold_decision(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", "pred", "toxic")


@query("SELECT doc_id, (doc_id % 5)::BIGINT AS fold, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS part FROM documents")
def hash_split(spark, sf_dir):
    at = classify.fold(F.col("doc_id"))
    return _docs(spark, sf_dir).select("doc_id", at.cast("long").alias("fold"), F.when(at == 0, "test").otherwise("train").alias("part"))


@query(f"SELECT doc_id, round(({_SCORE})::DOUBLE, 9) AS score FROM documents")
def soft_vote_average(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.round(classify.soft_vote(_members()), 9).alias("score"))


# ---- tagging -----------------------------------------------------------------------


@query(f"WITH {_TAGS} SELECT * FROM tags")
def rule_tags(spark, sf_dir):
    return tagging.tags(_docs(spark, sf_dir), lex.FIXTURE, "doc_id", "text")


@query(f"WITH {_EVIDENCE} SELECT doc_id, rule_id, start, length, snippet, substring(text, greatest(start - 20, 1), start + length + 20 - greatest(start - 20, 1)) AS context FROM spans")
def rule_evidence(spark, sf_dir):
    return tagging.evidence(_docs(spark, sf_dir), lex.FIXTURE, "doc_id", "text").withColumns({"start": F.col("start").cast("long"), "length": F.col("length").cast("long")})


def _highlight_sql() -> str:
    out = "replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    for p in PATTERN.values():
        out = f"regexp_replace({out}, '{p}', '<mark>\\1</mark>', 'g')"
    return f"SELECT doc_id, md5({out}) AS html_md5 FROM documents"


@query(_highlight_sql())
def highlight(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(tagging.highlighted(F.col("text"), lex.FIXTURE)).alias("html_md5"))


_TAXONOMY = ", ".join(f"('{a}', '{b}')" for a, b in lex.RULES)
_SAFETY_HITS = " UNION ALL ".join(f"SELECT '{e.rule_id}' AS rule_id, doc_id FROM documents WHERE regexp_matches(text, '{e.pattern}')" for e in lex.SAFETY)


@query(f"SELECT rule_id, rule_name, count(doc_id) AS reports FROM (VALUES {_TAXONOMY}) AS t(rule_id, rule_name) LEFT JOIN ({_SAFETY_HITS}) USING (rule_id) GROUP BY ALL")
def rule_taxonomy(spark, sf_dir):
    """Every rule by name with the reports tagged with it, those without any included."""
    counts = tagging.tags(_docs(spark, sf_dir), lex.SAFETY, "doc_id", "text").groupBy("rule_id").agg(F.count("*").alias("reports"))
    # the dimension has as many rows as there are rules
    return lex.taxonomy(spark).join(counts, "rule_id", "left").select("rule_id", "rule_name", F.coalesce("reports", F.lit(0).cast("long")).alias("reports"))


@query(f"WITH {_TAGS} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM tags)")
def untagged_reports(spark, sf_dir):
    return tagging.untagged(_docs(spark, sf_dir), lex.FIXTURE, "text").select("doc_id")


# ---- evaluation ----------------------------------------------------------------------


@query(f"WITH {_JUDGED}, c AS (SELECT {_COUNTS} FROM judged) SELECT tp, fp, fn, tn, {_RPRF} FROM c")
def prf1(spark, sf_dir):
    return _ROUND(evaluate.scores(_judged(spark, sf_dir), "toxic", "pred"), "precision", "recall", "f1")


@query(f"WITH {_JUDGED} SELECT toxic, pred, count(*) AS n FROM judged GROUP BY ALL")
def confusion(spark, sf_dir):
    return evaluate.confusion(_judged(spark, sf_dir), "toxic", "pred")


#: Truth for several rules: a rule is true of a labelled document that is toxic and holds the rule's first word.
_FIRST = {e.rule_id: e.pattern.split("(", 2)[2].split("|")[0].rstrip(r")\b") for e in lex.FIXTURE}


@query(f"""
    WITH {_TAGS}, p AS (SELECT doc_id, rule_id FROM tags JOIN labels USING (doc_id)),
    t AS ({" UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule_id FROM documents JOIN labels USING (doc_id) WHERE contains(lower(text), '{w}')" for r, w in _FIRST.items())}),
    c AS (SELECT rule_id, count(*) FILTER (t.doc_id IS NOT NULL AND p.doc_id IS NOT NULL) AS tp, count(*) FILTER (t.doc_id IS NULL) AS fp, count(*) FILTER (p.doc_id IS NULL) AS fn
          FROM t FULL JOIN p USING (doc_id, rule_id) GROUP BY rule_id),
    w AS (SELECT * FROM c UNION ALL SELECT 'micro', sum(tp)::BIGINT, sum(fp)::BIGINT, sum(fn)::BIGINT FROM c)
    SELECT rule_id, tp, fp, fn, {_RPRF} FROM w
""")
def multilabel_prf1(spark, sf_dir):
    docs = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    truth = F.array_compact(F.array(*(F.when(F.contains(F.lower("text"), F.lit(w)), F.lit(r)) for r, w in _FIRST.items())))
    return _ROUND(evaluate.multilabel(docs.select("doc_id", F.explode(truth).alias("rule_id")), tagging.tags(docs, lex.FIXTURE, "doc_id", "text"), "doc_id"), "precision", "recall", "f1")


@query(f"WITH {_JUDGED} SELECT least(floor(round(score * 10, 6)), 9)::BIGINT AS bin, count(*) AS n, round(avg(score), 9) AS mean_score, round(avg(toxic), 9) AS observed FROM judged GROUP BY 1")
def calibration_bins(spark, sf_dir):
    return _ROUND(evaluate.calibration(_judged(spark, sf_dir), "toxic", "score"), "mean_score", "observed")


THRESHOLDS = [0.05, 0.2, 0.3, 0.4, 0.5, 0.6, 0.75]


@query(f"""
    WITH {_JUDGED}, t AS (SELECT unnest({THRESHOLDS})::DOUBLE AS threshold),
    c AS (SELECT threshold, count(*) FILTER (score >= threshold AND toxic = 1) AS tp, count(*) FILTER (score >= threshold AND toxic = 0) AS fp, count(*) FILTER (score < threshold AND toxic = 1) AS fn
          FROM judged, t GROUP BY threshold)
    SELECT threshold, tp, fp, fn, {_RPRF} FROM c
""")
def threshold_sweep(spark, sf_dir):
    return _ROUND(evaluate.sweep(_judged(spark, sf_dir), "toxic", "score", THRESHOLDS), "precision", "recall", "f1")


# ---- patterns ---------------------------------------------------------------------------




def _precursor() -> F.Column:
    return F.col("event_type") == "error"


@query("SELECT event_type, dayofweek(ts)::INT AS weekday, count(*) AS n, count(*) FILTER (value > 100) AS precursors FROM events GROUP BY ALL")
def count_by_dimension(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("weekday", (F.dayofweek("ts") - 1).cast("int"))
    return patterns.by_dimension(rows, ["event_type", "weekday"], F.col("value") > 100)


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) >= 15")
def recurring_patterns(spark, sf_dir):
    return patterns.recurring(_events(spark, sf_dir), ["user_id", "event_type"], 15)


@query("SELECT date_trunc('week', ts)::TIMESTAMP AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL")
def weekly_trend(spark, sf_dir):
    return patterns.trend(_events(spark, sf_dir), "ts", "week", ["event_type"]).withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


@query("""
    WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL),
    s AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM d GROUP BY user_id)
    SELECT user_id, day, coalesce(n, 0) AS n FROM s LEFT JOIN d USING (user_id, day)
""")
def daily_trend_filled(spark, sf_dir):
    return patterns.daily_filled(_events(spark, sf_dir), "ts", "user_id")


_DAILY = "d AS (SELECT event_type, ts::DATE AS day, count(*) AS n FROM events GROUP BY ALL)"


def _daily(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


@query(f"WITH {_DAILY} SELECT event_type, day, n, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 9) AS moving_average FROM d")
def moving_average(spark, sf_dir):
    return _ROUND(patterns.moving_average(_daily(spark, sf_dir), "event_type", "day", "n", 3), "moving_average")


@query(f"WITH {_DAILY}, l AS (SELECT *, lag(n) OVER (PARTITION BY event_type ORDER BY day) AS b FROM d) SELECT event_type, day, n, n - b AS change, round(n::DOUBLE / b, 9) AS ratio FROM l")
def period_change(spark, sf_dir):
    return _ROUND(patterns.period_change(_daily(spark, sf_dir), "event_type", "day", "n"), "ratio")


@query(f"""
    WITH {_EVIDENCE} SELECT s.doc_id, source, rule_id, start, snippet FROM spans s JOIN documents d USING (doc_id)
    WHERE lang IN ('en', 'de') AND source = 'src3' AND rule_id = 'R2'
""")
def filtered_drillthrough(spark, sf_dir):
    """From one cell (site src3, rule R2) to its reports and their evidence."""
    rows = tagging.with_rules(_docs(spark, sf_dir), lex.FIXTURE, "text")
    cell = patterns.Filters(equal={"lang": ["en", "de"]}, rules=("R2",)).cell(source="src3").apply(rows)
    found = tagging.evidence(cell, [e for e in lex.FIXTURE if e.rule_id == "R2"], "doc_id", "text", keep=("source",))
    return found.select("doc_id", "source", "rule_id", F.col("start").cast("long").alias("start"), "snippet")


def _located_orders(spark, sf_dir):
    """Orders along region, nation and priority; region and nation are dimensions of fixed size."""
    nation = table(spark, sf_dir, "nation").join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice").join(customer, F.col("o_custkey") == F.col("c_custkey"))


_PLACES = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"
_TOTALS = "count(*) AS n, round(sum(o_totalprice), 2) AS total"


def _totals() -> list[F.Column]:
    return [F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")]


@query(f"SELECT r_name, n_name, o_orderpriority, grouping_id(r_name, n_name, o_orderpriority)::BIGINT AS level, {_TOTALS} {_PLACES} GROUP BY ROLLUP (r_name, n_name, o_orderpriority)")
def drilldown_rollup(spark, sf_dir):
    return patterns.drilldown(_located_orders(spark, sf_dir), ["r_name", "n_name", "o_orderpriority"], _totals())


@query(f"SELECT r_name, o_orderpriority, grouping_id(r_name, o_orderpriority)::BIGINT AS level, {_TOTALS} {_PLACES} GROUP BY CUBE (r_name, o_orderpriority)")
def drilldown_cube(spark, sf_dir):
    return patterns.drilldown(_located_orders(spark, sf_dir), ["r_name", "o_orderpriority"], _totals(), "cube")


@query(f"SELECT r_name, n_name, o_orderpriority, {_TOTALS} {_PLACES} GROUP BY GROUPING SETS ((r_name, o_orderpriority), (n_name), ())")
def grouping_sets(spark, sf_dir):
    rows = _located_orders(spark, sf_dir)
    return rows.groupingSets([[F.col("r_name"), F.col("o_orderpriority")], [F.col("n_name")], []], "r_name", "n_name", "o_orderpriority").agg(*_totals())


@query("""
    WITH g AS (SELECT source, count(*) AS n, count(*) FILTER (toxic = 1) AS precursors FROM documents JOIN labels USING (doc_id) GROUP BY source HAVING count(*) >= 5)
    SELECT source, n, precursors, round(precursors::DOUBLE / n, 9) AS density, row_number() OVER (ORDER BY precursors::DOUBLE / n DESC, source) AS place FROM g
""")
def density_ranking(spark, sf_dir):
    """Sites by precursor density: labelled reports with the label over all labelled ones, sites under five left out."""
    rows = _docs(spark, sf_dir).select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return _ROUND(patterns.density(rows, ["source"], F.col("toxic") == 1, 5), "density")


@query(f"""
    WITH {_TAGS}, c AS (SELECT source, rule_id, count(*) AS n FROM tags JOIN documents USING (doc_id) GROUP BY ALL)
    SELECT source, rule_id, n, place FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, rule_id) AS place FROM c) WHERE place <= 2
""")
def topk_per_site(spark, sf_dir):
    tagged = _docs(spark, sf_dir).select("source", F.explode(tagging.rules_of(F.col("text"), lex.FIXTURE)).alias("rule_id"))
    counts = tagged.groupBy("source", "rule_id").agg(F.count("*").alias("n"))
    return patterns.top_per_group(counts, ["source"], [F.desc("n"), F.col("rule_id")], 2)


@query(f"WITH {_TAGS} SELECT a.rule_id AS rule_a, b.rule_id AS rule_b, count(*) AS n FROM tags a JOIN tags b ON a.doc_id = b.doc_id AND a.rule_id < b.rule_id GROUP BY ALL")
def rule_cooccurrence(spark, sf_dir):
    return patterns.cooccurring(tagging.with_rules(_docs(spark, sf_dir), lex.FIXTURE, "text"))


@query("WITH s AS (SELECT event_type AS state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_state FROM events) SELECT state, next_state, count(*) AS n FROM s WHERE next_state IS NOT NULL GROUP BY ALL")
def next_event_transition(spark, sf_dir):
    return patterns.transitions(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT event_type, ts::DATE AS day, count(DISTINCT user_id) AS contributors, count(*) AS n FROM events GROUP BY ALL")
def distinct_contributors(spark, sf_dir):
    return patterns.contributors(_events(spark, sf_dir).withColumn("day", F.to_date("ts")), ["event_type", "day"], "user_id")


@query("SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND CURRENT ROW) AS repeats FROM events")
def repeat_within_7d(spark, sf_dir):
    return patterns.repeats(_events(spark, sf_dir), ["user_id", "event_type"], "ts", 7).select("event_id", "user_id", "repeats")


@query("""
    WITH n AS (SELECT r_name, o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL)
    SELECT r_name, coalesce(sum(n) FILTER (o_orderpriority = '1-URGENT'), 0)::BIGINT AS urgent, coalesce(sum(n) FILTER (o_orderpriority = '5-LOW'), 0)::BIGINT AS low FROM n GROUP BY r_name
""")
def pivot_by_priority(spark, sf_dir):
    out = _located_orders(spark, sf_dir).groupBy("r_name").pivot("o_orderpriority", ["1-URGENT", "5-LOW"]).agg(F.count(F.lit(1)))
    return out.select("r_name", F.coalesce("1-URGENT", F.lit(0).cast("long")).alias("urgent"), F.coalesce("5-LOW", F.lit(0).cast("long")).alias("low"))


# ---- monitoring -----------------------------------------------------------------------------


@query(f"""
    WITH o AS (SELECT event_type, count(*) / sum(count(*)) OVER () AS p FROM events WHERE ts < '{SPLIT_DAY}' GROUP BY event_type),
    n AS (SELECT event_type, count(*) / sum(count(*)) OVER () AS q FROM events WHERE ts >= '{SPLIT_DAY}' GROUP BY event_type),
    b AS (SELECT event_type, coalesce(p, 1e-6) AS p, coalesce(q, 1e-6) AS q FROM o FULL JOIN n USING (event_type))
    SELECT event_type, round(p, 9) AS p, round(q, 9) AS q, round((q - p) * ln(q / p), 9) AS psi FROM b
""")
def psi_drift(spark, sf_dir):
    events = _events(spark, sf_dir)
    split = F.lit(SPLIT_DAY).cast("timestamp_ntz")
    return _ROUND(monitor.stability(events.where(F.col("ts") < split), events.where(F.col("ts") >= split), "event_type"), "p", "q", "psi")


@query(r"""
    WITH w AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda t: t <> '')) AS word FROM documents),
    k AS (SELECT DISTINCT word FROM w WHERE doc_id % 2 = 0), s AS (SELECT word, count(*) AS uses FROM w WHERE doc_id % 2 = 1 GROUP BY word)
    SELECT count(*) AS words, count(*) FILTER (k.word IS NULL) AS unseen, sum(uses)::BIGINT AS uses, coalesce(sum(uses) FILTER (k.word IS NULL), 0)::BIGINT AS unseen_uses,
           round(count(*) FILTER (k.word IS NULL)::DOUBLE / count(*), 9) AS unseen_share
    FROM s LEFT JOIN k ON s.word = k.word
""")
def vocab_drift(spark, sf_dir):
    """Documents with even ids stand for the past, the others for the present; together they are all."""
    rows = _docs(spark, sf_dir).select("doc_id", words_of.tokens(F.col("text")).alias("words"))
    return _ROUND(monitor.unseen_words(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "words"), "unseen_share")


@query("SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER (value IS NULL) AS null_value, count(*) FILTER (props IS NULL) AS null_props FROM events GROUP BY 1")
def feed_health(spark, sf_dir):
    return monitor.health(_events(spark, sf_dir), "ts", ["value", "props"])


@query(f"WITH {_JUDGED}, c AS (SELECT floor(doc_id / 200)::BIGINT AS period, {_COUNTS} FROM judged GROUP BY 1), l AS (SELECT period, tp, fp, fn, tn, {_PRF} FROM c) SELECT period, tp, fp, fn, tn, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, round(recall - lag(recall) OVER (ORDER BY period), 9) AS recall_change FROM l")
def perf_by_period(spark, sf_dir):
    """The labels have no dates: runs of 200 document numbers stand for periods."""
    rows = _judged(spark, sf_dir).withColumn("period", F.floor(F.col("doc_id") / 200).cast("long"))
    out = patterns.changed(evaluate.scores(rows, "toxic", "pred", ["period"]), "period", "recall")
    return _ROUND(out.withColumnRenamed("change", "recall_change"), "precision", "recall", "f1", "recall_change")


@query(f"""
    WITH v AS (SELECT value, count(*) FILTER (ts < '{SPLIT_DAY}') AS a, count(*) FILTER (ts >= '{SPLIT_DAY}') AS b FROM events GROUP BY value),
    r AS (SELECT abs(sum(a) OVER (ORDER BY value) / sum(a) OVER () - sum(b) OVER (ORDER BY value) / sum(b) OVER ()) AS gap FROM v)
    SELECT round(max(gap), 9) AS ks FROM r
""")
def ks_drift(spark, sf_dir):
    events = _events(spark, sf_dir)
    split = F.lit(SPLIT_DAY).cast("timestamp_ntz")
    return _ROUND(monitor.two_sample_ks(events.where(F.col("ts") < split), events.where(F.col("ts") >= split), "value"), "ks")


# ---- streaming ----------------------------------------------------------------------------------


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_batch(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    out = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _glob(sf_dir: str, name: str) -> str:
    """A table's path as a pattern: a stream's own path must be a folder, a pattern may match a file or a folder."""
    return f"{sf_dir}/[{name[0]}]{name[1:]}.parquet"


def _stream(spark, sf_dir):
    return feeds.events(spark, _glob(sf_dir, "events"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_tumbling(spark, sf_dir):
    """The batch twin's rows."""
    out = feeds.run_now(feeds.tumbling(_stream(spark, sf_dir)), _folder(spark), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("""
    SELECT time_bucket(INTERVAL 6 HOUR, ts)::TIMESTAMP - k * INTERVAL 6 HOUR AS window_start, event_type, count(*) AS n
    FROM events, (SELECT unnest([0, 1, 2, 3]) AS k) GROUP BY ALL
""")
def stream_sliding(spark, sf_dir):
    """Days that begin every six hours."""
    out = feeds.run_now(feeds.tumbling(_stream(spark, sf_dir), width="1 day", slide="6 hours"), _folder(spark), "complete")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("SELECT DISTINCT event_id, ts, user_id, event_type FROM events")
def stream_dedup(spark, sf_dir):
    out = feeds.run_now(feeds.deduplicated(_stream(spark, sf_dir), ["event_id"]), _folder(spark))
    return out.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "user_id", "event_type")


@query("""
    WITH g AS (SELECT user_id, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 30 MINUTE, true) AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS turn FROM g)
    SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM s GROUP BY user_id, turn
""")
def stream_session(spark, sf_dir):
    out = feeds.run_now(feeds.sessions(_stream(spark, sf_dir)), _folder(spark), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("""
    SELECT a.user_id, a.event_id AS first_id, b.event_id AS second_id FROM events a JOIN events b
    ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 6 HOUR WHERE a.event_type = 'error' AND b.event_type = 'purchase'
""")
def stream_stream_join(spark, sf_dir):
    """Purchases within six hours of an error of the same user, both as streams."""
    kind = lambda name: _stream(spark, sf_dir).where(F.col("event_type") == name)
    return feeds.run_now(feeds.met_within(kind("error"), kind("purchase"), "user_id", "6 HOURS"), _folder(spark))


@query("SELECT user_id AS key, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 10")
def stream_repeat_alerts(spark, sf_dir):
    """All events are one batch here, so a user has one alert, with the count it reached."""
    return feeds.run_now(feeds.repeat_alerts(_stream(spark, sf_dir), "user_id", 10), _folder(spark), "update")


@query(f"WITH {_TAGS} SELECT * FROM tags")
def stream_tags(spark, sf_dir):
    stream = spark.readStream.schema(_docs(spark, sf_dir).schema).parquet(_glob(sf_dir, "documents"))
    return feeds.run_now(feeds.tagged(stream, lex.FIXTURE, "doc_id", "text"), _folder(spark))


# ---- fitted models --------------------------------------------------------------------------------


def _rows(spark, sf_dir):
    """Labelled documents of the training folds, all documents to score."""
    docs = _docs(spark, sf_dir).select("doc_id", F.col("text").alias("narrative"), "lang")
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").where(classify.fold(F.col("doc_id")) != 0), docs


def _ensemble(spark, sf_dir):
    train, docs = _rows(spark, sf_dir)
    return classify.Ensemble.fit(train, "toxic", categories=("lang",)), docs


@query()
def ensemble_scores(spark, sf_dir):
    model, docs = _ensemble(spark, sf_dir)
    return model.score(docs).select("doc_id", "p_lr", "p_nb", "p_rf", "sif_score", "sif_pred")


@query()
def ensemble_prf1(spark, sf_dir):
    """Precision, recall and F1 of the fitted ensemble on the fold that it never saw."""
    model, docs = _ensemble(spark, sf_dir)
    held = docs.where(classify.fold(F.col("doc_id")) == 0).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    return _ROUND(evaluate.scores(model.score(held, 0.3), "toxic", "sif_pred"), "precision", "recall", "f1")


@query()
def stream_scores(spark, sf_dir):
    """The ensemble, stored and loaded again, over documents that arrive as a stream."""
    model, docs = _ensemble(spark, sf_dir)
    folder = _folder(spark)
    model.save(f"{folder}/model")
    stream = spark.readStream.schema(_docs(spark, sf_dir).schema).parquet(_glob(sf_dir, "documents")).select("doc_id", F.col("text").alias("narrative"), "lang")
    out = feeds.scored(stream, classify.Ensemble.load(f"{folder}/model")).select("doc_id", "sif_score", "sif_pred")
    return feeds.run_now(out, folder)


_BAYES = """
    d AS (SELECT doc_id, toxic, doc_id % 5 = 0 AS held, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda t: t <> '')) AS ws FROM documents JOIN labels USING (doc_id)),
    z AS (SELECT count(*) FILTER (toxic = 1) AS pos, count(*) FILTER (toxic <> 1) AS neg FROM d WHERE NOT held),
    t AS (SELECT term, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic <> 1) AS n FROM (SELECT toxic, unnest(ws) AS term FROM d WHERE NOT held) GROUP BY term HAVING count(*) >= 2),
    w AS (SELECT term, ln((p + 1) / (pos + 2)) - ln((n + 1) / (neg + 2)) AS weight FROM t, z),
    u AS (SELECT doc_id, sum(weight) AS s FROM (SELECT doc_id, unnest(ws) AS term FROM d WHERE held) JOIN w USING (term) GROUP BY doc_id),
    judged AS (SELECT doc_id, toxic, round(coalesce(s, 0) + (SELECT ln((pos + 1) / (neg + 1)) FROM z), 6) AS log_odds FROM d LEFT JOIN u USING (doc_id) WHERE held)
"""


def _bayes(spark, sf_dir):
    """The held-out labelled documents with the log odds that the other folds teach."""
    docs = _docs(spark, sf_dir).select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    held, words = classify.fold(F.col("doc_id")) == 0, words_of.tokens(F.col("text"))
    model = classify.TokenBayes.fit(docs.where(~held), "toxic", words)
    return docs.where(held).select("doc_id", "toxic").join(_ROUND6(model.score(docs.where(held), "doc_id", words), "log_odds"), "doc_id")


_ROUND6 = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})


@query(f"WITH {_BAYES} SELECT doc_id, toxic, log_odds FROM judged")
def token_bayes_scores(spark, sf_dir):
    """A classifier that SQL can fit as well, on the fold that it never saw."""
    return _bayes(spark, sf_dir)


@query(f"WITH {_BAYES}, p AS (SELECT toxic, (log_odds >= 0)::INT AS pred FROM judged), c AS (SELECT {_COUNTS} FROM p) SELECT tp, fp, fn, tn, {_RPRF} FROM c")
def token_bayes_prf1(spark, sf_dir):
    judged = _bayes(spark, sf_dir).withColumn("pred", (F.col("log_odds") >= 0).cast("int"))
    return _ROUND(evaluate.scores(judged, "toxic", "pred"), "precision", "recall", "f1")


@query(f"""
    WITH {_JUDGED}, b AS (SELECT doc_id % 2 AS new, least(floor(round(score * 10, 6)), 9)::BIGINT AS bin FROM judged),
    o AS (SELECT bin, count(*) / sum(count(*)) OVER () AS p FROM b WHERE new = 0 GROUP BY bin), n AS (SELECT bin, count(*) / sum(count(*)) OVER () AS q FROM b WHERE new = 1 GROUP BY bin)
    SELECT bin, round(coalesce(p, 1e-6), 9) AS p, round(coalesce(q, 1e-6), 9) AS q, round((coalesce(q, 1e-6) - coalesce(p, 1e-6)) * ln(coalesce(q, 1e-6) / coalesce(p, 1e-6)), 9) AS psi FROM o FULL JOIN n USING (bin)
""")
def score_drift(spark, sf_dir):
    """Whether scores moved: documents with even ids stand for the past, the others for the present."""
    rows = _judged(spark, sf_dir)
    return _ROUND(monitor.score_stability(rows.where("doc_id % 2 = 0"), rows.where("doc_id % 2 = 1"), "score"), "p", "q", "psi")


@query()
def tuned_penalty(spark, sf_dir):
    """The penalties of a grid with their cross-validated area under the precision-recall curve."""
    train, _ = _rows(spark, sf_dir)
    _, found = classify.tuned(train.select("narrative", F.col("toxic").cast("double").alias("toxic")), "toxic", [0.001, 0.1])
    return spark.createDataFrame([(float(k), float(v)) for k, v in found.items()], "penalty double, area double")


_BASKETS = "days AS (SELECT user_id, ts::DATE AS day, event_type AS x, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS i FROM events), z AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id, day FROM days))"


@query(f"""
    WITH {_BASKETS}, p1 AS (SELECT DISTINCT user_id, day, x AS s FROM days),
    p2 AS (SELECT DISTINCT a.user_id, a.day, a.x || '>' || b.x AS s FROM days a JOIN days b ON a.user_id = b.user_id AND a.day = b.day AND a.i < b.i),
    p3 AS (SELECT DISTINCT a.user_id, a.day, a.x || '>' || b.x || '>' || c.x AS s FROM days a JOIN days b ON a.user_id = b.user_id AND a.day = b.day AND a.i < b.i JOIN days c ON b.user_id = c.user_id AND b.day = c.day AND b.i < c.i)
    SELECT s AS sequence, count(*) AS freq FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3) GROUP BY s HAVING count(*) >= (SELECT ceil(0.1 * n) FROM z)
""")
def sequence_patterns(spark, sf_dir):
    """Frequent sequences of event types in a user's day."""
    days = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("e"))
    found = patterns.sequences(days.select(F.transform("e", lambda x: F.array(x["event_type"])).alias("sequence")), "sequence", 0.1, 3)
    return found.select(F.array_join(F.flatten("sequence"), ">").alias("sequence"), "freq")


@query()
def lsr_multi_output(spark, sf_dir):
    """One head for each fixture rule; the rule's own pattern gives its label."""
    train, docs = _rows(spark, sf_dir)
    train = train.withColumns({f"y_{e.rule_id}": F.col("narrative").rlike(e.pattern).cast("int") for e in lex.FIXTURE})
    return classify.MultiOutput.fit(train, {e.rule_id: f"y_{e.rule_id}" for e in lex.FIXTURE}, categories=("lang",)).score(docs, "doc_id")


@query()
def ridge_score(spark, sf_dir):
    """The target isn't stated; here it is the quality label as a number."""
    train, docs = _rows(spark, sf_dir)
    return classify.ridge(train.withColumn("target", F.col("quality").cast("double")), "target", categories=("lang",)).transform(docs).select("doc_id", "severity_score")


@query()
def kmeans_clusters(spark, sf_dir):
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding")).alias("features"))
    return patterns.clusters(rows, "features", 10).select("vec_id", "cluster_id")


@query()
def topic_clusters(spark, sf_dir):
    """Clusters of reports by their words, each with size, precursor share and terms."""
    from pyspark.ml.feature import Normalizer

    docs = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left").withColumnRenamed("text", "narrative")
    _, ready = classify.featured(docs, ["narrative", "toxic"])
    clustered = patterns.clusters(Normalizer(inputCol="features", outputCol="unit").transform(ready), "unit", 6).withColumn("words", words_of.tokens(F.col("narrative")))
    return patterns.cluster_summary(clustered, "words", F.col("toxic") == 1)


@query(f"""
    WITH {_BASKETS}, kinds AS (SELECT x, 1 << (row_number() OVER (ORDER BY x) - 1)::INT AS bit FROM (SELECT DISTINCT x FROM days)),
    baskets AS (SELECT user_id, day, bit_or(bit) AS has FROM days JOIN kinds USING (x) GROUP BY ALL),
    sets AS (SELECT s, count(*) AS freq FROM baskets, (SELECT unnest(range(1, (SELECT 1 << count(*) FROM kinds)))::INT AS s) WHERE has & s = s GROUP BY s),
    often AS (SELECT s, freq FROM sets WHERE freq >= (SELECT ceil(0.05 * n) FROM z)),
    rules AS (SELECT w.s - k.bit AS ante, k.x AS consequent, w.freq / a.freq AS confidence, w.freq / a.freq / (c.freq / n) AS lift, w.freq / n AS support
              FROM often w JOIN kinds k ON w.s & k.bit <> 0 AND w.s <> k.bit JOIN often a ON a.s = w.s - k.bit JOIN often c ON c.s = k.bit, z)
    SELECT (SELECT string_agg(x, ',' ORDER BY x) FROM kinds WHERE ante & bit <> 0) AS antecedent, consequent, round(confidence, 9) AS confidence, round(lift, 9) AS lift, round(support, 9) AS support
    FROM rules WHERE confidence >= 0.3
""")
def fpgrowth_rules(spark, sf_dir):
    """Event types of a user's day that go together; a day has no more items than there are types."""
    baskets = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.collect_set("event_type").alias("items"))
    found = patterns.frequent(baskets, "items", 0.05, 0.3).associationRules
    found = found.select(F.array_join(F.array_sort("antecedent"), ",").alias("antecedent"), F.col("consequent")[0].alias("consequent"), "confidence", "lift", "support")
    return _ROUND(found, "confidence", "lift", "support")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites ranked by precursor density, with their most frequent rule and how many spans of evidence back it."""
    docs = _docs(spark, sf_dir)
    ranked = density_ranking(spark, sf_dir)
    found = tagging.evidence(docs, lex.FIXTURE, "doc_id", "text", keep=("source",)).groupBy("source", "rule_id").agg(F.count("*").alias("spans"))
    top = patterns.top_per_group(found, ["source"], [F.desc("spans"), F.col("rule_id")], 1).drop("place")
    return ranked.join(top, "source", "left").orderBy("place")
