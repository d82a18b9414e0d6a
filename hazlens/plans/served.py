"""Queries over what is stored, ingested, served and learned: each takes a feature's whole way and has SQL for what comes out."""

from __future__ import annotations

import json

from pyspark.ml import Pipeline
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hazlens import cli
from hazlens.functions import lexicon as lex
from hazlens.functions import text as words_of
from hazlens.operators import classify, evaluate, patterns, ridge, tagging
from hazlens.operators.heads import TokenHeads
from hazlens.plans import catalogue, dashboard
from hazlens.plans.registry import query
from hazlens.session import table
from hazlens.sources import reports, sinks
from hazlens.staging import staged
from hazlens.streaming import feeds

_ROUND, _ROUND6 = catalogue._ROUND, catalogue._ROUND6
_WORDS = "list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda t: t <> '')"
_RULES = [e.rule_id for e in lex.FIXTURE]


def _as_reports(spark, sf_dir):
    """Documents as reports: source for site, lang for category, the length's remainder by three for the team."""
    docs = table(spark, sf_dir, "documents")
    team = F.concat(F.lit("team"), F.length("text") % 3)
    return reports.normalised(docs, {"report_id": "doc_id", "narrative": "text", "site": "source", "category": "lang", "team": team}, "UA")


# ---- storing and ingesting ----------------------------------------------------------------------


@query("SELECT fmt, doc_id AS report_id, md5(text) AS narrative_md5, source AS site, lang AS category FROM documents, (SELECT unnest(['csv', 'json', 'parquet']) AS fmt)")
def export_round_trip(spark, sf_dir):
    """Reports exported in every format and read again come back whole: line ends, quotes and spaces in texts too."""
    rows = _as_reports(spark, sf_dir).drop("lsr_labels")  # CSV has no lists
    folder, found = catalogue._folder(spark), []
    for fmt in ("csv", "json", "parquet"):
        sinks.export(rows, f"{folder}/{fmt}", fmt, personal=True)
        found.append(reports.read(spark, f"{folder}/{fmt}", fmt, rows.schema).withColumn("fmt", F.lit(fmt)))
    return reports.merged(*found).select("fmt", "report_id", F.md5("narrative").alias("narrative_md5"), "site", "category")


@query("SELECT doc_id AS report_id, md5(text) AS narrative_md5, source AS site FROM documents")
def stream_ingest(spark, sf_dir):
    """Reports that arrive as JSON files, a few at a time."""
    folder = catalogue._folder(spark)
    sinks.export(_as_reports(spark, sf_dir).repartition(7), f"{folder}/incoming", "json", personal=True)
    stream = reports.stream(spark, f"{folder}/incoming", fmt="json", files_per_trigger=2)
    return feeds.run_now(stream.select("report_id", F.md5("narrative").alias("narrative_md5"), "site"), f"{folder}/kept")


@query(f"""
    WITH {catalogue._JUDGED} SELECT doc_id AS report_id, 2::BIGINT AS versions, 'v1' AS first_version, 'v2' AS last_version, round(least(score * 1.5, 1.0), 9) AS last_score, (score >= 0.3) <> (least(score * 1.5, 1.0) >= 0.3) AS turned FROM judged
""")
def audit_changes(spark, sf_dir):
    """Two versions of a scorer leave their trail; whose class turned between them."""
    folder = catalogue._folder(spark)
    rows = catalogue._judged(spark, sf_dir).select(F.col("doc_id").alias("report_id"), F.col("score").alias("sif_score"))
    sinks.audit(rows, folder, "v1")
    sinks.audit(rows.withColumn("sif_score", F.least(F.col("sif_score") * 1.5, F.lit(1.0))), folder, "v2")
    return _ROUND(sinks.audited_changes(sinks.read_audit(spark, folder), 0.3), "last_score")


# ---- served ---------------------------------------------------------------------------------------

_SIF = f"(regexp_matches(text, '{lex.FIXTURE_ENERGY}') AND regexp_matches(text, '{lex.FIXTURE_CONTROL}'))::INT"
_RULE_LIST = "list_filter([" + ", ".join(f"CASE WHEN {catalogue._HIT[r]} THEN '{r}' END" for r in _RULES) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT doc_id AS report_id, {_SIF} AS sif, array_to_string({_RULE_LIST}, ',') AS rules FROM documents")
def cli_scores(spark, sf_dir):
    """What the command line's ``score`` writes for a folder of reports and a lexicon file."""
    folder = catalogue._folder(spark)
    _as_reports(spark, sf_dir).write.parquet(f"{folder}/reports")
    told = [{"rule_id": e.rule_id, "pattern": e.pattern, "weight": e.weight} for e in lex.FIXTURE]
    told += [{"rule_id": "ENERGY", "pattern": lex.FIXTURE_ENERGY}, {"rule_id": "CONTROL", "pattern": lex.FIXTURE_CONTROL}]
    spark.createDataFrame([(json.dumps(r),) for r in told], "value string").coalesce(1).write.text(f"{folder}/lexicon")
    cli.main(["score", f"{folder}/reports", f"{folder}/out", "--lexicon", f"{folder}/lexicon"])
    return spark.read.parquet(f"{folder}/out/scores").select("report_id", F.col("sif").cast("int").alias("sif"), "rules")


@query(f"""
    WITH r AS (SELECT source, lang, 'team' || length(text) % 3 AS team, {_SIF} AS sif, {_RULE_LIST} AS rules FROM documents),
    pairs AS (SELECT a.a || '&' || b.b AS pair FROM (SELECT rules, unnest(rules) AS a, row_number() OVER () AS id FROM r) a, LATERAL (SELECT unnest(a.rules) AS b) b WHERE a.a < b.b)
    SELECT 'site_ranking' AS panel, source AS key, count(*) AS n, sum(sif)::BIGINT AS precursors FROM r GROUP BY source HAVING count(*) >= 5
    UNION ALL SELECT 'team_ranking', team, count(*), sum(sif)::BIGINT FROM r GROUP BY team HAVING count(*) >= 5
    UNION ALL SELECT 'rules_together', pair, count(*), NULL FROM pairs GROUP BY pair
    UNION ALL SELECT 'feed_health', NULL, count(*), NULL FROM r
    UNION ALL SELECT 'drilldown', coalesce(source, '*'), count(*), sum(sif)::BIGINT FROM r GROUP BY ROLLUP (source)
""")
def dashboard_panels(spark, sf_dir):
    """Panels of the dashboard below each other, from one written table of tagged reports."""
    folder = catalogue._folder(spark)
    dashboard.prepared(_as_reports(spark, sf_dir), lex.FIXTURE, lex.FIXTURE_ENERGY, lex.FIXTURE_CONTROL).write.parquet(folder)
    made = dashboard.panels(spark.read.parquet(folder))
    flat = lambda name, key, n=F.col("n"), p=F.col("precursors"): made[name].select(F.lit(name).alias("panel"), key.alias("key"), n.alias("n"), p.alias("precursors"))
    none = F.lit(None).cast("long")
    # the fixtures have no location or asset, so of these levels only those of the site differ
    drill = made["drilldown"].where("level in (1, 7)").select(F.lit("drilldown").alias("panel"), F.coalesce("site", F.lit("*")).alias("key"), "n", "precursors")
    parts = [flat("site_ranking", F.col("site")), flat("team_ranking", F.col("team")), flat("rules_together", F.concat("rule_a", F.lit("&"), "rule_b"), p=none), flat("feed_health", F.lit(None).cast("string"), p=none), drill]
    return reports.merged(*parts)


# ---- streams whose rows come late or change ------------------------------------------------------


def _cut(spark, sf_dir, folder: str) -> str:
    """The events as a folder of files whose rows are out of order by far, so that a watermark would drop some."""
    events = table(spark, sf_dir, "events").withColumn("__at", F.pmod(F.xxhash64("event_id"), F.lit(6)))
    events.repartition(6, "__at").drop("__at").write.parquet(f"{folder}/incoming")
    return f"{folder}/incoming"


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_amended_counts(spark, sf_dir):
    """Daily counts from files in no order, a file a batch: what comes after its window has closed still counts."""
    folder = catalogue._folder(spark)
    stream = feeds.events(spark, _cut(spark, sf_dir, folder), files_per_trigger=1)
    feeds.each_batch(stream, f"{folder}/checkpoint", feeds.partial_counts(f"{folder}/parts", ["event_type"])).awaitTermination()
    out = feeds.amended_counts(spark, f"{folder}/parts", ["event_type"])
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("SELECT user_id, max_by(event_id, struct_pack(t := ts, e := event_id)) AS event_id, max(ts) AS ts, max_by(event_type, struct_pack(t := ts, e := event_id)) AS event_type FROM events GROUP BY user_id")
def stream_upsert_latest(spark, sf_dir):
    """The newest event of each user, upserted from files in no order."""
    folder = catalogue._folder(spark)
    stream = feeds.events(spark, _cut(spark, sf_dir, folder), files_per_trigger=1).withColumn("at", F.struct("ts", "event_id"))
    feeds.each_batch(stream, f"{folder}/checkpoint", feeds.upsert(f"{folder}/state", ["user_id"], "at")).awaitTermination()
    out = feeds.current(spark, f"{folder}/state", ["user_id"], "at")
    return out.select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_type")


# ---- learned ----------------------------------------------------------------------------------------


def _each(form: str) -> str:
    return ", ".join(form.replace("@", r) for r in _RULES)


_HEADS = f"""
    d AS (SELECT doc_id, doc_id % 5 <> 0 AS train, {", ".join(f"{catalogue._HIT[r]} AS y{r}" for r in _RULES)}, list_distinct({_WORDS}) AS ws FROM documents),
    z AS (SELECT count(*) AS rows, {_each("count(*) FILTER (y@) AS pos@")} FROM d WHERE train),
    t AS (SELECT term, count(*) AS df, {_each("count(*) FILTER (y@) AS p@")} FROM (SELECT * EXCLUDE (ws), unnest(ws) AS term FROM d WHERE train) GROUP BY term HAVING count(*) >= 2),
    w AS (SELECT term, {_each("ln((p@ + 1) / (pos@ + 2)) - ln((df - p@ + 1) / (rows - pos@ + 2)) AS w@")} FROM t, z),
    u AS (SELECT doc_id, {_each("sum(w@) AS s@")} FROM (SELECT doc_id, unnest(ws) AS term FROM d) JOIN w USING (term) GROUP BY doc_id),
    scored AS ({" UNION ALL ".join(f"SELECT doc_id, y{r} AS tagged, '{r}' AS rule_id, 1 / (1 + exp(-(coalesce(s{r}, 0) + ln((pos{r} + 1) / (rows - pos{r} + 1))))) AS score FROM d LEFT JOIN u USING (doc_id), z" for r in _RULES)})
"""


def _stored(spark, rows, labels, words) -> TokenHeads:
    """Heads fitted on four folds, stored and loaded again."""
    path = f"{catalogue._folder(spark)}/heads"
    TokenHeads.fit(rows.where(classify.fold(F.col("doc_id")) != 0), labels, words).save(path)
    return TokenHeads.load(spark, path)


def _heads(spark, sf_dir) -> TokenHeads:
    """Heads for the fixture rules, whose patterns give the labels."""
    labels = {e.rule_id: F.col("text").rlike(e.pattern) for e in lex.FIXTURE}
    return _stored(spark, table(spark, sf_dir, "documents"), labels, words_of.tokens(F.col("text")))


@query(f"WITH {_HEADS} SELECT doc_id, rule_id, round(score, 6) AS score FROM scored")
def rule_heads_scores(spark, sf_dir):
    """The confidence of every rule for every document, by heads that share one table of words."""
    return _ROUND6(_heads(spark, sf_dir).score(table(spark, sf_dir, "documents"), "doc_id", words_of.tokens(F.col("text"))), "score")


@query(f"WITH {_HEADS} SELECT doc_id, coalesce(array_to_string(list(rule_id ORDER BY rule_id) FILTER (round(score, 6) >= 0.5 AND NOT tagged), ','), '') AS model_only FROM scored GROUP BY doc_id")
def rule_heads_model_only(spark, sf_dir):
    """The rules that only the heads give, beside the patterns' own."""
    docs, text = table(spark, sf_dir, "documents"), F.col("text")
    # fit, scores and tags start from the same words and rules, so texts are cut and searched once
    ready = staged(docs.select("doc_id", F.array_join(F.array_distinct(words_of.tokens(text)), " ").alias("words"), tagging.rules_of(text, lex.FIXTURE).alias("rules")), "words")
    words = F.split(F.nullif("words", F.lit("")), " ")
    model = _stored(spark, ready, {r: F.array_contains("rules", r) for r in _RULES}, words)
    scores = _ROUND6(model.score(ready, "doc_id", words), "score")
    found = tagging.with_model_only(ready.select("doc_id", "rules"), scores, 0.5, "doc_id")
    return found.select("doc_id", F.array_join("model_only", ",").alias("model_only"))


@query(f"WITH {_HEADS} SELECT doc_id, rule_id, round(score, 6) AS score FROM scored")
def stream_head_scores(spark, sf_dir):
    """The stored heads over documents that arrive as a stream; each batch is scored as a table is."""
    folder, model = catalogue._folder(spark), _heads(spark, sf_dir)
    stream = spark.readStream.schema(table(spark, sf_dir, "documents").schema).parquet(catalogue._glob(sf_dir, "documents"))

    def write(batch, number: int) -> None:
        model.score(batch, "doc_id", words_of.tokens(F.col("text"))).write.mode("overwrite").parquet(f"{folder}/scores/batch={number}")

    feeds.each_batch(stream, f"{folder}/checkpoint", write).awaitTermination()
    return _ROUND6(spark.read.parquet(f"{folder}/scores").drop("batch"), "score")


_RIDGE = """
    x AS (SELECT doc_id, source, length(text) / 1000.0::DOUBLE AS thousands, (lang = 'en')::INT::DOUBLE AS is_en, quality::DOUBLE AS y FROM documents LEFT JOIN labels USING (doc_id)),
    m AS (SELECT source, count(*) AS n, avg(thousands) AS m1, avg(is_en) AS m2, avg(y) AS my, var_pop(thousands) + 0.1 AS a, var_pop(is_en) + 0.1 AS d, covar_pop(thousands, is_en) AS b, covar_pop(thousands, y) AS c1, covar_pop(is_en, y) AS c2 FROM x WHERE y IS NOT NULL GROUP BY source),
    w AS (SELECT *, (c1 * d - b * c2) / (a * d - b * b) AS w1, (a * c2 - b * c1) / (a * d - b * b) AS w2 FROM m)
"""
_FEATURES = ["thousands", "is_en"]


def _numbers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return docs.select("doc_id", "source", (F.length("text") / 1000).alias("thousands"), (F.col("lang") == "en").cast("double").alias("is_en"), F.col("quality").cast("double").alias("quality"))


@query(f"WITH {_RIDGE} SELECT source, n, round(my - w1 * m1 - w2 * m2, 6) AS intercept, round(w1, 6) AS slope_thousands, round(w2, 6) AS slope_is_en FROM w")
def ridge_by_site(spark, sf_dir):
    """A ridge regression of its own for each site; the target isn't stated, so it is the quality label as a number."""
    return _ROUND6(ridge.fitted(_numbers(spark, sf_dir), _FEATURES, "quality", ["source"]), "intercept", "slope_thousands", "slope_is_en")


@query(f"WITH {_RIDGE} SELECT doc_id, round(my - w1 * m1 - w2 * m2 + w1 * thousands + w2 * is_en, 6) AS severity_score FROM x LEFT JOIN w USING (source)")
def ridge_by_site_scores(spark, sf_dir):
    """Every document by its site's regression."""
    rows = _numbers(spark, sf_dir)
    return _ROUND6(ridge.predicted(rows, ridge.fitted(rows, _FEATURES, "quality", ["source"]), _FEATURES, ["source"]).select("doc_id", "severity_score"), "severity_score")


@query(f"""
    WITH {catalogue._JUDGED}, s AS (SELECT doc_id % 5 AS fold, least(floor(round(score * 100, 6)), 99)::INT AS bin, toxic FROM judged),
    g AS (SELECT fold, bin FROM (SELECT DISTINCT fold FROM s), (SELECT unnest(range(100))::INT AS bin)),
    o AS (SELECT g.fold, g.bin, coalesce(round(2.0 * count(*) FILTER (s.bin >= g.bin AND toxic = 1) / nullif(count(*) FILTER (s.bin >= g.bin) + count(*) FILTER (toxic = 1), 0), 12), 0) AS f FROM g LEFT JOIN s ON s.fold <> g.fold GROUP BY ALL),
    b AS (SELECT fold, bin, f FROM o QUALIFY row_number() OVER (PARTITION BY fold ORDER BY f DESC, bin) = 1),
    c AS (SELECT b.fold, any_value(b.bin) AS bin, any_value(f) AS f, count(*) FILTER (s.bin >= b.bin AND toxic = 1) AS tp, count(*) FILTER (s.bin >= b.bin AND toxic <> 1) AS fp, count(*) FILTER (s.bin < b.bin AND toxic = 1) AS fn, count(*) FILTER (s.bin < b.bin AND toxic <> 1) AS tn FROM b JOIN s ON b.fold = s.fold GROUP BY b.fold)
    SELECT fold, bin / 100.0 AS threshold, round(f, 9)::DOUBLE AS f1_elsewhere, tp, fp, fn, tn, round(2.0 * tp / nullif(2 * tp + fp + fn, 0), 9)::DOUBLE AS f1 FROM c
""")
def crossed_thresholds(spark, sf_dir):
    """Each fold judged at the threshold that the other folds choose."""
    rows = catalogue._judged(spark, sf_dir).withColumn("fold", classify.fold(F.col("doc_id")))
    return _ROUND(evaluate.crossed_thresholds(rows, "toxic", "score", "fold"), "f1_elsewhere", "f1")


@query("""
    SELECT doc_id, place, value FROM (SELECT doc_id, unnest(range(6)) AS place, unnest([length(text)::DOUBLE, len(string_split(text, ' '))::DOUBLE, (lang = 'de')::INT::DOUBLE, (lang = 'en')::INT::DOUBLE, (lang = 'es')::INT::DOUBLE, (lang = 'fr')::INT::DOUBLE]) AS value FROM documents)
""")
def feature_union(spark, sf_dir):
    """Text statistics and a one-hot category in one vector, an entry a row."""
    docs = table(spark, sf_dir, "documents").withColumns({"chars": F.length("text"), "words": F.size(F.split("text", " "))})
    hot = [StringIndexer(inputCol="lang", outputCol="lang_at", stringOrderType="alphabetAsc", handleInvalid="keep"), OneHotEncoder(inputCol="lang_at", outputCol="lang_hot")]
    made = Pipeline(stages=[*hot, VectorAssembler(inputCols=["chars", "words", "lang_hot"], outputCol="features")]).fit(docs).transform(docs)
    return made.select("doc_id", F.posexplode(vector_to_array("features")).alias("place", "value")).withColumn("place", F.col("place").cast("long"))


_TERMS = f"""
    k AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL),
    z AS (SELECT count(*) AS rows FROM documents),
    i AS (SELECT term, ln(any_value(rows) / count(*)) AS idf FROM k, z GROUP BY term HAVING count(*) >= 2 AND count(*) <= any_value(rows) * 0.5),
    c AS (SELECT doc_id, term AS cluster_id, round(tf * idf, 9) AS weight FROM k JOIN i USING (term) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(tf * idf, 9) DESC, term) = 1)
"""


def _term_clusters(spark, sf_dir):
    return patterns.term_clusters(table(spark, sf_dir, "documents").withColumn("words", words_of.tokens(F.col("text"))), "doc_id", F.col("words"))


@query(f"WITH {_TERMS} SELECT doc_id, cluster_id, weight FROM documents LEFT JOIN c USING (doc_id)")
def term_clusters(spark, sf_dir):
    """Documents grouped by the word that tells each best from the others."""
    return _term_clusters(spark, sf_dir)


@query(f"""
    WITH {_TERMS}, l AS (SELECT d.doc_id, cluster_id, text, toxic FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN labels USING (doc_id)),
    n AS (SELECT cluster_id, count(*) AS n, round(avg((toxic = 1)::INT), 9) AS precursor_share FROM l GROUP BY cluster_id),
    w AS (SELECT cluster_id, term, count(*) AS uses FROM (SELECT cluster_id, unnest({_WORDS}) AS term FROM l) GROUP BY ALL),
    p AS (SELECT cluster_id, string_agg(term, ' ' ORDER BY uses DESC, term) AS terms FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY uses DESC, term) <= 5) GROUP BY cluster_id)
    SELECT n.cluster_id, n, precursor_share, terms FROM n LEFT JOIN p ON n.cluster_id = p.cluster_id
""")
def term_cluster_summary(spark, sf_dir):
    """Size, precursor share and most frequent words of each such group."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("words", words_of.tokens(F.col("text")))
    placed = docs.join(_term_clusters(spark, sf_dir), "doc_id")
    out = patterns.cluster_summary(placed, "words", F.col("toxic") == 1).withColumn("terms", F.array_join("terms", " "))
    return _ROUND(out, "precursor_share")
