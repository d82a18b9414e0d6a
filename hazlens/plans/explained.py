"""Queries that explain and correct: large lexicons, places behind scores, denied evidence, calibration, voters, expiring alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazlens.functions import lexicon as lex
from hazlens.functions import text as words_of
from hazlens.operators import attribution, calibrate, classify, dedup, labelmodel, monitor, patterns, phrases, scope, tagging
from hazlens.plans import catalogue
from hazlens.plans.registry import ORACLE, query
from hazlens.session import table
from hazlens.staging import staged
from hazlens.streaming import alerts, feeds

_ROUND = catalogue._ROUND


# ---- large lexicons --------------------------------------------------------------------------


@query(ORACLE["rule_evidence"])
def phrase_evidence(spark, sf_dir):
    """The evidence of the rules' patterns by the phrase index."""
    found = phrases.evidence(table(spark, sf_dir, "documents"), phrases.table(spark, lex.FIXTURE), "doc_id", "text")
    return found.withColumns({c: F.col(c).cast("long") for c in ("start", "length")})


_OPENING = "^([A-Za-z]+(?: [A-Za-z]+){3})"


@query(f"""
    WITH p AS (SELECT item_id, lower(regexp_extract(text, '{_OPENING}', 1)) AS phrase FROM benchmark),
    d AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    m AS (SELECT doc_id, item_id, regexp_extract_all(t, '\\b' || phrase || '\\b') AS m FROM d JOIN p ON phrase <> '' AND contains(t, phrase))
    SELECT doc_id, item_id::VARCHAR AS rule_id, len(m) AS n FROM m WHERE len(m) > 0
""")
def phrase_table_hits(spark, sf_dir):
    """How often documents hold the opening words of each benchmark item: a lexicon that is a table itself."""
    opening = F.regexp_extract("text", _OPENING, 1)
    made = phrases.compiled(table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("rule_id"), F.lit(0).alias("rank"), opening.alias("phrase")), phrases.ASCII_EDGE)
    # an opening may end before an accented letter, within a word; the SQL's edges, which know A to Z alone, are there too
    return phrases.evidence(table(spark, sf_dir, "documents"), made, "doc_id", "text", edge=phrases.ASCII_EDGE).groupBy("doc_id", "rule_id").agg(F.count("*").alias("n"))


# ---- places behind scores -----------------------------------------------------------------------


@query(f"""
    WITH {catalogue._BAYES}, held AS (SELECT doc_id, text, lower(text) AS t FROM documents JOIN labels USING (doc_id) WHERE doc_id % 5 = 0),
    cut AS (SELECT doc_id, text, regexp_extract_all(t, '[a-z]+') AS m, string_split_regex(t, '[a-z]+') AS b FROM held),
    rows AS (SELECT doc_id, text, generate_subscripts(m, 1) AS i, unnest(m) AS term, unnest(b[1:len(m)]) AS gap FROM cut),
    placed AS (SELECT doc_id, text, term, 1 + sum(length(gap)) OVER w + sum(length(term)) OVER w - length(term) AS start FROM rows WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    first AS (SELECT doc_id, any_value(text) AS text, term, min(start)::BIGINT AS start FROM placed GROUP BY doc_id, term)
    SELECT doc_id, term, start, length(term) AS length, substring(text, start, length(term)) AS snippet, round(weight, 9) AS contribution FROM first JOIN w USING (term)
""")
def token_bayes_spans(spark, sf_dir):
    """The words behind each held-out document's log odds, where they first stand."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id")
    held = classify.fold(F.col("doc_id")) == 0
    model = classify.TokenBayes.fit(docs.where(~held), "toxic", words_of.tokens(F.col("text")))
    found = attribution.bayes_spans(model, docs.where(held), "doc_id", "text")
    return _ROUND(found.withColumns({c: F.col(c).cast("long") for c in ("start", "length")}), "contribution")


@query()
def model_tag_spans(spark, sf_dir):
    """Up to three places for each rule that only the fitted heads give; the rule's own pattern was the label, so R3 is left out of the patterns."""
    train, docs = catalogue._rows(spark, sf_dir)
    train = train.withColumns({f"y_{e.rule_id}": F.col("narrative").rlike(e.pattern).cast("int") for e in lex.FIXTURE})
    model = classify.MultiOutput.fit(train, {e.rule_id: f"y_{e.rule_id}" for e in lex.FIXTURE}, categories=("lang",))
    tagged = tagging.with_rules(docs, lex.FIXTURE[:2]).select("doc_id", "rules")
    only = tagging.with_model_only(tagged, model.score(docs, "doc_id"), key="doc_id").select("doc_id", F.explode("model_only").alias("rule_id"))
    only = staged(only, "model-only")  # asked for twice; all documents are scored for it
    parts = attribution.contributions(model, docs.join(only.select("doc_id").distinct(), "doc_id", "left_semi"), "doc_id", categories=("lang",))
    return attribution.justified(only, parts, 3, "doc_id")


# ---- denied evidence --------------------------------------------------------------------------------

#: Frequent words of the fixtures stand for cues. They test arithmetic, not judgement.
FIXTURE_CUES = scope.Cues(before=("the", "of the", "no"), behind=("and", "in"), turn=("was", "is"))
REACH = 60


def _found_sql(name: str, entries: list[lex.Entry]) -> str:
    """Spans of the entries' patterns as (doc_id, kind, start, length)."""
    hits = " UNION ALL ".join(f"SELECT doc_id, '{e.rule_id}' AS kind, regexp_extract_all(text, '{e.pattern}', 1) AS m, string_split_regex(text, '{e.pattern}') AS b FROM documents" for e in entries)
    return f"""{name}_hits AS ({hits}), {name}_rows AS (SELECT doc_id, kind, generate_subscripts(m, 1) AS i, unnest(m) AS s, unnest(b[1:len(m)]) AS gap FROM {name}_hits),
    {name} AS (SELECT doc_id, kind, (1 + sum(length(gap)) OVER w + sum(length(s)) OVER w - length(s))::BIGINT AS start, length(s) AS length FROM {name}_rows WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i))"""


@query(f"""
    WITH {_found_sql("e", lex.FIXTURE)}, {_found_sql("c", FIXTURE_CUES.entries())},
    stops AS (SELECT doc_id, start FROM c WHERE kind = 'turn' UNION ALL
              SELECT doc_id, i + 1 FROM (SELECT doc_id, unnest(range(1, length(text) + 1)) AS i, unnest(string_split(text, '')) AS x FROM documents WHERE doc_id IN (SELECT doc_id FROM e)) WHERE x IN ('.', '!', '?', ';', chr(10))),
    l AS (SELECT e.doc_id, e.kind, e.start, max(c.start) AS at, arg_max(c.start + c.length, c.start) AS stop FROM e JOIN c ON c.doc_id = e.doc_id AND c.kind = 'before' AND c.start <= e.start GROUP BY ALL),
    r AS (SELECT e.doc_id, e.kind, e.start, min(c.start) AS at FROM e JOIN c ON c.doc_id = e.doc_id AND c.kind = 'behind' AND c.start > e.start GROUP BY ALL),
    lok AS (SELECT * FROM l WHERE start - stop BETWEEN 1 AND {REACH} AND NOT EXISTS (SELECT 1 FROM stops s WHERE s.doc_id = l.doc_id AND s.start > l.at AND s.start <= l.start)),
    rok AS (SELECT r.* FROM r JOIN e USING (doc_id, kind, start) WHERE r.at - e.start - e.length BETWEEN 1 AND {REACH} AND NOT EXISTS (SELECT 1 FROM stops s WHERE s.doc_id = r.doc_id AND s.start > r.start AND s.start <= r.at))
    SELECT e.doc_id, e.kind AS rule_id, e.start, coalesce(lok.at, rok.at) IS NOT NULL AS negated, coalesce(lok.at, rok.at) AS cue_start
    FROM e LEFT JOIN lok USING (doc_id, kind, start) LEFT JOIN rok USING (doc_id, kind, start)
""")
def denied_evidence(spark, sf_dir):
    """Every span of evidence, whether a cue denies it, and where that cue stands."""
    docs = table(spark, sf_dir, "documents")
    found = scope.judged(tagging.evidence(docs, lex.FIXTURE, "doc_id", "text"), docs, FIXTURE_CUES, "doc_id", "text", REACH)
    return found.select("doc_id", "rule_id", F.col("start").cast("long").alias("start"), "negated", F.col("cue_start").cast("long").alias("cue_start"))


# ---- calibration and voters -----------------------------------------------------------------------------

_FIT = f"""
    {catalogue._JUDGED}, s AS (SELECT round(score, 6) AS x, count(*) AS n, sum(toxic) AS y FROM judged GROUP BY 1),
    spans AS (SELECT a.x AS a, b.x AS b, sum(m.y) / sum(m.n) AS rate FROM s a JOIN s b ON a.x <= b.x JOIN s m ON m.x BETWEEN a.x AND b.x GROUP BY ALL),
    low AS (SELECT s.x, a, min(rate) AS least FROM s JOIN spans ON a <= s.x AND b >= s.x GROUP BY ALL),
    fitted AS (SELECT x, max(least) AS value FROM low GROUP BY x)
"""


@query(f"WITH {_FIT} SELECT min(x) AS low, max(x) AS high, sum(n)::BIGINT AS n, sum(y)::BIGINT AS y, round(value, 9) AS value FROM s JOIN fitted USING (x) GROUP BY value")
def calibration_map(spark, sf_dir):
    """Blocks of the rule score and the observed rate of each, in rising order."""
    out = calibrate.fit(catalogue._judged(spark, sf_dir).withColumn("score", F.round("score", 6)), "toxic", "score")
    return _ROUND(out, "low", "high", "value")


@query(f"WITH {_FIT} SELECT doc_id, round(value, 9) AS probability FROM judged JOIN fitted ON x = round(score, 6)")
def calibrated_scores(spark, sf_dir):
    """Each labelled document's probability by the map."""
    judged = catalogue._judged(spark, sf_dir).withColumn("score", F.round("score", 6))
    return _ROUND(judged.select("doc_id", calibrate.applied(F.col("score"), calibrate.fit(judged, "toxic", "score")).alias("probability")), "probability")


ROUNDS = 8


def _voters() -> list[F.Column]:
    return catalogue._heuristics()


def _em_sql(last: str) -> str:
    """The rounds of EM written out, each on the posterior of the one before."""
    hits = list(catalogue._HIT.values())
    names = [f"v{k}" for k in range(len(hits) + 2)]
    votes = [*(f"CASE WHEN {h} THEN 1 END" for h in hits), "CASE WHEN length(text) < 400 THEN 0 END", "CASE WHEN lang <> 'en' THEN 0 END"]
    some = f"coalesce({', '.join(names)}) IS NOT NULL"
    steps = [
        "votes AS MATERIALIZED (SELECT doc_id, " + ", ".join(f"{v} AS {n}" for v, n in zip(votes, names, strict=True)) + " FROM documents)",
        f"c AS MATERIALIZED (SELECT {', '.join(names)}, count(*) AS n FROM votes WHERE {some} GROUP BY ALL)",
        f"p0 AS MATERIALIZED (SELECT *, ({' + '.join(f'coalesce({n}, 0)' for n in names)}) / ({' + '.join(f'({n} IS NOT NULL)::INT' for n in names)}) AS p FROM c)",
    ]
    odds = "ln(prior / (1 - prior)) + " + " + ".join(f"coalesce((2 * {n} - 1) * ln(a_{n} / (1 - a_{n})), 0)" for n in names)
    for k in range(1, ROUNDS + 1):
        right = ", ".join(f"(coalesce(sum(n * CASE {n} WHEN 1 THEN p ELSE 1 - p END) FILTER ({n} IS NOT NULL), 0) + 1) / (coalesce(sum(n) FILTER ({n} IS NOT NULL), 0) + 2) AS a_{n}" for n in names)
        steps.append(f"t{k} AS MATERIALIZED (SELECT (sum(n * p) + 1) / (sum(n) + 2) AS prior, {right} FROM p{k - 1})")
        steps.append(f"p{k} AS MATERIALIZED (SELECT c.*, 1 / (1 + exp(-({odds}))) AS p FROM c, t{k})")
    told = {
        "accuracies": " UNION ALL ".join(f"SELECT {k}::BIGINT AS voter, round(a_{n}, 6) AS accuracy, (SELECT count({n}) FROM votes) AS votes FROM t{ROUNDS}" for k, n in enumerate(names)),
        "scores": f"SELECT doc_id, CASE WHEN {some} THEN round(1 / (1 + exp(-({odds}))), 6) END AS probability FROM votes, t{ROUNDS}",
    }
    return f"WITH {', '.join(steps)} {told[last]}"


@query(_em_sql("accuracies"))
def label_model_accuracies(spark, sf_dir):
    """How often each heuristic is right, as far as their agreement tells."""
    model = labelmodel.fit(table(spark, sf_dir, "documents"), *_voters(), rounds=ROUNDS, tolerance=-1.0)
    return spark.createDataFrame([(k, round(a, 6), n) for k, (a, n) in enumerate(zip(model.accuracy, model.votes, strict=True))], "voter long, accuracy double, votes long")


@query(_em_sql("scores"))
def label_model_scores(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = labelmodel.fit(docs, *_voters(), rounds=ROUNDS, tolerance=-1.0)
    return docs.select("doc_id", F.round(model.probability(*_voters()), 6).alias("probability"))


# ---- expiring alerts ----------------------------------------------------------------------------------------


@query("""
    SELECT user_id AS key, event_id AS id, ts AS at, n FROM (SELECT user_id, event_id, ts, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW) AS n FROM events)
    WHERE n >= 8
""")
def stream_repeats_within(spark, sf_dir):
    """Events that are the eighth or later of their user within three days, from a stream whose state expires."""
    out = alerts.within_days(catalogue._stream(spark, sf_dir), "user_id", "ts", "event_id", 3, 8)
    found = alerts.settled(feeds.run_now(out, catalogue._folder(spark), "update"))
    return found.select("key", "id", F.col("at").cast("timestamp_ntz").alias("at"), "n")


# ---- clusters, chains and interactions ---------------------------------------------------------------------


_PAIRS = ORACLE["jaccard_near_dup"].strip().removeprefix("WITH ")


@query(f"""
    WITH RECURSIVE pairs AS (WITH {_PAIRS}), names AS (SELECT text, min(doc_id) AS name, count(*) AS copies FROM documents GROUP BY text),
    links AS (SELECT key_a AS a, key_b AS b FROM pairs UNION ALL SELECT key_b, key_a FROM pairs),
    reach AS (SELECT name AS a, name AS b FROM names UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
    least AS (SELECT a AS name, min(b) AS cluster, count(*) AS texts FROM reach GROUP BY a)
    SELECT doc_id, cluster, copies, texts FROM documents JOIN names USING (text) JOIN least USING (name)
""")
def near_duplicate_clusters(spark, sf_dir):
    """Every document's cluster of near-duplicates, without the pairs within it."""
    return dedup.clusters(table(spark, sf_dir, "documents"), "doc_id", "text")


STEPS, WITHIN = ["view", "click", "purchase"], 2


@query(f"""
    SELECT c.user_id, c.ts, c.event_id, max(a.ts) AS began FROM events a
    JOIN events b ON a.user_id = b.user_id AND (b.ts, b.event_id) > (a.ts, a.event_id) AND b.ts <= a.ts + INTERVAL {WITHIN} DAY
    JOIN events c ON b.user_id = c.user_id AND (c.ts, c.event_id) > (b.ts, b.event_id) AND c.ts <= a.ts + INTERVAL {WITHIN} DAY
    WHERE a.event_type = '{STEPS[0]}' AND b.event_type = '{STEPS[1]}' AND c.event_type = '{STEPS[2]}' GROUP BY ALL
""")
def chains_within_days(spark, sf_dir):
    """Purchases that end a chain of view, click and purchase of one user within two days."""
    found = patterns.chains(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type", STEPS, WITHIN)
    return found.withColumn("began", F.col("began").cast("timestamp_ntz"))


@query(f"""
    WITH {catalogue._TAGS}, r AS (SELECT rule_id, source, lang FROM tags JOIN documents USING (doc_id)),
    c AS (SELECT rule_id, source, lang, count(*) AS n FROM r GROUP BY ALL),
    m AS (SELECT *, sum(n) OVER (PARTITION BY rule_id) AS a, sum(n) OVER (PARTITION BY source) AS b, sum(n) OVER (PARTITION BY lang) AS l, sum(n) OVER () AS t FROM c),
    e AS (SELECT *, a::DOUBLE * b * l / t / t AS expected FROM m)
    SELECT rule_id, source, lang, n, round(expected, 9) AS expected, round(n / expected, 9) AS lift,
           round(2 * (n * ln(n / expected) + CASE WHEN t > n THEN (t - n) * ln((t - n) / (t - expected)) ELSE 0 END), 6) AS g FROM e
""")
def rule_interactions(spark, sf_dir):
    """Rule, site and category together: how much oftener than if they had nothing to do with each other."""
    tagged = table(spark, sf_dir, "documents").select("source", "lang", F.explode(tagging.rules_of(F.col("text"), lex.FIXTURE)).alias("rule_id"))
    out = patterns.interaction(tagged, ["rule_id", "source", "lang"])
    return _ROUND(out, "expected", "lift").withColumn("g", F.round("g", 6))


# ---- drift from stored sketches ------------------------------------------------------------------------------


@query(f"""
    WITH o AS (SELECT value FROM events WHERE ts < '{catalogue.SPLIT_DAY}'), n AS (SELECT value FROM events WHERE ts >= '{catalogue.SPLIT_DAY}'),
    c AS (SELECT value, cume_dist() OVER (ORDER BY value) AS d FROM o),
    e AS (SELECT DISTINCT (SELECT min(value) FROM c WHERE d >= k / 10.0 - 1e-12) AS upper FROM (SELECT unnest(range(1, 10)) AS k)),
    u AS (SELECT upper FROM e UNION ALL SELECT NULL),
    b AS (SELECT row_number() OVER (ORDER BY upper NULLS LAST)::INT AS bin, upper, lag(upper) OVER (ORDER BY upper NULLS LAST) AS low FROM u),
    s AS (SELECT bin, upper, (SELECT count(*) FROM o WHERE (upper IS NULL OR value <= upper) AND (low IS NULL OR value > low)) / (SELECT count(*) FROM o) AS p,
                 (SELECT count(*) FROM n WHERE (upper IS NULL OR value <= upper) AND (low IS NULL OR value > low)) / (SELECT count(*) FROM n) AS q FROM b),
    f AS (SELECT bin, upper, greatest(p, 1e-6) AS p, greatest(q, 1e-6) AS q FROM s)
    SELECT bin, upper, round(p, 9) AS p, round(q, 9) AS q, round((q - p) * ln(q / p), 9) AS psi FROM f
""")
def quantile_drift(spark, sf_dir):
    """Drift of the values by the old period's quantiles, from a sketch a day.

    Sketches of few values are exact, and so the SQL, which counts, holds there; with more values ranks
    are within the sketches' bound, which the tests check.
    """
    daily = monitor.sketches(table(spark, sf_dir, "events"), "ts", "value", 16_384)
    split = F.lit(catalogue.SPLIT_DAY).cast("date")
    return _ROUND(monitor.quantile_drift(daily, F.col("day") < split, F.col("day") >= split, 10, 16_384), "p", "q", "psi")


# ---- change points --------------------------------------------------------------------------------------------


@query("""
    WITH d AS (SELECT event_type, ts::DATE AS day, count(*) AS v FROM events GROUP BY ALL),
    t AS (SELECT *, count(*) OVER a AS n, avg(v) OVER a AS mean, stddev_pop(v) OVER a AS sd, sum(v) OVER a AS total, row_number() OVER w AS k, sum(v) OVER w AS c
          FROM d WINDOW a AS (PARTITION BY event_type), w AS (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING)),
    s AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round(abs(c - k * mean), 9) DESC, day) AS place FROM t WHERE k < n AND sd > 0)
    SELECT event_type, n, day AS change_at, round(c / k, 9) AS mean_before, round((total - c) / (n - k), 9) AS mean_after, round(abs(c - k * mean) / sd / sqrt(n), 9) AS statistic FROM s WHERE place = 1
""")
def change_points(spark, sf_dir):
    """The day after which the daily number of each type of event changed most."""
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("v"))
    return _ROUND(patterns.change_points(daily, "event_type", "day", "v"), "mean_before", "mean_after", "statistic")
