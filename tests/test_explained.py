"""Places behind a model's score, and evidence that is denied."""

import math
import re

import pytest
from pyspark.sql import functions as F

from hazlens.functions import lexicon as lex
from hazlens.functions import text as words_of
from hazlens.operators import attribution, classify, phrases, scope, tagging

NARRATIVES = ["Hot work near the tank, sparks seen", "hot work permit missing; hot sparks", "ladder slipped, man fell from the ladder", "Ladder in good order", "crane lifted a load", "İzmir crane ladder", "", None, "the of and", "sparks sparks SPARKS"] * 4


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.createDataFrame([(k, t, "ab"[k % 2]) for k, t in enumerate(NARRATIVES)], "report_id long, narrative string, category string")
    known = rows.where("narrative is not null").withColumns({"y1": F.contains("narrative", F.lit("sparks")).cast("int"), "y2": F.lower("narrative").contains("ladder").cast("int")})
    return rows, classify.MultiOutput.fit(known, {"HTW": "y1", "WAH": "y2"}, categories=("category",))


def test_contributions_sum_to_the_logit(fitted):
    rows, model = fitted
    rows = rows.where("narrative is not null")
    got = attribution.contributions(model, rows, categories=("category",)).groupBy("report_id", "rule_id").agg(F.sum("contribution").alias("s")).collect()
    want = {(r.report_id, r.rule_id): math.log(r.score / (1 - r.score)) for r in model.score(rows).collect()}
    assert len(got) == len(want) == 2 * rows.count()
    for r in got:
        assert r.s == pytest.approx(want[r.report_id, r.rule_id], abs=1e-6)


def test_places_hold_what_they_say(fitted):
    rows, model = fitted
    parts = attribution.contributions(model, rows, categories=("category",)).join(rows, "report_id").where("kind in ('word', 'pair')").collect()
    assert {r.kind for r in parts} == {"word", "pair"}
    for r in parts:
        if "İ" in r.narrative:
            assert r.start is None
        else:
            assert r.narrative[r.start - 1 : r.start - 1 + r.length] == r.snippet
            assert re.sub(r"(\W+(the|a|in|from|of|and)\b)*\W+", " ", r.snippet.lower()) == r.term


def test_model_only_tags_get_places(fitted):
    rows, model = fitted
    scores = model.score(rows.where("narrative is not null"))
    tagged = tagging.with_rules(rows, [lex.entry("WAH", "scaffold")])
    only = tagging.with_model_only(tagged.select("report_id", "rules"), scores).select("report_id", F.explode("model_only").alias("rule_id"))
    found = attribution.justified(only, attribution.contributions(model, rows, categories=("category",)), 2)
    assert {(r.report_id, r.rule_id) for r in found.collect()} >= {(r.report_id, r.rule_id) for r in only.collect() if "İ" not in NARRATIVES[r.report_id]}
    assert found.where("place = 1 and rule_id = 'WAH' and lower(snippet) like '%ladder%'").count() > 0


def test_bayes_spans_sum_to_the_log_odds(spark):
    rows = spark.createDataFrame([(k, t, int(bool(t) and "parks" in t)) for k, t in enumerate(NARRATIVES)], "report_id long, narrative string, y int").where("narrative is not null")
    model = classify.TokenBayes.fit(rows, "y", words_of.tokens(F.col("narrative")))
    prior = model.weights.where("term is null").first().weight
    spans = attribution.bayes_spans(model, rows, "report_id", "narrative").groupBy("report_id").agg(F.sum("contribution").alias("s"))
    for r in model.score(rows, "report_id", words_of.tokens(F.col("narrative"))).join(spans, "report_id", "left").collect():
        assert (r.s or 0) + prior == pytest.approx(r.log_odds)


# (narrative, asserted rules, denied rules)
DENIED = [
    ("No hot work was done today.", [], ["HTW"]),
    ("Hot work was done without permit. No injury.", ["HTW", "WAU"], []),
    ("There were no sparks; ladder slipped.", ["WAH"], ["HTW"]),
    ("No sparks, but the ladder slipped.", ["WAH"], ["HTW"]),
    ("Not a crane. Crane!", ["SML"], ["SML"]),
    ("Gas testing was not required for the job.", [], ["CSP"]),
    ("Scaffold not found.\nHarness found", ["WAH"], ["WAH"]),
    ("No one in the crew that had come in from the other yard used a harness", ["WAH"], []),
    ("Nothing of note: crane", ["SML"], []),
    ("NEVER bypass interlocks", [], ["BSC"]),
    ("", [], []),
    (None, [], []),
]


def test_denied_evidence(spark):
    reports = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(DENIED)], "report_id long, narrative string")
    found = tagging.evidence(reports, lex.SAFETY)
    out = scope.judged(found, reports, scope.SAFETY).cache()
    assert out.count() == found.count()
    for k, (text, yes, no) in enumerate(DENIED):
        own = out.where(F.col("report_id") == k).collect()
        assert sorted({r.rule_id for r in own if not r.negated}) == yes, text
        assert sorted({r.rule_id for r in own if r.negated}) == no, text
        for r in own:
            if r.negated:
                assert text[r.cue_start - 1 : r.cue_start - 1 + len(r.cue)] == r.cue
    assert {(r.report_id, r.rule_id) for r in scope.asserted(out).collect()} == {(k, r) for k, (_, yes, _) in enumerate(DENIED) for r in yes}
    by_index = phrases.evidence(reports, phrases.table(spark, lex.SAFETY))
    assert sorted(scope.judged(by_index, reports, scope.SAFETY).select("report_id", "rule_id", "start", "negated").collect()) == sorted(out.select("report_id", "rule_id", "start", "negated").collect())


def test_bayes_spans_carry_no_text_with_their_words(spark):
    """The rows of words that are exchanged hold the words alone; places and snippets are those of the first of each word."""
    texts = ["Ab ab AB çd İab ab", "x " * 3_000 + "Ab", "b-B a", None, "", "Kab kab"]
    rows = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(texts)], "report_id long, narrative string, y int")
    model = classify.TokenBayes(spark.createDataFrame([(t, 1.0) for t in ("ab", "b", "d", "kab", "x")] + [(None, 0.5)], "term string, weight double"))
    spans = attribution.bayes_spans(model, rows, "report_id", "narrative")
    got = sorted((r.report_id, r.term, r.start, r.length, r.snippet) for r in spans.collect())
    assert got == [(0, "ab", 1, 2, "Ab"), (0, "d", 11, 1, "d"), (1, "ab", 6_001, 2, "Ab"), (1, "x", 1, 1, "x"), (2, "b", 1, 1, "b"), (5, "kab", 1, 3, "Kab")]
    assert "Aggregate" not in spans._jdf.queryExecution().optimizedPlan().toString()
