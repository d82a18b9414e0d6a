"""A small corpus of hand-written safety narratives with the rules and class expected of each."""

import pytest
from pyspark.sql import functions as F

from hazlens.functions import lexicon as lex
from hazlens.operators import classify, patterns, tagging
from hazlens.plans import dashboard
from hazlens.sources import reports

# (narrative, rules, sif)
CORPUS = [
    ("Welder started hot work without permit near the separator.", ["HTW", "WAU"], 1),
    ("Operator bypassed the interlock on the compressor skid, high pressure gas present.", ["BSC"], 1),
    ("Technician opened an energized panel; isolation was missing.", ["EIS"], 1),
    ("Man entered confined space without gas test.", ["CSP"], 1),
    ("Driver was not wearing a seat belt.", ["DRV"], 0),
    ("Scaffold at height found with broken toe board.", ["WAH"], 1),
    ("Crane lifted the load; people stood under suspended load without barrier.", ["LOF", "SML"], 1),
    ("Housekeeping: empty boxes left in the corridor.", [], 0),
    ("Paper cut on left finger in the office.", [], 0),
    ("Gas test done and work permit in place before vessel entry.", ["CSP", "WAU"], 0),
    ("Dropped object fell from the monkey board, nobody hurt.", ["LOF"], 0),
    ("Worker fell from height, harness defective.", ["WAH"], 1),
    ("LOTO not applied on the pump.", ["EIS"], 0),
    ("Vehicle reversing without banksman.", ["DRV"], 1),
    ("Grinding sparks reached the drain; fire watch absent.", ["HTW"], 1),
    ("Override of trip on boiler found.", ["BSC"], 0),
    ("Toolbox talk held.", ["WAU"], 0),
    ("Hoist hook latch broken.", ["SML"], 0),
    ("No leak found at the flange.", [], 0),
    ("Água derramada no chão, naïve façade café.", [], 0),
    ("", [], 0),
    (None, [], 0),
]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, t, f"site{k % 3}", "2024-01-%02d 10:00:00" % (k + 1)) for k, (t, _, _) in enumerate(CORPUS)]
    raw = spark.createDataFrame(rows, "id long, t string, s string, at string")
    return reports.normalised(raw, {"report_id": "id", "narrative": "t", "site": "s", "event_ts": "at"}, "UA")


def test_rules_and_class(corpus):
    rows = dashboard.prepared(corpus).select("report_id", "rules", "sif").collect()
    got = {r.report_id: (r.rules or [], r.sif) for r in rows}
    for k, (text, rules, sif) in enumerate(CORPUS):
        assert got[k] == (rules, sif), text


def test_every_tag_has_evidence_that_is_in_the_text(corpus):
    spans = tagging.evidence(corpus, lex.SAFETY).join(corpus.select("report_id", "narrative"), "report_id").collect()
    for s in spans:
        assert s.narrative[s.start - 1 : s.start - 1 + s.length] == s.snippet
        assert s.snippet in s.context
    tagged = {(r.report_id, r.rule_id) for r in tagging.tags(corpus, lex.SAFETY).collect()}
    assert tagged == {(s.report_id, s.rule_id) for s in spans}
    assert {r for _, r in tagged} <= {r for r, _ in lex.RULES}


def test_all_matches_are_found_with_their_places(spark):
    text = "idiot, CLOWN and idiot; clown"
    rows = tagging.evidence(spark.createDataFrame([(1, text)], "report_id long, narrative string"), lex.FIXTURE).collect()
    assert sorted((r.start, r.snippet) for r in rows) == [(1, "idiot"), (8, "CLOWN"), (18, "idiot"), (25, "clown")]


def test_filters_commute_with_tagging(corpus):
    chosen = patterns.Filters(equal={"site": ["site1"]})
    before = tagging.tags(chosen.apply(corpus), lex.SAFETY).collect()
    after = chosen.apply(tagging.with_rules(corpus, lex.SAFETY)).select("report_id", F.explode("rules").alias("rule_id")).collect()
    assert sorted(before) == sorted(after)


def test_highlight_is_safe_html(spark):
    df = spark.createDataFrame([("<b>idiot</b> & co",)], "t string")
    assert df.select(tagging.highlighted(F.col("t"), lex.FIXTURE)).first()[0] == "&lt;b&gt;<mark>idiot</mark>&lt;/b&gt; &amp; co"


def test_model_only_tags_stay_apart(spark):
    tagged = spark.createDataFrame([(1, ["EIS"]), (2, [])], "report_id long, rules array<string>")
    scores = spark.createDataFrame([(1, "EIS", 0.9), (1, "HTW", 0.8), (2, "DRV", 0.4)], "report_id long, rule_id string, score double")
    got = {r.report_id: (r.rules, r.model_only) for r in tagging.with_model_only(tagged, scores).collect()}
    assert got == {1: (["EIS"], ["HTW"]), 2: ([], [])}


def test_vote_abstains_and_breaks_ties(spark):
    df = spark.createDataFrame([(1, 1, 0), (None, 1, 0), (None, None, None), (0, 0, 1)], "a int, b int, c int")
    assert [r[0] for r in df.select(classify.vote(F.col("a"), F.col("b"), F.col("c"))).collect()] == [1, 1, None, 0]


def test_panels(corpus):
    rows = dashboard.prepared(corpus)
    made = {name: panel.collect() for name, panel in dashboard.panels(rows, min_n=1).items()}
    assert sum(r.n for r in made["by_location"]) == len(CORPUS)
    assert max(r.n for r in made["drilldown"]) == len(CORPUS)
    assert [r.place for r in made["site_ranking"]] == [1, 2, 3]
