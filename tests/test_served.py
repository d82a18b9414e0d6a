"""What is stored, ingested, served and learned, on rows that are made to be difficult."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazlens.functions import lexicon as lex
from hazlens.operators import evaluate, patterns, ridge
from hazlens.operators.heads import TokenHeads
from hazlens.sources import reports, sinks
from hazlens.streaming import feeds

TEXTS = ["plain", 'a "quoted" word, and a comma', "two\nlines\n\nand more", " spaces at both ends ", "back\\slash and \\\" both", '"', "", None, "tab\there", "é ü 漢字", '"\n"', "x" * 200_000]


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_exports_come_back_whole(spark, tmp_path, fmt):
    rows = spark.createDataFrame([(k, t, f"s{k}") for k, t in enumerate(TEXTS)], "report_id long, narrative string, site string")
    sinks.export(rows, f"{tmp_path}/out", fmt)
    got = {r.report_id: (r.narrative, r.site) for r in reports.read(spark, f"{tmp_path}/out", fmt, rows.schema).collect()}
    assert got == {k: (t, f"s{k}") for k, t in enumerate(TEXTS)}


def test_csv_arrives_as_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "report_id long, narrative string")
    sinks.export(rows, f"{tmp_path}/in", "csv")
    got = feeds.run_now(reports.stream(spark, f"{tmp_path}/in", rows.schema, "csv"), f"{tmp_path}/state").collect()
    assert {r.report_id: r.narrative for r in got} == dict(enumerate(TEXTS))


def test_audit_follows_the_last_word_of_each_version(spark, tmp_path):
    told = [(1, "v1", 0.2, 1), (1, "v1", 0.6, 2), (1, "v2", 0.4, 3), (2, "v1", 0.9, 1), (3, "v2", 0.1, 1), (3, "v1", 0.2, 5), (4, "v1", None, 1)]
    trail = spark.createDataFrame([(k, v, s, dt.datetime(2024, 1, d)) for k, v, s, d in told], "report_id long, model_version string, sif_score double, scored_at timestamp")
    got = {r.report_id: tuple(r)[1:] for r in sinks.audited_changes(trail).collect()}
    assert got == {1: (2, "v1", "v2", 0.4, True), 2: (1, "v1", "v1", 0.9, False), 3: (2, "v2", "v1", 0.2, False), 4: (1, "v1", "v1", None, None)}


def _events(spark, rows):
    return spark.createDataFrame([(k, ts, 1, kind, 0.0, None) for k, (ts, kind) in enumerate(rows)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_late_rows_are_counted_and_marked(spark, tmp_path):
    """The second file is days behind the first: a watermark of a day would drop it, here it counts, however often a batch is run."""
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    first, second = [(day(10), "a"), (day(10, 5), "a"), (None, "a")], [(day(2), "a"), (day(9, 3), "b"), (day(8, 3), "b"), (day(10, 6), "a")]
    write = feeds.partial_counts(f"{tmp_path}/parts", ["event_type"])
    for number, rows in enumerate([first, second, second]):
        write(_events(spark, rows).withColumn("ts", F.col("ts").cast("timestamp")), min(number, 1))
    got = {(r.window_start, r.event_type): (r.n, r.late) for r in feeds.amended_counts(spark, f"{tmp_path}/parts", ["event_type"]).collect()}
    assert got == {(day(10), "a"): (3, 0), (None, "a"): (1, 0), (day(2), "a"): (1, 1), (day(9), "b"): (1, 0), (day(8), "b"): (1, 1)}


@pytest.mark.parametrize("common", [0, 7, 20_000])
def test_heads_equal_single_classifiers(spark, tmp_path, monkeypatch, common):
    from hazlens.operators import heads
    from hazlens.operators.classify import TokenBayes

    monkeypatch.setattr(heads, "COMMON", common)

    rng = np.random.default_rng(5)
    rows = [(k, [f"w{x}" for x in rng.integers(0, 30, 12)], int(rng.integers(2)), None if k % 9 == 0 else int(rng.integers(2))) for k in range(300)] + [(300, [], 1, 0), (301, None, 0, 1)]
    df = spark.createDataFrame(rows, "k long, words array<string>, a int, b int")
    TokenHeads.fit(df, {"A": F.col("a") == 1, "B": F.col("b") == 1}, F.col("words")).save(f"{tmp_path}/heads")
    got = {(r.k, r.rule_id): r.score for r in TokenHeads.load(spark, f"{tmp_path}/heads").score(df, "k", F.col("words")).collect()}
    assert len(got) == 2 * len(rows)
    for rule, label in (("A", "a"), ("B", "b")):
        one = df.na.fill(0, [label])
        for r in TokenBayes.fit(one, label, F.col("words")).score(one, "k", F.col("words")).collect():
            assert got[r.k, rule] == pytest.approx(1 / (1 + np.exp(-r.log_odds)), abs=1e-12)


def test_ridge_equals_the_normal_equations(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 3)) * [1, 10, 0.1] + [1000, 0, 5]
    y = x @ [0.5, -0.2, 3.0] + rng.normal(size=400)
    group = np.where(np.arange(400) % 3 == 0, "p", "q")
    rows = [(str(g), *map(float, v), float(t)) for g, v, t in zip(group, x, y)] + [("q", None, 1.0, 1.0, 1.0), ("q", 1.0, float("nan"), 1.0, 1.0), ("one", 1.0, 2.0, 3.0, 4.0), (None, 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, a double, b double, c double, y double")
    model = ridge.fitted(df, ["a", "b", "c"], "y", ["g"], 0.25)
    got = {r.g: r for r in model.collect()}
    for name in "pq":
        xs, ys = x[group == name], y[group == name]
        xc, yc = xs - xs.mean(0), ys - ys.mean()
        w = np.linalg.solve(xc.T @ xc / len(xs) + 0.25 * np.eye(3), xc.T @ yc / len(xs))
        r = got[name]
        assert r.n == len(xs)
        assert np.allclose([r.slope_a, r.slope_b, r.slope_c], w) and np.isclose(r.intercept, ys.mean() - xs.mean(0) @ w)
    assert tuple(got["one"])[1:] == (1, 4.0, 0.0, 0.0, 0.0) and got[None].intercept == 4.0
    scored = ridge.predicted(df, model, ["a", "b", "c"], ["g"])
    assert scored.count() == len(rows) and scored.where("g is null").first().severity_score == 4.0
    whole = ridge.fitted(df, ["a"], "y", penalty=1.0)
    assert whole.count() == 1 and ridge.predicted(df, whole, ["a"]).where("severity_score is null").count() == 1
    assert ridge.fitted(df.limit(0), ["a"], "y").count() == 0


def test_thresholds_are_chosen_on_other_folds(spark):
    rng = np.random.default_rng(7)
    rows = [(int(k % 4), float(np.clip(rng.normal(0.35 + 0.3 * y, 0.15), 0, 1)), int(y)) for k, y in enumerate(rng.integers(0, 2, 500))]
    df = spark.createDataFrame([*rows, (0, None, 1), (1, 0.5, None)], "fold int, score double, y int")
    got = {r.fold: r for r in evaluate.crossed_thresholds(df, "y", "score", "fold", 50).collect()}
    steps = lambda s: min(int(np.floor(round(s * 50, 6))), 49)

    def f1(part, b):
        tp, said, true = (sum(f(s, y) for _, s, y in part) for f in (lambda s, y: steps(s) >= b and y == 1, lambda s, y: steps(s) >= b, lambda s, y: y == 1))
        return 2 * tp / (said + true), tp

    for fold in range(4):
        elsewhere = [f1([r for r in rows if r[0] != fold], b)[0] for b in range(50)]
        best = int(np.argmax(np.round(elsewhere, 12)))
        own, tp = f1([r for r in rows if r[0] == fold], best)
        assert (got[fold].threshold, got[fold].tp) == (best / 50, tp)
        assert got[fold].f1 == pytest.approx(own) and got[fold].f1_elsewhere == pytest.approx(elsewhere[best])


def test_reports_go_under_the_word_that_tells_them(spark):
    rows = [(1, ["crane", "crane", "the"]), (2, ["crane", "the"]), (3, ["ladder", "the"]), (4, ["ladder", "crane", "the"]), (5, ["the", "once"]), (6, []), (7, None)]
    df = spark.createDataFrame(rows, "k long, w array<string>")
    got = {r.k: r.cluster_id for r in patterns.term_clusters(df, "k", F.col("w")).collect()}
    assert got == {1: "crane", 2: "crane", 3: "ladder", 4: "ladder", 5: None, 6: None, 7: None}


def test_lexicon_files_hold_rules_and_the_patterns_that_decide(spark, tmp_path):
    lines = ['{"rule_id": "B", "pattern": "(?i)(b)", "weight": 0.5}', '{"rule_id": "A", "pattern": "(a)"}', '{"rule_id": "ENERGY", "pattern": "e"}', '{"rule_id": null, "pattern": "x"}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{tmp_path}/lexicon")
    entries, told = lex.read(spark, f"{tmp_path}/lexicon")
    assert entries == [lex.Entry("A", "(a)", 1.0), lex.Entry("B", "(?i)(b)", 0.5)] and told == {"ENERGY": "e"}
