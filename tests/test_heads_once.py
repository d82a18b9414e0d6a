"""Heads read the rows and make their labels and words once, in the fit and in the scores."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazlens.operators import heads
from hazlens.operators.heads import TokenHeads


def _rows(spark):
    # keys are spelled like words, some words are null or repeated, some rows hold none
    rows = [(f"w{k}", [f"w{k % 5}", f"w{k % 7}", f"w{k % 7}", None, f"x{k // 2}"], k % 2 == 0) for k in range(40)] + [("w40", [], True), ("w41", None, False), ("w42", ["new", "x0"], None)]
    return spark.createDataFrame(rows, "k string, words array<string>, y boolean")


def _scores(rows, least=2):
    """The same by plain Python."""
    rows = [(k, set(ws or ()) - {None}, bool(y)) for k, ws, y in rows]
    n, pos = len(rows), sum(y for *_, y in rows)
    weight = {}
    for w in {w for _, ws, _ in rows for w in ws}:
        df, p = sum(w in ws for _, ws, _ in rows), sum(w in ws and y for _, ws, y in rows)
        if df >= least:
            weight[w] = np.log((p + 1) / (pos + 2)) - np.log((df - p + 1) / (n - pos + 2))
    return {k: 1 / (1 + np.exp(-(np.log((pos + 1) / (n - pos + 1)) + sum(weight.get(w, 0) for w in ws)))) for k, ws, _ in rows}


@pytest.mark.parametrize("common", [0, 5, 8, 100_000])
def test_scores_are_right_however_many_words_are_common(spark, tmp_path, monkeypatch, common):
    monkeypatch.setattr(heads, "COMMON", common)
    df = _rows(spark)
    TokenHeads.fit(df, {"A": F.col("y")}, F.col("words")).save(f"{tmp_path}/heads")
    model = TokenHeads.load(spark, f"{tmp_path}/heads")
    assert model.weights.where(F.col("term").isNotNull() & model._common()).count() <= common
    got = {r.k: r.score for r in model.score(df, "k", F.col("words")).collect()}
    assert got == pytest.approx(_scores(df.collect()), abs=1e-12)


def test_a_fit_makes_each_label_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def label(y):
        made.add(1)
        return y

    df = _rows(spark)
    TokenHeads.fit(df, {"A": label("y")}, F.col("words"))
    assert made.value == df.count()


def test_scores_read_the_rows_once(spark, tmp_path):
    df = _rows(spark)
    TokenHeads.fit(df, {"A": F.col("y")}, F.col("words")).save(f"{tmp_path}/heads")
    scored = TokenHeads.load(spark, f"{tmp_path}/heads").score(df, "k", F.col("words"))
    assert scored._jdf.queryExecution().executedPlan().toString().count("ExistingRDD") == 1


def test_a_fit_on_no_rows_scores_a_half(spark):
    df = _rows(spark)
    got = TokenHeads.fit(df.limit(0), {"A": F.col("y")}, F.col("words")).score(df, "k", F.col("words")).collect()
    assert len(got) == df.count() and {r.score for r in got} == {0.5}


def test_rules_that_only_the_heads_give_start_from_written_words(spark):
    from hazlens.plans import served

    out = served.rule_heads_model_only(spark, "/root/testdata/sf0.001")
    assert out.inputFiles() and "documents.parquet" not in "".join(out.inputFiles())


def test_one_pattern_finds_what_any_entry_does(spark):
    from hazlens.functions import lexicon as lex
    from hazlens.operators import tagging

    texts = ["", None, "trash", "trashy", "a Scum!", "clown_x", "Idiot moron, pathetic", "éscum", "scumé", "1loser", "under suspended load", "overspeeding; lifting plan", "no permit", "fire-watch", "Fire Watch"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for lexicon in (lex.FIXTURE, lex.SAFETY, lex.FIXTURE[:1], [*lex.FIXTURE, lex.Entry("X", "(no)")]):
        each = rows.select("k", F.array_sort(F.array_compact(F.array(*(F.when(F.col("t").rlike(e.pattern), F.lit(e.rule_id)) for e in lexicon)))).alias("want"), tagging.rules_of(F.col("t"), lexicon).alias("got"))
        assert all(r.want == r.got for r in each.collect())
    assert lex.union([*lex.FIXTURE, lex.Entry("X", "(no)")]) is None
