"""Features are made once, and trees are grown on bounded tasks."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from hazlens.operators import classify


def _reports(spark):
    rows = [(k, f"word{k % 7} fell from height {k % 3}" if k % 2 else f"paper cut {k % 5}", "en" if k % 3 else "de", k % 2) for k in range(60)]
    return spark.createDataFrame(rows, "report_id long, narrative string, lang string, y int")


def test_features_start_from_written_counts(spark):
    rows = _reports(spark)
    shared, ready = classify.featured(rows, ["report_id", "y"], categories=("lang",))
    plain = Pipeline(stages=classify.features(categories=("lang",))).fit(rows)
    want = {r.report_id: r.features for r in plain.transform(rows).collect()}
    assert {r.report_id: r.features for r in ready.collect()} == want
    assert {r.report_id: r.features for r in shared.transform(rows).collect()} == want
    # what a fit reads are files of counts; no text is cut again
    assert ready.inputFiles() and "narrative" not in ready._jdf.queryExecution().toString()


def test_trees_take_tasks_of_bounded_rows(spark, monkeypatch):
    taken, made = [], classify._member

    def member(name, label, seed):
        head = made(name, label, seed)
        if name == "rf":
            grow = head.fit
            head.fit = lambda df: (taken.append(df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]), grow(df))[1]
        return head

    monkeypatch.setattr(classify, "_member", member)
    monkeypatch.setattr(classify, "TREE_ROWS", 10)
    model = classify.Ensemble.fit(_reports(spark), "y", categories=("lang",), members=("rf",))
    assert taken and taken[0] <= 20
    assert model.score(_reports(spark)).count() == 60
