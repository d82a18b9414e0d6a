"""A report's words are counted within its row."""

from __future__ import annotations

from pyspark.sql import functions as F

from hazlens.operators import patterns


def test_counts_are_made_without_an_exchange(spark, monkeypatch):
    docs = spark.createDataFrame([(1, ["b", "a", "b", "c"]), (2, []), (3, None), (4, ["a"]), (5, ["d", "d", "b"]), (6, ["c"])], "k long, ws array<string>")
    made = docs.select("k", patterns._counted(F.col("ws")).alias("c"))
    assert "Exchange" not in made._jdf.queryExecution().toString()
    got = {r.k: {x.term: x.tf for x in r.c or []} for r in made.collect()}
    assert got == {1: {"a": 1, "b": 2, "c": 1}, 2: {}, 3: {}, 4: {"a": 1}, 5: {"b": 1, "d": 2}, 6: {"c": 1}}
    want = sorted(map(tuple, patterns.term_clusters(docs, "k", F.col("ws")).collect()))
    monkeypatch.setattr(patterns, "COMMON", 1)
    assert sorted(map(tuple, patterns.term_clusters(docs, "k", F.col("ws")).collect())) == want
    assert [(k, c) for k, c, _ in want] == [(1, "b"), (2, None), (3, None), (4, "a"), (5, "b"), (6, "c")]
