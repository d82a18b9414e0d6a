"""The phrase index against searches for the same lexicon's patterns, and places against plain sums."""

import itertools
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hazlens.functions import lexicon as lex
from hazlens.functions import text as words
from hazlens.operators import monitor, patterns, phrases, tagging
from tests.test_golden import CORPUS

TEXTS = ["Lift plan, lifting plan and LIFT PLAN; liftplan", "hot work hot work work hot work", "seat belt seatbelt seat-belt", "energised energized", "naïve hot work façade", "_hot work_ hot work1 (hot work)", "", None, "under suspended load under a suspended load", "lift", "\U0001f600 hot work\nhot\nwork hot  work"]
OVERLAPS = [lex.entry("A", "b c", "a b", "a", "a b c"), lex.entry("B", "c a", "a b c", "b"), lex.entry("C", "a")]


def rows_of(df):
    return sorted(map(tuple, df.select("report_id", "rule_id", "start", "length", "snippet", "context").collect()))


def reports_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "report_id long, narrative string")


@pytest.mark.parametrize("inline", [phrases.INLINE, 3])
def test_evidence_equals_that_of_the_patterns(spark, inline):
    reports = reports_of(spark, [t for t, _, _ in CORPUS] + TEXTS)
    got = phrases.evidence(reports, phrases.table(spark, lex.SAFETY), inline=inline)
    assert rows_of(got) == rows_of(tagging.evidence(reports, lex.SAFETY))
    assert {tuple(r) for r in phrases.tags(reports, phrases.table(spark, lex.SAFETY)).collect()} == {tuple(r) for r in tagging.tags(reports, lex.SAFETY).collect()}


def test_phrases_that_overlap(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcABC", k=rng.randrange(40))) for _ in range(150)] + ["a b c " * 5_000]
    reports = reports_of(spark, texts)
    assert rows_of(phrases.evidence(reports, phrases.table(spark, OVERLAPS))) == rows_of(tagging.evidence(reports, OVERLAPS))


def test_messy_reports_and_lexicons(spark):
    twice = spark.createDataFrame([(1, "hot work", "x"), (1, "hot work", "x"), (None, "hot work", None)], "report_id long, narrative string, phrase string")
    made = phrases.table(spark, lex.SAFETY)
    assert phrases.evidence(twice, made, keep=("phrase",)).count() == 3
    assert phrases.evidence(twice.limit(0), made).count() == 0
    assert phrases.evidence(twice, made.limit(0)).count() == 0
    odd = spark.createDataFrame([("A", 0, "-x"), ("A", 1, ""), ("A", 2, None), ("A", 3, "Hot"), ("A", 4, "x.")], "rule_id string, rank long, phrase string")
    assert [r.snippet for r in phrases.evidence(twice.limit(1), phrases.compiled(odd)).collect()] == ["hot"]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", " ", "é", "-", "1", "_", "\n", "\U0001f600"]), max_size=400).map("".join))
def test_places_of_pieces(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(words.pieces(F.col("t")).alias("p")).select("p", words.starts(F.col("p")).alias("s")).first()
    assert "".join(row.p) == text
    assert row.s == [1 + n for n in itertools.accumulate(map(len, row.p[:-1]), initial=0)]


def test_stems_stand_for_phrases():
    assert lex.expanded("lift(?:ing)? plan") == ["lifting plan", "lift plan"]
    assert lex.expanded("energi[sz]ed") == ["energised", "energized"]
    with pytest.raises(ValueError):
        lex.expanded("a+")


def test_time_does_not_follow_the_number_of_phrases(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(3_000)]
    reports = reports_of(spark, [" ".join(rng.choices(vocabulary, k=400)) for _ in range(4_000)]).repartition(8).cache()
    reports.count()

    def seconds(n):
        # all lexicons have the same matches: three phrases that occur, others that don't
        lexicon = [lex.entry(f"R{k}", w if k < 3 else f"zz{w}") for k, w in enumerate(vocabulary[:n])]
        made = phrases.table(spark, lexicon).cache()
        made.count()
        out = []
        for _ in range(3):
            began = time.time()
            phrases.evidence(reports, made).write.format("noop").mode("overwrite").save()
            out.append(time.time() - began)
        return min(out)

    few = seconds(3)
    assert seconds(300) < 2 * few + 0.5


# ---- ranges -----------------------------------------------------------------------------


def test_places_are_all_numbers_from_one(spark):
    """Many groups with columns beside them, in many partitions."""
    n = 600_000
    rows = spark.range(n).select(F.xxhash64("id").alias("k"), F.concat(F.lit("payload "), F.col("id")).alias("p"), "id")
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = patterns.placed(rows, [F.desc("k")])
        got = placed.agg(F.count_distinct("place").alias("d"), F.min("place").alias("a"), F.max("place").alias("b")).first()
        assert tuple(got) == (n, 1, n)
        found = patterns.density(rows.withColumn("site", F.col("id")), ["site"], F.col("k") % 2 == 0).agg(F.count_distinct("place"), F.max("place")).first()
        assert tuple(found) == (n, n)
        summed = monitor.running(rows.select("k", F.lit(1).alias("a"), "p"), "k", ["a"]).agg(F.count_distinct("before_a"), F.max("before_a")).first()
        assert tuple(summed) == (n, n - 1)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)


def test_phrases_that_end_before_an_accented_letter(spark):
    """Where only A to Z are letters a word ends before an accented one, as in SQL engines on RE2."""
    lexicon = spark.createDataFrame([("A", 0, "las en de os"), ("B", 0, "os")], "rule_id string, rank long, phrase string")
    reports = reports_of(spark, ["Las en de osóción", "las en de os", "las en de ososo", "ñlas en de os_", "éos, os"])
    got = phrases.evidence(reports, phrases.compiled(lexicon, phrases.ASCII_EDGE), edge=phrases.ASCII_EDGE)
    assert sorted((r.report_id, r.rule_id, r.start) for r in got.collect()) == [(0, "A", 1), (0, "B", 11), (1, "A", 1), (1, "B", 11), (4, "B", 2), (4, "B", 6)]
