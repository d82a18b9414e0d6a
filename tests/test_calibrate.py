"""Monotone maps and label models against plain loops; expiring alerts against range frames."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazlens.operators import calibrate, labelmodel
from hazlens.streaming import alerts, feeds


def monotone_by_hand(points):
    """The value of each score by the min-max formula."""
    xs = sorted({x for x, _ in points})
    n, y = ([sum(1 for a, b in points if a == x and (b or not k)) for x in xs] for k in (0, 1))
    rate = lambda a, b: sum(y[a : b + 1]) / sum(n[a : b + 1])
    return {x: max(min(rate(a, b) for b in range(k, len(xs))) for a in range(k + 1)) for k, x in enumerate(xs)}


@pytest.mark.parametrize("ranges", [1, 5, 40])
def test_map_equals_the_min_max_formula(spark, ranges):
    rng = random.Random(ranges)
    points = [(s := round(rng.random(), 2), int(rng.random() < s**2)) for _ in range(400)]
    rows = spark.createDataFrame([*points, (None, 1), (0.5, None)], "s double, y int")
    blocks = calibrate.fit(rows, "y", "s", ranges=ranges).orderBy("low").collect()
    assert all(a.value < b.value and a.high < b.low for a, b in zip(blocks, blocks[1:]))
    assert sum(b.n for b in blocks) == 400
    want = monotone_by_hand(points)
    for x, v in want.items():
        own = [b for b in blocks if b.low <= x <= b.high]
        assert len(own) == 1 and own[0].value == pytest.approx(v)


def test_held_out_error_falls(spark):
    rng = np.random.default_rng(1)
    s = rng.random(40_000)
    rows = spark.createDataFrame([(float(a), int(b), k % 2) for k, (a, b) in enumerate(zip(s, rng.random(40_000) < s**3))], "s double, y int, fold int")
    blocks = calibrate.fit(rows.where("fold = 0"), "y", "s")
    held = rows.where("fold = 1").withColumn("p", calibrate.applied(F.col("s"), blocks))
    error = lambda c: held.groupBy(F.floor(F.col(c) * 20)).agg(F.abs(F.avg(c) - F.avg("y")).alias("e"), F.count("*").alias("n")).agg(F.sum(F.col("e") * F.col("n")) / F.sum("n")).first()[0]
    assert error("p") < 0.1 * error("s")
    odd = spark.createDataFrame([(None,), (-1.0,), (2.0,)], "s double").withColumn("p", calibrate.applied(F.col("s"), blocks)).collect()
    assert odd[0].p is None and odd[1].p < 0.01 and odd[2].p > 0.9
    none = calibrate.fit(rows.limit(0), "y", "s")
    assert none.count() == 0 and rows.limit(3).withColumn("p", calibrate.applied(F.col("s"), none)).where("p is not null").count() == 0


def em_by_hand(votes, rounds):
    votes = [v for v in votes if any(x is not None for x in v)]
    p = [sum(x or 0 for x in v) / sum(x is not None for x in v) for v in votes]
    for _ in range(rounds):
        m = len(votes[0])
        a = [(sum(q if v[k] == 1 else 1 - q for v, q in zip(votes, p) if v[k] is not None) + 1) / (sum(v[k] is not None for v in votes) + 2) for k in range(m)]
        prior = (sum(p) + 1) / (len(p) + 2)
        odds = [math.log(prior / (1 - prior)) + sum((1 if x else -1) * math.log(a[k] / (1 - a[k])) for k, x in enumerate(v) if x is not None) for v in votes]
        p = [1 / (1 + math.exp(-o)) for o in odds]
    return prior, a


def planted(n, accuracy, rng):
    truth = [int(rng.random() < 0.4) for _ in range(n)]
    return truth, [[None if rng.random() < 0.2 else (t if rng.random() < a else 1 - t) for a in accuracy] for t in truth]


def test_label_model_equals_em_over_rows_and_beats_the_majority(spark):
    rng = random.Random(11)
    truth, votes = planted(4_000, [0.95, 0.9, 0.6, 0.55, 0.55], rng)
    rows = spark.createDataFrame([(k, t, *v) for k, (t, v) in enumerate(zip(truth, votes))], "id long, y int, a int, b int, c int, d int, e int")
    voters = [F.col(c) for c in "abcde"]
    model = labelmodel.fit(rows, *voters, rounds=12)
    prior, accuracy = em_by_hand(votes, 12)
    assert model.prior == pytest.approx(prior, abs=1e-9) and model.accuracy == pytest.approx(accuracy, abs=1e-9)
    assert model.accuracy == pytest.approx([0.95, 0.9, 0.6, 0.55, 0.55], abs=0.05)
    cast = sum((F.coalesce(v, F.lit(0)) for v in voters), F.lit(0)) * 2 >= sum((v.isNotNull().cast("int") for v in voters), F.lit(0))
    right = rows.select((F.when(model.probability(*voters) >= 0.5, 1).otherwise(0) == F.col("y")).cast("int").alias("m"), (cast.cast("int") == F.col("y")).cast("int").alias("v")).agg(F.avg("m"), F.avg("v")).first()
    assert right[0] > right[1] + 0.05


def test_label_model_of_messy_votes(spark):
    rows = spark.createDataFrame([(None, None), (1, None), (7, 0), (None, None)], "a int, b int")
    model = labelmodel.fit(rows, F.col("a"), F.col("b"), rounds=3)
    assert model.votes == (1, 1)
    got = [r.p for r in rows.select(model.probability(F.col("a"), F.col("b")).alias("p")).collect()]
    assert got[0] is None and got[3] is None and got[1] > 0.5 > got[2]
    assert labelmodel.fit(rows.limit(0), F.col("a"), F.col("b")).accuracy == (0.5, 0.5)
    with pytest.raises(ValueError):
        labelmodel.fit(rows)


@pytest.mark.parametrize("files", [1, 7])
def test_expiring_alerts_equal_a_range_frame_however_files_are_cut(spark, tmp_path, files):
    rng = random.Random(21)
    hours = sorted(rng.randrange(40 * 24) for _ in range(600))
    rows = [(k, rng.choice([1, 1, 1, 2, 3, None]), h) for k, h in enumerate(hours)]
    made = spark.createDataFrame(rows, "event_id long, user_id long, h long").select("event_id", F.timestamp_seconds(1_700_000_000 + F.col("h") * 3600).cast("timestamp_ntz").alias("ts"), "user_id", F.lit("e").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    folder = f"{tmp_path}/in"
    size = -(-len(rows) // files)
    for k in range(files):
        # rows of one file in no order, and its first ones swapped with the next file's, within the watermark
        part = made.where(F.floor(F.greatest(F.col("event_id") - 5 * (F.col("event_id") % 2), F.lit(0)) / size) == k).orderBy(F.xxhash64("event_id"))
        part.coalesce(1).write.mode("append").parquet(folder)
        for f in os.listdir(folder):
            if f.endswith(".parquet") and not f.startswith("done"):
                os.rename(f"{folder}/{f}", f"{folder}/done{k}.parquet")
                os.utime(f"{folder}/done{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    out = alerts.within_days(feeds.events(spark, folder, 1), "user_id", "ts", "event_id", 3, 12, "2 days")
    got = {(r.key, r.id, r.n) for r in alerts.settled(feeds.run_now(out, f"{tmp_path}/out", "update")).collect()}
    want = set()
    for i, u, h in rows:
        n = sum(1 for _, v, g in rows if v == u and h - 72 <= g <= h)
        if u is not None and n >= 12:
            want.add((u, i, n))
    assert got == want and len(want) > 50


def test_state_is_let_go(spark, tmp_path):
    """Keys that fall silent leave nothing behind once the watermark has passed."""
    rows = [(k, 1_700_000_000 + k * 60, k) for k in range(50)] + [(99, 1_700_000_000 + 30 * 86_400, 99), (100, 1_700_000_000 + 60 * 86_400, 100)]
    for k, part in enumerate([rows[:50], rows[50:51], rows[51:]]):
        frame = spark.createDataFrame(part, "event_id long, s long, user_id long").select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("e").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
        frame.coalesce(1).write.parquet(f"{tmp_path}/in{k}")
        os.makedirs(f"{tmp_path}/in", exist_ok=True)
        name = next(f for f in os.listdir(f"{tmp_path}/in{k}") if f.endswith(".parquet"))
        os.rename(f"{tmp_path}/in{k}/{name}", f"{tmp_path}/in/{k}.parquet")
        os.utime(f"{tmp_path}/in/{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    out = alerts.within_days(feeds.events(spark, f"{tmp_path}/in", 1), "user_id", "ts", "event_id", 3, 1)
    query = out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).foreachBatch(lambda df, n: df.count()).start()
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert max(held) >= 50 and held[-1] < 10
