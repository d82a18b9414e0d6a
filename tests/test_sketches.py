"""Drift from stored sketches: exact for few values, within bounds for many, and the same however days are merged."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazlens.operators import monitor


def days_of(spark, n, shift):
    """(ts, v) over 20 days; the second ten days are shifted."""
    rows = spark.range(n).select(F.timestamp_seconds(F.lit(1_704_067_200) + F.pmod("id", F.lit(20)) * 86_400).alias("ts"), (F.randn(3) + F.when(F.pmod("id", F.lit(20)) >= 10, shift).otherwise(0.0)).alias("v"))
    return rows.cache()



def periods():
    split = F.lit("2024-01-11").cast("date")
    return F.col("day") < split, F.col("day") >= split


def by_hand(rows, bins):
    d = rows.select(F.to_date("ts").cast("string").alias("day"), "v").toPandas()
    a, b = np.sort(d.v[d.day < "2024-01-11"].to_numpy()), np.sort(d.v[d.day >= "2024-01-11"].to_numpy())
    edges = np.unique([a[int(np.ceil(k / bins * len(a) - 1e-9)) - 1] for k in range(1, bins)])
    share = lambda x: np.diff(np.concatenate([[0], np.searchsorted(x, edges, side="right"), [len(x)]])) / len(x)
    return edges, np.maximum(share(a), 1e-6), np.maximum(share(b), 1e-6)


@pytest.mark.parametrize("n, size, bound", [(2_000, 4096, 1e-12), (200_000, 1024, 0.01)])
def test_drift_of_sketches(spark, n, size, bound):
    rows, (old, new) = days_of(spark, n, 0.5), periods()
    got = monitor.quantile_drift(monitor.sketches(rows, "ts", "v", size), old, new, 10, size).orderBy("bin").collect()
    edges, p, q = by_hand(rows, 10)
    assert [r.bin for r in got] == list(range(1, 11)) and got[-1].upper is None
    assert np.abs(np.cumsum([r.p for r in got]) - np.cumsum(p)).max() <= bound
    assert np.abs(np.cumsum([r.q for r in got]) - np.cumsum(q)).max() <= 3 * bound
    assert sum(r.psi for r in got) == pytest.approx(float(((q - p) * np.log(q / p)).sum()), abs=1e-9 if bound < 1e-9 else 0.03)


def test_merging_in_parts_keeps_ranks(spark):
    """Sketches of days merged at once, and merged by weeks first, agree within the bound; counts add up."""
    rows, (old, _) = days_of(spark, 100_000, 0.0), periods()
    daily = monitor.sketches(rows, "ts", "v", 1024).cache()
    once = monitor.merged(daily, old, 1024)
    weekly = daily.where(old).groupBy(F.dayofmonth("day") % 3).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(1024)).alias("sketch"))
    twice = weekly.agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(1024)).alias("sketch"))
    cuts = F.array(*(F.lit(x) for x in (-1.0, 0.0, 1.0)))
    a, b = (x.select("n", F.kll_sketch_get_n_double("sketch").alias("m"), F.kll_sketch_get_rank_double("sketch", cuts).alias("r")).first() for x in (once, twice))
    assert a.n == b.n == a.m == b.m == rows.where(F.to_date("ts") < "2024-01-11").count()
    assert max(abs(x - y) for x, y in zip(a.r, b.r)) < 0.01 and a.r == sorted(a.r)


def test_periods_without_values(spark):
    rows, (old, new) = days_of(spark, 100, 0.0), periods()
    daily = monitor.sketches(rows.unionByName(spark.createDataFrame([(None, float("nan")), (None, None)], "ts timestamp, v double")), "ts", "v")
    assert daily.agg(F.sum("n")).first()[0] == 100
    assert monitor.quantile_drift(daily, F.lit(False), new).count() == 0
    assert monitor.quantile_drift(daily, old, F.lit(False)).count() == 0
    same = spark.createDataFrame([(1.0,)] * 50, "v double").withColumn("ts", F.timestamp_seconds(F.lit(1_704_067_200)))
    got = monitor.quantile_drift(monitor.sketches(same, "ts", "v"), old, old).collect()
    assert [r.upper for r in got] == [1.0, None] and sum(r.psi for r in got) == pytest.approx(0)
