"""Drift of data and of performance, and the health of feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazlens.staging import staged

EMPTY = 1e-6


def stability(old: DataFrame, new: DataFrame, bin: str) -> DataFrame:
    """Population stability index of each bin: (q - p) ln(q / p), with a small share for bins that one side lacks. Their sum is the index."""


    def share(df: DataFrame, name: str) -> DataFrame:
        counts = df.groupBy(bin).agg(F.count("*").alias("n"))
        total = counts.agg(F.sum("n").alias("all"))  # one row
        return counts.crossJoin(F.broadcast(total)).select(bin, (F.col("n") / F.col("all")).alias(name))

    both = share(old, "p").join(share(new, "q"), bin, "outer").select(bin, F.coalesce("p", F.lit(EMPTY)).alias("p"), F.coalesce("q", F.lit(EMPTY)).alias("q"))
    return both.withColumn("psi", (F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p")))


def unseen_words(old: DataFrame, new: DataFrame, words: str) -> DataFrame:
    """Distinct words of ``new`` and how many of them ``old`` never had, by count and by share."""
    known = old.select(F.explode(words).alias("word")).distinct().withColumn("known", F.lit(1))
    seen = new.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("uses")).join(known, "word", "left")
    out = seen.agg(F.count("*").alias("words"), F.count_if(F.col("known").isNull()).alias("unseen"), F.sum("uses").alias("uses"), F.sum(F.when(F.col("known").isNull(), F.col("uses")).otherwise(0)).alias("unseen_uses"))
    return out.withColumn("unseen_share", F.try_divide(F.col("unseen"), F.col("words")))


def health(rows: DataFrame, ts: str, columns: list[str]) -> DataFrame:
    """Volume and null counts by day."""
    return rows.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns))


def running(counts: DataFrame, at: str, columns: list[str]) -> DataFrame:
    """``counts`` with before_* and all_* of each column: its sum over the rows with a smaller ``at``, and over all rows.

    ``at`` is distinct. Each range of values is summed by itself and moved by the totals of those
    before it, so no task sees all rows. The ranges are written, so that both uses of them agree.
    """
    ranged = staged(counts.repartitionByRange(at).withColumn("__part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("__part").agg(*(F.sum(c).alias(c) for c in columns))
    # as many rows as there are ranges
    before, whole = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(1))
    shift = parts.select("__part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__before_{c}") for c in columns), *(F.sum(c).over(whole).alias(f"all_{c}") for c in columns))
    inside = Window.partitionBy("__part").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.join(F.broadcast(shift), "__part")
    return rows.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"__before_{c}") for c in columns}).drop("__part", *(f"__before_{c}" for c in columns))


def two_sample_ks(old: DataFrame, new: DataFrame, value: str) -> DataFrame:
    """The largest distance between two empirical distributions, in ``ks``. Values are counted first."""
    counts = old.select(F.col(value).alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(new.select(F.col(value).alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))).where(F.col("v").isNotNull())
    rows = running(counts.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "v", ["a", "b"])
    gap = F.abs((F.col("before_a") + F.col("a")) / F.col("all_a") - (F.col("before_b") + F.col("b")) / F.col("all_b"))
    return rows.select(gap.alias("gap")).agg(F.max("gap").alias("ks"))


def chi_square(rows: DataFrame, bin: str, is_new: Column) -> DataFrame:
    """The statistic for equal shares of the bins in old and new rows, and its degrees of freedom."""
    counts = rows.groupBy(bin).agg(F.count_if(~is_new).cast("double").alias("a"), F.count_if(is_new).cast("double").alias("b"))
    # with totals by bin, everything is a sum: (o - e)^2 / e = o^2 / e - 2 o + e, and o and e have equal sums
    sums = counts.withColumn("t", F.col("a") + F.col("b")).agg(*(F.sum(F.col(c) * F.col(c) / F.col("t")).alias(f"s{c}") for c in "ab"), F.sum("a").alias("na"), F.sum("b").alias("nb"), F.count("*").alias("bins"))
    n = F.col("na") + F.col("nb")
    return sums.select((n * (F.col("sa") / F.col("na") + F.col("sb") / F.col("nb")) - n).alias("chi_square"), (F.col("bins") - 1).alias("freedom"))


def score_stability(old: DataFrame, new: DataFrame, score: str, bins: int = 10) -> DataFrame:
    """Population stability index of a model's scores, by bin of the score."""
    at = lambda df: df.select(F.least(F.floor(F.round(F.col(score) * bins, 6)), F.lit(bins - 1)).cast("long").alias("bin"))
    return stability(at(old), at(new), "bin")


#: Size of a quantile sketch: exact up to so many values at least, then within about 1.7 ranks of so many.
SKETCH = 4096


def sketches(rows: DataFrame, ts: str, value: str, size: int = SKETCH) -> DataFrame:
    """(day, n, sketch): a quantile sketch of each day's values, to be stored once and merged for any period. Days without values have none."""
    known = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return known.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), size).alias("sketch"))


def merged(daily: DataFrame, period: Column, size: int = SKETCH) -> DataFrame:
    """(n, sketch) of the days of a period, in one row; none for a period without values."""
    return daily.where(period).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", size).alias("sketch")).where("n is not null")


def quantile_drift(daily: DataFrame, old: Column, new: Column, bins: int = 10, size: int = SKETCH) -> DataFrame:
    """(bin, upper, p, q, psi): population stability by the old period's quantiles, from stored sketches alone.

    Bins lie between neighbouring quantiles of the old period, ``upper`` included; equal quantiles are one bin, and
    the last has no upper end. Their psi sum to the index. An empty period gives no rows.
    """
    cuts = F.array(*(F.lit(k / bins) for k in range(1, bins)))
    a = staged(merged(daily, old, size).select(F.col("sketch").alias("a")), "old")
    b = merged(daily, new, size).select(F.col("sketch").alias("b"))
    found = a.select(F.kll_sketch_get_quantile_double("a", cuts)).first()
    # the edges are fewer than the bins; ranks are asked for literal values
    edges = F.array(*map(F.lit, sorted(set(found[0])))) if found else F.array().cast("array<double>")
    both = a.crossJoin(b)  # a row each at most
    if not found:
        both = both.limit(0)
    ranks = both.select(edges.alias("edges"), *(F.concat(F.array(F.lit(0.0)), F.kll_sketch_get_rank_double(s, edges), F.array(F.lit(1.0))).alias(f"r{s}") for s in "ab"))
    at = F.explode(F.sequence(F.lit(1), F.size("edges") + 1)).alias("bin")
    rows = ranks.select("*", at)
    step = lambda r: F.greatest(F.element_at(r, F.col("bin") + 1) - F.element_at(r, F.col("bin")), F.lit(EMPTY))
    rows = rows.select("bin", F.get("edges", F.col("bin") - 1).alias("upper"), step("ra").alias("p"), step("rb").alias("q"))
    return rows.withColumn("psi", (F.col("q") - F.col("p")) * F.log(F.col("q") / F.col("p")))
