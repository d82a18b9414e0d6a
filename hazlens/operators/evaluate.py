"""Quality of predictions. Accuracy alone is never given: the classes are uneven."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazlens.operators import monitor
from hazlens.staging import staged


def _f1(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [
        F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(tp, tp + fn).alias("recall"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def _counts(label: str, pred: str) -> list[Column]:
    y, p = F.col(label) == 1, F.col(pred) == 1
    return [F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn")]


def scores(rows: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1, of all rows or by group. A ratio over nothing is null."""
    grouped = rows.groupBy(*(by or [])).agg(*_counts(label, pred))
    return grouped.select(*(by or []), "tp", "fp", "fn", "tn", *_f1(F.col("tp"), F.col("fp"), F.col("fn")))


def confusion(rows: DataFrame, label: str, pred: str) -> DataFrame:
    return rows.groupBy(label, pred).agg(F.count("*").alias("n"))


def multilabel(truth: DataFrame, predicted: DataFrame, key: str, rule: str = "rule_id") -> DataFrame:
    """tp, fp, fn and ratios for each rule, and for all of them together as ``micro``; both inputs are (key, rule), distinct."""
    both = truth.select(key, rule, F.lit(1).alias("t")).join(predicted.select(key, rule, F.lit(1).alias("p")), [key, rule], "outer")
    counts = both.groupBy(rule).agg(F.count_if(F.col("t").isNotNull() & F.col("p").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    whole = counts.agg(F.lit("micro").alias(rule), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    return counts.unionByName(whole).select(rule, "tp", "fp", "fn", *_f1(F.col("tp"), F.col("fp"), F.col("fn")))


def macro(per_rule: DataFrame, rule: str = "rule_id") -> DataFrame:
    """The mean of each ratio over the rules."""
    return per_rule.where(F.col(rule) != "micro").agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")))


def calibration(rows: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score and observed rate by bin of the score; 1 itself falls in the last bin, and a score on an edge but for rounding above it."""
    at = F.least(F.floor(F.round(F.col(score) * bins, 6)), F.lit(bins - 1)).cast("long").alias("bin")
    return rows.groupBy(at).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("observed"))


def auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve, in ``auc``; ties count half. Scores are counted first."""
    counts = rows.groupBy(F.col(score).alias("v")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n")).where(F.col("v").isNotNull())
    ranked = monitor.running(counts, "v", ["p", "n"])
    won = F.sum(F.col("p") * (F.col("before_n") + F.col("n") / 2.0))
    return ranked.agg(F.try_divide(won, F.max("all_p").cast("double") * F.max("all_n")).alias("auc"))


def sweep(rows: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """Precision and recall at each threshold, in one pass over the rows.

    A row counts at every threshold up to its score, so each row is put in the bin of the
    largest one it reaches and the bins are summed from the top; no row is repeated.
    """
    steps = sorted(thresholds)
    # a sum and no lambda, in which the score would be worked out again for each threshold
    reached = sum((F.coalesce(F.col(score) >= t, F.lit(False)).cast("int") for t in steps[1:]), F.coalesce(F.col(score) >= steps[0], F.lit(False)).cast("int"))
    bins = rows.groupBy(reached.alias("reached")).agg(F.count_if(F.col(label) == 1).alias("y"), F.count_if(F.col(label) == 0).alias("n"))
    # the bins are at most one more than the thresholds
    at = F.array(*(F.struct(F.lit(k + 1).alias("step"), F.lit(t).alias("threshold")) for k, t in enumerate(steps)))
    out = bins.select("reached", "y", "n", F.inline(at)).groupBy("threshold").agg(
        F.sum(F.when(F.col("reached") >= F.col("step"), F.col("y")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("reached") >= F.col("step"), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("reached") < F.col("step"), F.col("y")).otherwise(0)).alias("fn"),
    )
    return out.select("threshold", "tp", "fp", "fn", *_f1(F.col("tp"), F.col("fp"), F.col("fn")))


def crossed_thresholds(rows: DataFrame, label: str, score: str, fold: str, bins: int = 100) -> DataFrame:
    """(fold, threshold, f1_elsewhere, tp, fp, fn, tn, f1): each fold judged at the threshold that is best for F1 on all others.

    Scores, 0 to 1, are counted in ``bins`` steps first, so what follows is ``bins`` rows a fold whatever the rows. Of
    equal thresholds the least is taken; rows without a label or score take no part.
    """
    at = F.least(F.floor(F.round(F.col(score) * bins, 6)), F.lit(bins - 1)).cast("int")
    judged = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = judged.groupBy(F.col(fold).alias("fold"), at.alias("bin")).agg(F.count_if(F.col(label) == 1).alias("y"), F.count_if(F.col(label) != 1).alias("n"))
    counts = staged(counts, "counts")
    dense = counts.select("fold").distinct().select("fold", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    cells = dense.join(counts, ["fold", "bin"], "left").na.fill(0, ["y", "n"])
    all_folds, down, whole = Window.partitionBy("bin"), Window.partitionBy("fold").orderBy(F.desc("bin")), Window.partitionBy("fold")
    cells = cells.withColumns({"oy": F.sum("y").over(all_folds) - F.col("y"), "on": F.sum("n").over(all_folds) - F.col("n")})
    run = lambda c: F.sum(c).over(down)
    cells = cells.select("fold", "bin", run("y").alias("tp"), run("n").alias("fp"), F.sum("y").over(whole).alias("y"), F.sum("n").over(whole).alias("n"), run("oy").alias("otp"), run("on").alias("ofp"), F.sum("oy").over(whole).alias("oy"))
    # 2 tp + fp + fn is all predicted and all true
    elsewhere = F.coalesce(F.try_divide(2.0 * F.col("otp"), F.col("otp") + F.col("ofp") + F.col("oy")), F.lit(0.0))
    best = cells.withColumn("f1_elsewhere", elsewhere).groupBy("fold").agg(F.max_by(F.struct("bin", "f1_elsewhere", "tp", "fp", "y", "n"), F.struct(F.round("f1_elsewhere", 12), -F.col("bin"))).alias("r")).select("fold", "r.*")
    fn, tn = F.col("y") - F.col("tp"), F.col("n") - F.col("fp")
    return best.select("fold", (F.col("bin") / bins).alias("threshold"), "f1_elsewhere", "tp", "fp", fn.alias("fn"), tn.alias("tn"), F.try_divide(2.0 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("y")).alias("f1"))
