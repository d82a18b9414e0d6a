"""One small table for each dashboard panel, over a table of scored and tagged reports."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Normalizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazlens.functions import text as words_of
from hazlens.functions.lexicon import CONTROL_FAILED, ENERGY, SAFETY, Entry
from hazlens.operators import classify, evaluate, monitor, patterns, tagging


def prepared(reports: DataFrame, lexicon: list[Entry] = SAFETY, energy: str = ENERGY, control_failed: str = CONTROL_FAILED, model: classify.Ensemble | None = None, threshold: float = 0.5) -> DataFrame:
    """Reports, a table or a stream, with ``rules``, ``sif`` and ``sif_score``; write it once and let every panel read it.

    With a fitted model its score decides, else the rule of energy and failed control, whose score is 0 or 1.
    """
    rows = tagging.with_rules(reports, lexicon)
    if model is None:
        rows = rows.withColumn("sif", classify.energy_and_control(F.col("narrative"), energy, control_failed))
        return rows.withColumn("sif_score", F.col("sif").cast("double"))
    # the model's features need a text
    rows = rows.withColumn("narrative", F.coalesce("narrative", F.lit("")))
    return model.score(rows, threshold).withColumnRenamed("sif_pred", "sif")


def panels(rows: DataFrame, filters: patterns.Filters = patterns.Filters(), min_n: int = 5, split: str | None = None) -> dict[str, DataFrame]:
    """The panels under one set of filters. Nothing runs until a panel is read.

    split: the day between past and present, for the panels of drift.
    """
    rows = filters.apply(rows)
    sif = F.col("sif") == 1
    out = {
        "by_activity": patterns.by_dimension(rows, ["activity"], sif),
        "by_location": patterns.by_dimension(rows, ["location"], sif),
        "by_asset": patterns.by_dimension(rows, ["asset"], sif),
        "by_barrier": patterns.by_dimension(rows, ["barrier"], sif),
        "weekly": patterns.trend(rows.where(sif), "event_ts", "week"),
        "recurring": patterns.recurring(rows.where(sif), ["site", "activity"], 2),
        "site_ranking": patterns.density(rows, ["site"], sif, min_n),
        "team_ranking": patterns.density(rows, ["team"], sif, min_n),
        "activity_ranking": patterns.density(rows, ["activity"], sif, min_n),
        "rules_together": patterns.cooccurring(rows),
        "drilldown": patterns.drilldown(rows, ["location", "site", "asset"], [F.count("*").alias("n"), F.count_if(sif).alias("precursors")]),
        "feed_health": monitor.health(rows, "event_ts", ["narrative", "site", "category"]),
    }
    if "sif_label" in rows.columns:
        judged = rows.where(F.col("sif_label").isNotNull()).withColumn("month", F.date_trunc("month", "event_ts"))
        out["performance"] = evaluate.scores(judged, "sif_label", "sif", ["month"])
        out["calibration"] = evaluate.calibration(judged, "sif_label", "sif_score")
    if split:
        old, new = rows.where(F.col("event_ts") < F.lit(split).cast("timestamp")), rows.where(F.col("event_ts") >= F.lit(split).cast("timestamp"))
        out["category_drift"] = monitor.stability(old, new, "category")
        out["score_drift"] = monitor.score_stability(old, new, "sif_score")
        words = lambda df: df.select(words_of.tokens(F.col("narrative")).alias("words"))
        out["vocabulary_drift"] = monitor.unseen_words(words(old), words(new), "words")
    return out


def cluster_panel(rows: DataFrame, k: int = 8, terms: int = 5) -> DataFrame:
    """Groups of reports by their words, with size, precursor share and terms. Fits a model when called."""
    texts = rows.where(F.col("narrative").isNotNull()).select("narrative", "sif")
    stages = [*classify.features(), Normalizer(inputCol="features", outputCol="unit")]
    ready = Pipeline(stages=stages).fit(texts).transform(texts)
    clustered = patterns.clusters(ready, "unit", k).withColumn("words", words_of.tokens(F.col("narrative")))
    return patterns.cluster_summary(clustered, "words", F.col("sif") == 1, terms)
