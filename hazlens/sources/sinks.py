"""Exports, stored models and the audit trail."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazlens.sources.reports import CSV

#: Personal data: left out of exports unless asked for.
PERSONAL = ("reporter",)


def export(df: DataFrame, path: str, fmt: str = "csv", one_file: bool = False, personal: bool = False, mode: str = "overwrite") -> None:
    """Write a summary. ``one_file`` is for results known to be small, such as a dashboard panel."""
    out = df if personal else df.drop(*PERSONAL)
    out = out.coalesce(1) if one_file else out
    writer = out.write.mode(mode).format(fmt)
    (writer.options(**CSV) if fmt == "csv" else writer).save(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def audit(scored: DataFrame, path: str, model_version: str, key: str = "report_id", score: str = "sif_score") -> None:
    """Append who was scored, by what and when."""
    rows = scored.select(F.col(key), F.lit(model_version).alias("model_version"), F.col(score), F.current_timestamp().alias("scored_at"))
    rows.write.mode("append").parquet(path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def audited_changes(trail: DataFrame, threshold: float = 0.5, key: str = "report_id", score: str = "sif_score") -> DataFrame:
    """(key, versions, first_version, last_version, last_score, turned): what was told of each report over time, and whether the class turned.

    A model version that scored a report more than once counts by its last time; versions follow each other by that time and, at
    the same time, by name.
    """
    once = trail.groupBy(key, "model_version").agg(F.max_by(F.struct("scored_at", score), F.struct("scored_at", score)).alias("r")).select(key, "model_version", "r.*")
    at = F.struct("scored_at", "model_version")
    out = once.groupBy(key).agg(F.count("*").alias("versions"), F.min_by(F.struct("model_version", score), at).alias("a"), F.max_by(F.struct("model_version", score), at).alias("z"))
    turned = (F.col(f"a.{score}") >= threshold) != (F.col(f"z.{score}") >= threshold)
    return out.select(key, "versions", F.col("a.model_version").alias("first_version"), F.col("z.model_version").alias("last_version"), F.col(f"z.{score}").alias("last_score"), turned.alias("turned"))
