"""Queries against their SQL on the smallest fixtures. The driver does the same at a larger size."""

import os

import duckdb
import pandas as pd
import pytest

from hazlens.plans import catalogue, explained, served  # noqa: F401  (registers its queries)

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# the others are held against SQL by the driver; these cover each family
CHOSEN = ["canonical_reports", "text_stats", "tfidf_top_terms", "sentence_count", "exact_dedup", "weak_label_vote", "rule_tags", "rule_evidence", "highlight", "multilabel_prf1", "threshold_sweep", "daily_trend_filled", "drilldown_cube", "density_ranking", "repeat_within_7d", "psi_drift", "perf_by_period", "ranking_functions", "analytic_functions", "distribution_statistics", "latest_by_user", "set_operations", "third_page", "props_json", "map_functions", "string_functions", "array_functions", "asof_join", "chi_square_drift", "auc_of_length", "stream_sliding", "stream_session", "stream_stream_join", "token_bayes_prf1", "score_drift", "phrase_evidence", "phrase_table_hits", "token_bayes_spans", "denied_evidence", "calibration_map", "calibrated_scores", "label_model_accuracies", "label_model_scores", "stream_repeats_within", "near_duplicate_clusters", "chains_within_days", "rule_interactions", "quantile_drift", "sequence_patterns", "fpgrowth_rules", "change_points", "rule_taxonomy", "export_round_trip", "stream_ingest", "audit_changes", "cli_scores", "dashboard_panels", "stream_amended_counts", "stream_upsert_latest", "rule_heads_scores", "rule_heads_model_only", "stream_head_scores", "ridge_by_site", "ridge_by_site_scores", "crossed_thresholds", "feature_union", "term_clusters", "term_cluster_summary"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the fixture tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cells(df: pd.DataFrame) -> list:
    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "null"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_its_sql(spark, sql, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), sql.execute(catalogue.ORACLE[name]).fetch_df()
    for c in got.columns:
        if pd.api.types.is_datetime64_any_dtype(want[c]):
            got[c] = pd.to_datetime(got[c])
    assert cells(got) == cells(want)


def test_stream_tumbling_equals_the_batch_sql(spark, sql):
    got, want = catalogue.QUERIES["stream_tumbling"](spark, SF).toPandas(), sql.execute(catalogue.ORACLE["tumbling_batch"]).fetch_df()
    assert cells(got.astype({"window_start": "datetime64[us]"})) == cells(want.astype({"window_start": "datetime64[us]"}))


@pytest.mark.parametrize("name, windows", [("stream_sliding", 4), ("stream_session", 1)])
def test_stream_windows_count_every_event(spark, name, windows):
    """An event is in four sliding windows of a day and in one session."""
    events = spark.read.parquet(f"{SF}/events.parquet").count()
    assert catalogue.QUERIES[name](spark, SF).agg({"n": "sum"}).first()[0] == windows * events


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
