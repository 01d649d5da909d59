"""Registered queries against DuckDB on the smallest tables, and registry rules."""

import pytest

import __spark_entry__ as entry
from compare import compare, duck

CHECKED = [
    "pair_modalities",
    "quality_by_sequence",
    "track_features",
    "simple_track_scores",
    "event_segments",
    "window_prediction",
    "lightweight_group_scores",
    "fused_scores",
    "frame_signatures",
    "lof_scores",
    "ngram_scores",
    "recall_at_n",
    "inject_group_anomalies",
    "evaluate_matrix",
    "case_rows",
    "route_sequences",
    "trimmed_chamfer_distance",
    "jsonl_windows",
    "stream_track_changes",
    "frame_mass",
    "playback_stats",
    "convergence",
    "infer_level",
    "padded_centers",
    "point_lists",
    "bounded_training_sample",
    "stream_window_coverage",
    "compatibility_weights",
    "compatible_pose",
    "track_groups",
    "group_events",
    "history_change",
    "stream_track_states",
    "stream_frame_mass",
    "hardest_negatives_second_turn",
    "seed_summary",
    "holdout_metrics",
    "trimmed_icp",
    "isolation_forest",
    "isolation_forest_windows",
    "rank_ensemble",
    "complementary_scores",
    "auroc",
    "best_f1",
]


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf, con, name):
    assert compare(entry.queries()[name](spark, sf), con, entry.oracle_sql()[name]) is None


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["sample_id", "score"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream_equals_batch(spark, sf):
    from trackloom.streaming import live

    batch = live.window_coverage(live.stream_points(spark.read.parquet(f"{sf}/events.parquet")), late=None)
    streamed = live.finished_coverage(spark, sf)
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect())) != []
