"""The matrix run: dispatch by name, committed parts, metrics per level, seed and method."""

import uuid

import pytest

from trackloom.operators import detectors, evaluate, matrix, motion, protocol, windows
from trackloom.plans.detector_queries import points
from trackloom.session import materialize, shared_dir
from trackloom.sources.tables import observations


@pytest.fixture(scope="module")
def tables(spark, sf):
    return {"track": points(spark, sf), "window": materialize(windows.window_points(observations(spark, sf)))}


def test_unknown_and_repeated_names():
    with pytest.raises(KeyError, match="kinematic_profile"):
        matrix.by_name("no such detector")
    with pytest.raises(KeyError):
        matrix.by_name("simple", "window")
    with pytest.raises(ValueError):
        matrix.detector("simple")(lambda train, rows: rows)


def test_parts_are_computed_once_and_equal_direct_calls(spark, tables):
    """Two levels, two seeds; what is there already stays, what is missing is added."""
    folder = f"{shared_dir(spark)}/matrix-{uuid.uuid4().hex}"
    methods = {
        "track": {"profile": ("kinematic_profile", {}), "turns": ("feature", {"column": "mean_turn_angle"})},
        "window": {"group": ("lightweight_group", {})},
    }
    first = matrix.run({"track": tables["track"]}, {"track": {"turns": methods["track"]["turns"]}}, [41], folder)
    assert first == [("track", 41, "turns")]
    second = matrix.run(tables, methods, [41, 42], folder)
    assert ("track", 41, "turns") not in second and len(second) == 5
    assert matrix.run(tables, methods, [41, 42], folder) == []

    got = {(r.level, r.seed, r.method): r for r in matrix.metrics(spark, folder, k=10).collect()}
    assert set(got) == {("track", s, m) for s in (41, 42) for m in ("profile", "turns")} | {("window", s, "group") for s in (41, 42)}

    rows, positives = protocol.inject_track_anomalies(tables["track"], 0.1, 42)
    labels = protocol.complete_labels(protocol.track_keys(rows), positives, 42)
    features = materialize(motion.kinematic_features(rows))
    scores = detectors.kinematic_profile_scores(features, features).selectExpr("sample_id", "'profile' AS method", "round(score, 9) AS score")
    want = evaluate.curve_metrics(evaluate.align(scores, labels, ["profile"])).first()
    row = got["track", 42, "profile"]
    assert (row.auroc, row.auprc, row.f1) == pytest.approx((want.auroc, want.auprc, want.f1))

    rows, positives = protocol.inject_group_anomalies(tables["window"], 0.1, 41)
    assert got["window", 41, "group"].num_total == rows.select("window_id", "sample_id").distinct().count()
    assert got["window", 41, "group"].num_positive == positives.select("window_id", "sample_id").distinct().count()


def test_a_part_that_was_never_committed_is_done_again(spark, tables):
    folder = f"{shared_dir(spark)}/matrix-{uuid.uuid4().hex}"
    named = {"track": {"turns": ("feature", {"column": "mean_turn_angle"})}}
    import os

    os.makedirs(f"{folder.removeprefix('file://')}/scores/level=track/seed=7/method=turns/_temporary/0")
    assert matrix.run({"track": tables["track"]}, named, [7], folder) == [("track", 7, "turns")]
    assert matrix.metrics(spark, folder).count() == 1


@pytest.mark.parametrize("name", ["simple", "nearest_profile", "lof", "isolation_forest"])
def test_every_detector_scores_every_track(tables, name):
    got = matrix.by_name(name).score(tables["track"], tables["track"])
    assert got.columns == ["key", "score"] and dict(got.dtypes)["score"] == "double"
    assert got.select("key").distinct().count() == got.count() == tables["track"].select("sample_id").distinct().count()
