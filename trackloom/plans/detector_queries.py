"""Queries on windows, segments, detector scores and rank normalisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import detectors, motion, protocol, ranks, segments, windows
from trackloom.operators.pairing import fuse_points
from trackloom.plans import oracle as sql
from trackloom.plans.registry import query, select
from trackloom.session import materialize
from trackloom.sources.tables import observations


def points(spark, sf):
    """The stored table of fused points that the track operators read."""
    return materialize(fuse_points(observations(spark, sf)))


def steps(spark, sf):
    return materialize(motion.track_steps(points(spark, sf)))


_OBJ = "window_id, sequence, track_id, sample_id, frame_start, frame_end"


@query(
    "frame_windows",
    select(
        "window_id, sample_id, frame_id, visible_any_frames, visible_rgb_frames, visible_thermal_frames",
        "wstates0 JOIN (SELECT window_id, track_id, visible_any_frames, visible_rgb_frames, visible_thermal_frames FROM wobj) w USING (window_id, track_id)",
        sql.WINDOWED,
    ),
)
def frame_windows(spark, sf):
    return windows.window_states(observations(spark, sf)).select(
        "window_id", "sample_id", "frame_id", "visible_any_frames", "visible_rgb_frames", "visible_thermal_frames"
    )


@query(
    "window_objects_both_sensors",
    select(
        f"{_OBJ}, visible_any_frames, visible_rgb_frames, visible_thermal_frames",
        "wobj",
        sql.WINDOWED,
        "WHERE visible_rgb_frames > 0 AND visible_thermal_frames > 0",
    ),
)
def window_objects(spark, sf):
    states = windows.window_states(observations(spark, sf), require_both=True)
    return windows.window_objects(states)


@query(
    "sequence_windows",
    select(
        """sequence || ':' || min(frame_id) || '-' || max(frame_id) AS window_id, sequence,
        min(frame_id) AS frame_start, max(frame_id) AS frame_end, count(DISTINCT frame_id) AS num_frames""",
        "obs",
        sql.BASE,
        "GROUP BY sequence",
    ),
)
def sequence_windows(spark, sf):
    frames = windows.window_frames(observations(spark, sf), mode="sequence")
    return frames.groupBy("window_id", "sequence", "frame_start", "frame_end").agg(
        F.count(F.lit(1)).alias("num_frames")
    )


@query("window_prediction", select(f"{_OBJ}, ~score", "pred", [*sql.WINDOWED, sql.PREDICTION]))
def window_prediction(spark, sf):
    return windows.linear_prediction(windows.window_points(observations(spark, sf)))


_TO_TRACK = """sample_id, sequence, track_id, ~max(score) AS window_max, ~avg(score) AS window_mean, count(*) AS num_windows, ~{f}(score) AS score"""


@query(
    "window_to_track",
    select(
        _TO_TRACK.format(f="max"), "pred", [*sql.WINDOWED, sql.PREDICTION], "GROUP BY sample_id, sequence, track_id"
    ),
)
def window_to_track(spark, sf):
    return windows.aggregate_to_tracks(window_prediction(spark, sf))


@query(
    "window_to_track_mean",
    select(
        _TO_TRACK.format(f="avg"), "pred", [*sql.WINDOWED, sql.PREDICTION], "GROUP BY sample_id, sequence, track_id"
    ),
)
def window_to_track_mean(spark, sf):
    return windows.aggregate_to_tracks(window_prediction(spark, sf), "mean")


@query(
    "simple_track_scores",
    select(
        """sample_id, sequence, track_id, ~n_speed_spike, ~n_turn_irregularity, ~n_low_confidence_ratio, ~n_modal_offset_median,
        ~score, ~event_score""",
        "ind JOIN (SELECT sample_id, max(score) AS event_score FROM evidence GROUP BY sample_id) e USING (sample_id)",
        [*sql.SIMPLE, sql.EVIDENCE],
    ),
)
def simple_track_scores(spark, sf):
    return detectors.simple_track_scores(points(spark, sf))


@query(
    "frame_evidence",
    select(
        "sample_id, frame_id, ~speed_spike, ~turn_irregularity, ~low_confidence_ratio, ~modal_offset_median, ~score, dominant_reason",
        "evidence",
        [*sql.MOTION, sql.EVIDENCE],
    ),
)
def frame_evidence(spark, sf):
    rows = steps(spark, sf)
    return segments.frame_evidence(rows, rows).drop("sequence", "track_id")


@query(
    "event_segments",
    select(
        """sample_id, min(frame_id) AS frame_start, max(frame_id) AS frame_end, ~max(score) AS score,
        arg_min(dominant_reason, (-score, frame_id)) AS dominant_reason, count(*) AS num_frames, ~max(speed_spike) AS speed_spike""",
        "seg",
        [*sql.MOTION, sql.EVIDENCE, sql.SEGMENTS],
        "GROUP BY sample_id, island",
    ),
)
def event_segments(spark, sf):
    rows = steps(spark, sf)
    evidence = materialize(segments.frame_evidence(rows, rows))
    found = segments.event_segments(evidence, components=["speed_spike"])
    return found.drop("sequence", "track_id")


_LIGHT_IDS = "window_id, track_id, sample_id"


@query(
    "lightweight_group_scores",
    select(
        f"{_LIGHT_IDS}, ~n_motion_inconsistency, ~n_group_leaving, ~n_modal_inconsistency, ~0.45 * n_motion_inconsistency + 0.35 * n_group_leaving + 0.20 * n_modal_inconsistency AS score",
        "rlight",
        [
            *sql.WINDOWED,
            sql.LIGHT,
            sql.robust(
                "rlight",
                "light",
                _LIGHT_IDS,
                ["motion_inconsistency", "group_leaving", "modal_inconsistency"],
                "window_id",
                "track_id",
            ),
        ],
    ),
)
def lightweight_group_scores(spark, sf):
    scores = detectors.lightweight_group_scores(windows.window_points(observations(spark, sf)))
    return scores.drop("sequence", "frame_start", "frame_end")


@query(
    "fused_scores",
    select(
        "sample_id, ~score, ~s_ind, ~s_grp, ~s_event, used_sources",
        "fusedscores",
        [*sql.SIMPLE, sql.EVIDENCE, sql.WINDOWS, sql.PREDICTION, *sql.FUSED_SCORES],
    ),
)
def fused_scores(spark, sf):
    """Flagship: track scores and window scores fused into one ranking."""
    obs = observations(spark, sf)
    individual = detectors.simple_track_scores(materialize(fuse_points(obs)))
    group = windows.aggregate_to_tracks(windows.linear_prediction(windows.window_points(obs)))
    return detectors.fuse_scores(individual, group).orderBy(F.col("score").desc(), "sample_id")


def train_score(spark, sf, table):
    """Materialised feature table and its train / val parts."""
    base = materialize(table)
    split = protocol.split_sequences(base.select("sequence"))
    rows = materialize(protocol.split_rows(base, split))
    return rows.where("split = 'train'"), rows.where("split = 'val'")


@query("sequence_split", select("sequence, split", "split", [*sql.BASE, sql.SPLIT]))
def sequence_split(spark, sf):
    return protocol.split_sequences(observations(spark, sf))


@query(
    "kinematic_profile_scores",
    select(
        "sample_id, ~speed, ~acceleration, ~jerk, ~turn, ~smoothness, ~(speed + acceleration + jerk + turn + smoothness) / 5 AS score",
        "kscore",
        [*sql.MOTION, sql.KINEMATIC, sql.SPLIT, *sql.kinematic_scores()],
    ),
)
def kinematic_profile(spark, sf):
    train, score = train_score(spark, sf, motion.kinematic_features(points(spark, sf)))
    return detectors.kinematic_profile_scores(train, score).drop("sequence", "track_id")


@query(
    "behaviour_components",
    select(
        "sample_id, ~route_score, ~speed_score, ~speed_slowdown_score, ~jump_score, ~shape_score, ~modal_offset_score, ~greatest(route_score, shape_score) AS route_shape_score",
        "bscore",
        [*sql.MOTION, sql.HANDCRAFTED, sql.SPLIT, *sql.behaviour_scores()],
    ),
)
def behaviour_components(spark, sf):
    train, score = train_score(spark, sf, motion.handcrafted_features(points(spark, sf)))
    return detectors.behaviour_components(train, score).drop("sequence", "track_id")


_RANKED = ["mean_speed", "max_turn_angle", "bbox_area_std"]


@query(
    "rank01",
    select(
        "sample_id, ~r_mean_speed, ~1 - r_max_turn_angle AS r_max_turn_angle, ~r_bbox_area_std",
        "ranked",
        [*sql.MOTION, sql.HANDCRAFTED, sql.rank01("ranked", "hand", "sample_id", _RANKED, "sample_id")],
    ),
)
def rank01(spark, sf):
    features = motion.handcrafted_features(points(spark, sf))
    return ranks.rank01(features, ["sample_id"], _RANKED, ["sample_id"], inverse=["max_turn_angle"])


@query(
    "average_rank",
    select(
        """sample_id, component, ~(rank() OVER (PARTITION BY component ORDER BY value)
            + (count(*) OVER (PARTITION BY component, value) - 1) / 2 - 1) / (count(*) OVER (PARTITION BY component) - 1) AS avg_rank01,
           ~1 / (rank() OVER (PARTITION BY component ORDER BY value DESC) + (count(*) OVER (PARTITION BY component, value) - 1) / 2) AS inverse_rank""",
        """(SELECT sample_id, 'num_points' AS component, num_points::DOUBLE AS value FROM hand
            UNION ALL SELECT sample_id, 'max_speed', round(max_speed, 6) FROM hand) l""",
        [*sql.MOTION, sql.HANDCRAFTED],
    ),
)
def average_rank(spark, sf):
    features = motion.handcrafted_features(points(spark, sf)).withColumn(
        "max_speed", F.round("max_speed", 6)
    )
    long = ranks.melt(features, ["sample_id"], ["num_points", "max_speed"])
    ranked = ranks.average_ranks(long, ["component"])
    return ranked.select(
        "sample_id",
        "component",
        ((F.col("avg_rank") - 1) / (F.col("rank_count") - 1)).alias("avg_rank01"),
        (1.0 / (F.col("rank_count") + 1 - F.col("avg_rank"))).alias("inverse_rank"),
    )


@query(
    "stratified_rank",
    select(
        "sample_id, ~global_rank, ~local_rank, ~least(1, greatest(0, 0.7 * global_rank + 0.3 * local_rank)) AS score",
        "strat",
        [*sql.MOTION, sql.HANDCRAFTED, *sql.stratified("max_speed", ["num_points", "path_length"])],
    ),
)
def stratified_rank(spark, sf):
    features = motion.handcrafted_features(points(spark, sf)).withColumn(
        "num_points", F.col("num_points").cast("double")
    )
    return ranks.stratified_rank(
        features, ["sample_id"], "max_speed", ["num_points", "path_length"], ["sample_id"]
    )
