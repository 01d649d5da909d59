"""Sliding frame windows over observations, and scores per window object."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import length
from trackloom.operators.pairing import fuse_points
from trackloom.operators.scale import dense_position

OBJECT = ["window_id", "sequence", "frame_start", "frame_end", "track_id", "sample_id"]


def window_frames(observations: DataFrame, size: int = 16, stride: int = 8, mode: str = "window") -> DataFrame:
    """(sequence, frame) rows with the windows that contain them.

    Windows cover ``size`` positions of the distinct sorted frames of a sequence,
    start every ``stride`` positions and have no partial tail.  ``mode='sequence'``
    makes one window per sequence.
    """
    if mode not in ("window", "sequence"):
        raise ValueError("mode must be 'window' or 'sequence'")
    if size <= 0 or stride <= 0:
        raise ValueError("size and stride must be positive")
    window_id = F.format_string("%s:%d-%d", "sequence", "frame_start", "frame_end")
    if mode == "sequence":
        frames = observations.select("sequence", "frame_id").distinct()
        bounds = frames.groupBy("sequence").agg(
            F.min("frame_id").alias("frame_start"), F.max("frame_id").alias("frame_end")
        )
        return frames.join(bounds, "sequence").withColumn("window_id", window_id)
    positions = dense_position(observations, ["sequence"], "frame_id")
    p = F.col("position")
    first = F.greatest(F.lit(0), F.ceil((p - size + 1) / stride)).cast("long")
    last = F.floor(p / stride).cast("long")
    started = positions.withColumn(
        "_start", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>")))
    )
    # at most ``size`` frames per group
    return (
        started.groupBy("sequence", "_start")
        .agg(F.sort_array(F.collect_list("frame_id")).alias("_frames"))
        .where(F.size("_frames") == size)
        .select(
            "sequence",
            F.array_min("_frames").alias("frame_start"),
            F.array_max("_frames").alias("frame_end"),
            F.explode("_frames").alias("frame_id"),
        )
        .withColumn("window_id", window_id)
    )


def window_states(
    observations: DataFrame,
    size: int = 16,
    stride: int = 8,
    min_visible: int = 2,
    require_both: bool = False,
    mode: str = "window",
) -> DataFrame:
    """Observations repeated per window, objects kept when visible in enough frames."""
    frames = window_frames(observations, size, stride, mode)
    rgb, th = F.col("rgb_cx").isNotNull(), F.col("thermal_cx").isNotNull()
    joined = observations.join(frames, ["sequence", "frame_id"])
    one = lambda c: F.count(F.when(c, F.lit(1)))
    if mode == "window":
        obj = Window.partitionBy("window_id", "track_id")
        states = joined.withColumns(
            {
                "visible_rgb_frames": one(rgb).over(obj),
                "visible_thermal_frames": one(th).over(obj),
                "visible_any_frames": one(rgb | th).over(obj),
            }
        )
    else:
        counts = joined.groupBy("window_id", "track_id").agg(
            one(rgb).alias("visible_rgb_frames"),
            one(th).alias("visible_thermal_frames"),
            one(rgb | th).alias("visible_any_frames"),
        )
        states = joined.join(counts, ["window_id", "track_id"])
    states = states.where(F.col("visible_any_frames") >= min_visible)
    if require_both:
        states = states.where((F.col("visible_rgb_frames") > 0) & (F.col("visible_thermal_frames") > 0))
    return states


def window_objects(states: DataFrame) -> DataFrame:
    return states.groupBy(*OBJECT).agg(
        F.max("visible_rgb_frames").alias("visible_rgb_frames"),
        F.max("visible_thermal_frames").alias("visible_thermal_frames"),
        F.max("visible_any_frames").alias("visible_any_frames"),
    )


def window_points(observations: DataFrame, **config) -> DataFrame:
    """Fused points of window objects: the input of the group operators."""
    return fuse_points(
        window_states(observations, **config), keep=("window_id", "frame_start", "frame_end")
    )


def linear_prediction(points: DataFrame) -> DataFrame:
    """Largest residual of extrapolating the last two points of a window object.

    Objects with fewer than three points score 0.  A (window, track) group has at
    most window-size rows.
    """
    w = Window.partitionBy("window_id", "track_id").orderBy("frame_id")
    lag = {f"_{c}{n}": F.lag(c, n).over(w) for n in (1, 2) for c in ("cx", "cy", "frame_id")}
    rows = points.withColumns(lag)
    gap_now = F.greatest(F.col("frame_id") - F.col("_frame_id1"), F.lit(1))
    gap_then = F.greatest(F.col("_frame_id1") - F.col("_frame_id2"), F.lit(1))

    def predicted(axis: str):
        rate = (F.col(f"_c{axis}1") - F.col(f"_c{axis}2")) / gap_then
        return F.col(f"_c{axis}1") + rate * gap_now

    residual = length(predicted("x") - F.col("cx"), predicted("y") - F.col("cy"))
    return rows.groupBy(*OBJECT).agg(F.coalesce(F.max(residual), F.lit(0.0)).alias("score"))


def aggregate_to_tracks(window_scores: DataFrame, method: str = "max") -> DataFrame:
    """Window scores reduced to one score per track, with both reductions kept."""
    if method not in ("max", "mean"):
        raise ValueError("method must be 'max' or 'mean'")
    table = window_scores.groupBy("sample_id", "sequence", "track_id").agg(
        F.max("score").alias("window_max"),
        F.avg("score").alias("window_mean"),
        F.count(F.lit(1)).alias("num_windows"),
    )
    return table.withColumn("score", F.col("window_max" if method == "max" else "window_mean"))
