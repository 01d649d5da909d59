"""Coverage, cross-modal quality and track filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import box_iou, length
from trackloom.operators.motion import TRACK, temporal_linkage

BOX = ("x", "y", "w", "h")


def _count(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def _presence() -> tuple[Column, Column]:
    return F.col("rgb_cx").isNotNull(), F.col("thermal_cx").isNotNull()


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def coverage(observations: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Points seen by both, one or no sensor, in total or per ``by`` columns."""
    rgb, th = _presence()
    grouped = observations.groupBy(*(by or []))
    counts = grouped.agg(
        F.count(F.lit(1)).alias("total_points"),
        _count(rgb).alias("rgb_points"),
        _count(th).alias("thermal_points"),
        _count(rgb & th).alias("paired_points"),
        _count(rgb & ~th).alias("rgb_only_points"),
        _count(~rgb & th).alias("thermal_only_points"),
        _count(~rgb & ~th).alias("missing_both_points"),
        _count(rgb | th).alias("fused_points"),
    )
    total = F.col("total_points")
    return counts.withColumns(
        {
            "paired_ratio": _ratio(F.col("paired_points"), total),
            "fused_ratio": _ratio(F.col("fused_points"), total),
        }
    )


def conversion_summary(observations: DataFrame) -> DataFrame:
    """Rows, sequences, tracks and modality coverage of one converted table.

    Tracks are counted through a distinct that combines before the shuffle.
    """
    tracks = observations.groupBy("sequence", "track_id").agg(F.count(F.lit(1)).alias("rows"))
    per_sequence = tracks.groupBy("sequence").agg(
        F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("tracks")
    )
    sizes = per_sequence.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("num_rows"),
        F.count(F.lit(1)).alias("num_sequences"),
        F.coalesce(F.sum("tracks"), F.lit(0)).alias("num_tracks"),
    )
    cover = coverage(observations).select("paired_points", "rgb_only_points", "thermal_only_points",
                                          "missing_both_points", "paired_ratio")
    one = F.lit(1).alias("_one")
    return (
        sizes.select("*", one)
        .join(F.broadcast(cover.select("*", one)), "_one")
        .drop("_one")
    )


def category_counts(observations: DataFrame) -> DataFrame:
    return observations.groupBy("category_name").agg(F.count(F.lit(1)).alias("num_rows"))


def with_boxes(observations: DataFrame) -> DataFrame:
    """x, y, w, h per sensor from its centre and the shared box size."""
    out = {}
    for m in ("rgb", "thermal"):
        seen = F.col(f"{m}_cx").isNotNull()
        out[f"{m}_x"] = F.col(f"{m}_cx") - F.col("w") / 2
        out[f"{m}_y"] = F.col(f"{m}_cy") - F.col("h") / 2
        out[f"{m}_w"] = F.when(seen, F.col("w"))
        out[f"{m}_h"] = F.when(seen, F.col("h"))
    return observations.withColumns(out)


def cross_modal_quality(observations: DataFrame) -> DataFrame:
    """Coverage, offset and IoU of the two sensors, per sequence and in total.

    The total is the rollup level with sequence ``*``.  Values are rounded to six
    digits; averages over nothing are 0.  Status is ``ok`` when no observation
    lacks a sensor, else ``partial``.
    """
    rgb, th = _presence()
    both = rgb & th
    boxes = {m: {c: F.col(f"{m}_{c}") for c in BOX} for m in ("rgb", "thermal")}
    offset = length(F.col("thermal_cx") - F.col("rgb_cx"), F.col("thermal_cy") - F.col("rgb_cy"))
    rows = with_boxes(observations).where(rgb | th).select(
        "sequence",
        rgb.alias("_rgb"),
        th.alias("_th"),
        F.when(both, offset).alias("_offset"),
        F.when(both, box_iou(boxes["rgb"], boxes["thermal"])).alias("_iou"),
    )
    table = rows.rollup("sequence").agg(
        F.count(F.lit(1)).alias("num_keys"),
        _count(F.col("_rgb") & F.col("_th")).alias("num_paired"),
        _count(~F.col("_rgb")).alias("num_missing_rgb"),
        _count(~F.col("_th")).alias("num_missing_thermal"),
        F.avg("_offset").alias("_omean"),
        F.max("_offset").alias("_omax"),
        F.avg("_iou").alias("_imean"),
    )

    def six(value: Column) -> Column:
        return F.round(F.coalesce(value, F.lit(0.0)), 6)

    keys = F.col("num_keys")
    return table.select(
        F.coalesce("sequence", F.lit("*")).alias("sequence"),
        "num_keys",
        "num_paired",
        "num_missing_rgb",
        "num_missing_thermal",
        six(_ratio(keys - F.col("num_missing_rgb"), keys)).alias("rgb_coverage"),
        six(_ratio(keys - F.col("num_missing_thermal"), keys)).alias("thermal_coverage"),
        six(_ratio(F.col("num_paired"), keys)).alias("paired_coverage"),
        six(F.col("_omean")).alias("modal_offset_mean"),
        six(F.col("_omax")).alias("modal_offset_max"),
        six(F.col("_imean")).alias("modal_iou_mean"),
        F.when(F.col("num_missing_rgb") + F.col("num_missing_thermal") > 0, F.lit("partial"))
        .otherwise(F.lit("ok"))
        .alias("status"),
    )


def track_quality(
    observations: DataFrame,
    min_points: int = 1,
    min_visible: int = 1,
    max_frame_gap: int | None = None,
    min_fused_ratio: float = 0.0,
) -> DataFrame:
    """Keep flag and drop reasons of each track by four rules."""
    rgb, th = _presence()
    counts = observations.groupBy(*TRACK).agg(
        _count(rgb | th).alias("visible_any_frames"), _count(rgb | th).alias("fused_points")
    )
    table = temporal_linkage(observations).join(counts, TRACK)
    ratio = _ratio(F.col("fused_points"), F.col("num_points"))
    rules = [
        F.when(F.col("num_points") < min_points, F.lit("short_track")),
        F.when(F.col("visible_any_frames") < min_visible, F.lit("low_visible_frames")),
    ]
    if max_frame_gap is not None:
        rules.append(F.when(F.col("max_frame_gap") > max_frame_gap, F.lit("large_frame_gap")))
    rules.append(F.when(ratio < min_fused_ratio, F.lit("low_fused_ratio")))
    reasons = F.array_compact(F.array(*rules))
    return table.select(
        *TRACK,
        "num_points",
        "visible_any_frames",
        ratio.alias("fused_ratio"),
        "max_frame_gap",
        "missing_frames",
        reasons.alias("drop_reasons"),
        (F.size(reasons) == 0).alias("keep"),
    )


def drop_reason_counts(quality: DataFrame) -> DataFrame:
    return (
        quality.select(F.explode("drop_reasons").alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("num_tracks"))
    )


def keep_tracks(points: DataFrame, quality: DataFrame) -> DataFrame:
    """Rows of tracks (or window states) whose track is kept."""
    return points.join(quality.where("keep").select("sample_id"), "sample_id", "left_semi")
