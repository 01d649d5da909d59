"""Per-frame evidence of a track and its gaps-and-islands event segments."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import clamp
from trackloom.operators.motion import LOW_CONFIDENCE, TRACK, track_steps
from trackloom.operators.scale import one_chunk, percentiles, running, with_previous

# Component weights and segment rule of the simple track detector.
WEIGHTS = {
    "speed_spike": 0.35,
    "turn_irregularity": 0.25,
    "low_confidence_ratio": 0.20,
    "modal_offset_median": 0.20,
}
EPSILON = 1e-6
EVENT_THRESHOLD = 0.25
EVENT_MAX_GAP = 2
EVENT_MIN_LENGTH = 1


def frame_evidence(points: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Score and dominant reason of every frame of a track.

    Speed spikes are steps above the track's median, relative to its largest
    spike; offsets are relative to the largest offset.  The reason is the largest
    component, the later name on ties.
    """
    rows = steps if steps is not None else track_steps(points)
    medians = percentiles(rows, TRACK, {"_step50": ("step", 0.5)})
    peaks = rows.groupBy(*TRACK).agg(
        F.max("step").alias("_stepmax"), F.max("modal_offset").alias("_offmax")
    )
    stats = medians.join(peaks, TRACK)
    top_spike = F.greatest(F.lit(0.0), F.coalesce(F.col("_stepmax") - F.col("_step50"), F.lit(0.0)))
    spike = F.greatest(F.lit(0.0), F.coalesce(F.col("step") - F.col("_step50"), F.lit(0.0)))
    parts = {
        "speed_spike": F.when(top_spike > EPSILON, spike / top_spike).otherwise(F.lit(0.0)),
        "turn_irregularity": F.coalesce(F.col("heading_turn") / math.pi, F.lit(0.0)),
        "low_confidence_ratio": clamp((LOW_CONFIDENCE - F.col("confidence")) / LOW_CONFIDENCE),
        "modal_offset_median": F.when(
            F.col("_offmax") > EPSILON, F.col("modal_offset") / F.col("_offmax")
        ).otherwise(F.lit(0.0)),
    }
    scored = rows.join(stats, TRACK).select(*TRACK, "frame_id", *[c.alias(n) for n, c in parts.items()])
    total = sum((F.col(n) * w for n, w in WEIGHTS.items()), F.lit(0.0))
    strongest = F.array_max(
        F.array(*[F.struct(F.col(n).alias("value"), F.lit(n).alias("name")) for n in parts])
    )
    return scored.withColumns({"score": F.round(total, 6), "dominant_reason": strongest["name"]})


def event_segments(
    frame_scores: DataFrame,
    keys: Sequence[str] = tuple(TRACK),
    components: Sequence[str] = (),
    threshold: float = EVENT_THRESHOLD,
    max_gap: int = EVENT_MAX_GAP,
    min_length: int = EVENT_MIN_LENGTH,
) -> DataFrame:
    """Runs of frames scoring above the threshold.

    A frame at or below the threshold closes a run, and so does a jump of more
    than ``max_gap`` frames.  A run reports its peak, the reason of the first frame
    that reaches it, and the largest value of each component.  Pass a
    materialised table.
    """
    keys = list(keys)
    max_gap = max(int(max_gap), 1)
    usable = frame_scores.where(
        F.col("frame_id").isNotNull() & ~F.isnan(F.coalesce(F.col("score"), F.lit(0.0)))
    ).withColumn("score", F.coalesce(F.col("score"), F.lit(0.0)))
    single = one_chunk(frame_scores, "frame_id")
    lagged = with_previous(usable, keys, "frame_id", ["score"], depth=1, single=single)
    above = F.col("score") > threshold
    opens = above & (
        F.col("prev1_frame_id").isNull()
        | (F.col("prev1_score") <= threshold)
        | (F.col("frame_id") > F.col("prev1_frame_id") + max_gap)
    )
    marked = lagged.withColumn("_open", F.when(opens, F.col("frame_id")))
    labelled = running(marked, keys, "frame_id", {"_segment": ("last", "_open")}, single=single).where(above)
    earliest_peak = F.struct(F.col("score"), -F.col("frame_id"))
    return (
        labelled.groupBy(*keys, "_segment")
        .agg(
            F.min("frame_id").alias("frame_start"),
            F.max("frame_id").alias("frame_end"),
            F.round(F.max("score"), 6).alias("score"),
            F.coalesce(F.max_by("dominant_reason", earliest_peak), F.lit("event")).alias("dominant_reason"),
            F.count(F.lit(1)).alias("num_frames"),
            *[F.max(c).alias(c) for c in components],
        )
        .where(F.col("num_frames") >= max(int(min_length), 1))
        .drop("_segment")
    )
