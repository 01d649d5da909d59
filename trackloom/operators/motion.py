"""Step, speed and turn columns of tracks, and the per-track feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import distance, heading_change, length, step_angle
from trackloom.operators.scale import one_chunk, percentiles, with_previous

TRACK = ["sample_id", "sequence", "track_id"]
STOP_SPEED = 1e-6
LOW_CONFIDENCE = 0.65

HANDCRAFTED = [
    "duration_frames",
    "num_points",
    "path_length",
    "displacement",
    "mean_speed",
    "max_speed",
    "std_speed",
    "mean_acceleration",
    "max_acceleration",
    "mean_turn_angle",
    "max_turn_angle",
    "bbox_area_mean",
    "bbox_area_std",
    "modal_offset_mean",
    "modal_offset_max",
]
KINEMATIC = [
    "duration_frames",
    "num_points",
    "path_length",
    "displacement",
    "mean_speed",
    "max_speed",
    "speed_variance",
    "stop_ratio",
    "mean_acceleration",
    "max_acceleration",
    "mean_jerk",
    "max_jerk",
    "mean_turn_angle",
    "max_turn_angle",
    "path_efficiency",
    "smoothness_residual",
]


def _step(n: int) -> tuple[Column, Column, Column]:
    """dx, dy and clamped frame gap of the n-th step back (0 = into this row)."""
    now = "" if n == 0 else f"prev{n}_"
    then = f"prev{n + 1}_"
    gap = F.greatest(F.col(f"{now}frame_id") - F.col(f"{then}frame_id"), F.lit(1))
    return F.col(f"{now}cx") - F.col(f"{then}cx"), F.col(f"{now}cy") - F.col(f"{then}cy"), gap


def step_columns() -> dict[str, Column]:
    """Motion columns from prev1..prev3 centres; null where history is too short."""
    (dx0, dy0, gap0), (dx1, dy1, gap1), (dx2, dy2, gap2) = _step(0), _step(1), _step(2)
    speed0, speed1, speed2 = (
        length(dx0, dy0) / gap0,
        length(dx1, dy1) / gap1,
        length(dx2, dy2) / gap2,
    )
    return {
        "dx": dx0,
        "dy": dy0,
        "step": length(dx0, dy0),
        "gap": F.col("frame_id") - F.col("prev1_frame_id"),
        "speed": speed0,
        "acceleration": F.abs(speed0 - speed1),
        "jerk": F.abs(F.abs(speed0 - speed1) - F.abs(speed1 - speed2)),
        "turn": step_angle(dx1, dy1, dx0, dy0),
        "heading_turn": heading_change(dx1, dy1, dx0, dy0),
    }


def track_steps(points: DataFrame) -> DataFrame:
    """Steps of whole tracks (long tracks are cut into chunks with a halo)."""
    lagged = with_previous(points, TRACK, "frame_id", ["cx", "cy"], depth=3)
    return lagged.select(*points.columns, *[c.alias(n) for n, c in step_columns().items()])


def window_steps(states: DataFrame) -> DataFrame:
    """Steps inside a frame window: at most window-size rows per (window, track)."""
    w = Window.partitionBy("window_id", "track_id").orderBy("frame_id")
    lags = {
        f"prev{n}_{c}": F.lag(c, n).over(w) for n in (1, 2, 3) for c in ("frame_id", "cx", "cy")
    }
    lagged = states.withColumns(lags)
    return lagged.select(*states.columns, *[c.alias(n) for n, c in step_columns().items()], *list(lags)[:6])


def modality_velocity(observations: DataFrame, fps: float | None = None) -> DataFrame:
    """Per-sensor velocity against the previous frame where that sensor saw the track."""
    sides = [
        F.struct(
            F.lit(m).alias("modality"), F.col(f"{m}_cx").alias("cx"), F.col(f"{m}_cy").alias("cy")
        )
        for m in ("rgb", "thermal")
    ]
    long = (
        observations.select(*TRACK, "frame_id", F.explode(F.array(*sides)).alias("m"))
        .select(*TRACK, "frame_id", "m.*")
        .where(F.col("cx").isNotNull() & F.col("cy").isNotNull())
    )
    single = one_chunk(observations, "frame_id")
    lagged = with_previous(long, [*TRACK, "modality"], "frame_id", ["cx", "cy"], depth=1, single=single)
    gap = F.greatest(F.col("frame_id") - F.col("prev1_frame_id"), F.lit(1))
    vx = (F.col("cx") - F.col("prev1_cx")) / gap
    vy = (F.col("cy") - F.col("prev1_cy")) / gap
    out = [
        *[F.col(c) for c in (*TRACK, "modality", "frame_id")],
        vx.alias("vx"),
        vy.alias("vy"),
        length(vx, vy).alias("speed"),
    ]
    if fps is not None:
        out.append((length(vx, vy) * fps).alias("speed_per_second"))
    return lagged.select(*out)


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def _shared_aggregates() -> list[Column]:
    first = F.min_by(F.struct("cx", "cy"), F.col("frame_id"))
    last = F.max_by(F.struct("cx", "cy"), F.col("frame_id"))
    return [
        (F.max("frame_id") - F.min("frame_id") + 1).cast("long").alias("duration_frames"),
        F.count(F.lit(1)).alias("num_points"),
        _zero(F.sum("step")).alias("path_length"),
        distance(first["cx"], first["cy"], last["cx"], last["cy"]).alias("displacement"),
        _zero(F.avg("speed")).alias("mean_speed"),
        _zero(F.max("speed")).alias("max_speed"),
        _zero(F.avg("acceleration")).alias("mean_acceleration"),
        _zero(F.max("acceleration")).alias("max_acceleration"),
        _zero(F.avg("turn")).alias("mean_turn_angle"),
        _zero(F.max("turn")).alias("max_turn_angle"),
    ]


def handcrafted_features(points: DataFrame, keys: list[str] | None = None, steps: DataFrame | None = None) -> DataFrame:
    """Fifteen features per track; empty lists count as 0, deviations are population."""
    keys = keys or TRACK
    rgb = distance(F.col("cx"), F.col("cy"), F.col("rgb_cx"), F.col("rgb_cy"))
    thermal = distance(F.col("cx"), F.col("cy"), F.col("thermal_cx"), F.col("thermal_cy"))
    between = distance(F.col("rgb_cx"), F.col("rgb_cy"), F.col("thermal_cx"), F.col("thermal_cy"))
    offsets = F.array_compact(F.array(rgb, thermal, between))
    area = F.col("w") * F.col("h")
    rows = (steps if steps is not None else track_steps(points)).withColumns(
        {
            "_area": area,
            "_osum": F.aggregate(offsets, F.lit(0.0), lambda a, v: a + v),
            "_on": F.size(offsets),
            "_omax": F.array_max(offsets),
        }
    )
    table = rows.groupBy(*keys).agg(
        *_shared_aggregates(),
        _zero(F.stddev_pop("speed")).alias("std_speed"),
        _zero(F.avg("_area")).alias("bbox_area_mean"),
        _zero(F.stddev_pop("_area")).alias("bbox_area_std"),
        _zero(F.sum("_osum") / F.sum("_on")).alias("modal_offset_mean"),
        _zero(F.max("_omax")).alias("modal_offset_max"),
    )
    return table.select(*keys, *HANDCRAFTED)


def kinematic_features(points: DataFrame) -> DataFrame:
    """Sixteen kinematic features per track; a path of length 0 is fully efficient."""
    stopped = F.avg(F.when(F.col("speed").isNotNull(), (F.col("speed") <= STOP_SPEED).cast("double")))
    table = (
        track_steps(points)
        .groupBy(*TRACK)
        .agg(
            *_shared_aggregates(),
            _zero(F.var_pop("speed")).alias("speed_variance"),
            _zero(stopped).alias("stop_ratio"),
            _zero(F.avg("jerk")).alias("mean_jerk"),
            _zero(F.max("jerk")).alias("max_jerk"),
        )
    )
    ratio = F.when(F.col("path_length") > 0, F.col("displacement") / F.col("path_length")).otherwise(
        F.lit(1.0)
    )
    efficiency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))
    return table.withColumn("path_efficiency", efficiency).withColumn(
        "smoothness_residual", 1.0 - F.col("path_efficiency")
    ).select(*TRACK, *KINEMATIC)


def simple_components(points: DataFrame, steps: DataFrame | None = None) -> DataFrame:
    """Speed spike, turn irregularity, low-confidence share and median sensor offset."""
    rows = steps if steps is not None else (points if "step" in points.columns else track_steps(points))
    stats = percentiles(
        rows,
        TRACK,
        {
            "_s95": ("step", 0.95),
            "_s50": ("step", 0.5),
            "_t95": ("heading_turn", 0.95),
            "_o50": ("modal_offset", 0.5),
        },
    )
    share = points.groupBy(*TRACK).agg(
        F.avg((F.col("confidence") < LOW_CONFIDENCE).cast("double")).alias("low_confidence_ratio")
    )
    return share.join(stats, TRACK).select(
        *TRACK,
        F.greatest(F.lit(0.0), _zero(F.col("_s95") - F.col("_s50"))).alias("speed_spike"),
        _zero(F.col("_t95")).alias("turn_irregularity"),
        "low_confidence_ratio",
        _zero(F.col("_o50")).alias("modal_offset_median"),
    )


def temporal_linkage(points: DataFrame) -> DataFrame:
    """Frame span, frame gaps and missing frames of each track.

    ``gaps`` lists the places where frames are missing (frame before, gap); a track without holes has none.
    """
    lagged = with_previous(points.select(*TRACK, "frame_id"), TRACK, "frame_id", [], depth=1)
    gap = F.col("frame_id") - F.col("prev1_frame_id")
    return (
        lagged.withColumn("_gap", gap)
        .groupBy(*TRACK)
        .agg(
            F.min("frame_id").alias("frame_start"),
            F.max("frame_id").alias("frame_end"),
            F.count(F.lit(1)).alias("num_points"),
            F.coalesce(F.max("_gap"), F.lit(0)).alias("max_frame_gap"),
            F.coalesce(F.avg("_gap"), F.lit(0.0)).alias("mean_frame_gap"),
            F.sort_array(F.collect_list(F.when(F.col("_gap") > 1, F.struct(F.col("prev1_frame_id").alias("frame_id"), F.col("_gap").alias("gap"))))).alias("gaps"),
        )
        .withColumn(
            "missing_frames",
            F.col("frame_end") - F.col("frame_start") + 1 - F.col("num_points"),
        )
    )
