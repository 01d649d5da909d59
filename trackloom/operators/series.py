"""Fixed-length and resampled series of tracks and window objects.

Resampling never gathers a track: every segment between two consecutive points
emits the grid positions it covers, which needs only the previous row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import length
from trackloom.operators.motion import TRACK
from trackloom.operators.scale import dense_position, one_chunk, running, with_previous
from trackloom.session import materialize

EPSILON = 1e-8
TRACK_CHANNELS = ["cx", "cy", "vx", "vy", "speed", "confidence", "modal_offset", "area", "num_modalities"]
OBJECT_CHANNELS = [
    "cx",
    "cy",
    "rel_x",
    "rel_y",
    "vx",
    "vy",
    "speed",
    "area",
    "modal_offset",
    "visible",
]


def indexed(points: DataFrame, keys: Sequence[str], order: str = "frame_id") -> DataFrame:
    """``index`` of every row within its key and the key's row count ``n``."""
    keys = list(keys)
    counts = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return points.join(dense_position(points, keys, order, "index"), [*keys, order]).join(counts, keys)


def resample(rows: DataFrame, keys: Sequence[str], channels: Sequence[str], size: int, order: str = "frame_id") -> DataFrame:
    """``size`` equally spaced values per key by linear interpolation over row positions.

    A single row repeats.  Returns keys, ``slot`` (0-based) and the channels.
    """
    keys, channels = list(keys), list(channels)
    placed = materialize(indexed(rows.select(*keys, order, *channels), keys, order))
    lagged = with_previous(placed, keys, order, channels, depth=1)
    i, n = F.col("index"), F.col("n")
    last = F.lit(size - 1)
    low = F.when(i == 0, F.lit(0)).otherwise(F.floor((i - 1) * last / (n - 1)) + 1)
    high = F.when(n == 1, last).when(i == 0, F.lit(0)).otherwise(F.floor(i * last / (n - 1)))
    slots = F.when(high >= low, F.sequence(low.cast("int"), high.cast("int"))).otherwise(F.array().cast("array<int>"))
    spread = lagged.withColumn("slot", F.explode(slots))
    share = F.col("slot") * (n - 1) / last - (i - 1)

    def value(c: str):
        return F.when((i == 0) | (n == 1), F.col(c)).otherwise(
            F.col(f"prev1_{c}") + (F.col(c) - F.col(f"prev1_{c}")) * share
        )

    return spread.select(*keys, "slot", *[value(c).alias(c) for c in channels])


def track_channels(points: DataFrame) -> DataFrame:
    """Nine channels per fused point; motion against the previous point (0 first)."""
    lagged = with_previous(points, TRACK, "frame_id", ["cx", "cy"], depth=1)
    gap = F.greatest(F.col("frame_id") - F.col("prev1_frame_id"), F.lit(1))
    vx = F.coalesce((F.col("cx") - F.col("prev1_cx")) / gap, F.lit(0.0))
    vy = F.coalesce((F.col("cy") - F.col("prev1_cy")) / gap, F.lit(0.0))
    return lagged.select(
        *TRACK,
        "frame_id",
        "cx",
        "cy",
        vx.alias("vx"),
        vy.alias("vy"),
        length(vx, vy).alias("speed"),
        "confidence",
        "modal_offset",
        (F.col("w") * F.col("h")).alias("area"),
        F.col("num_modalities").cast("double").alias("num_modalities"),
    )


def track_series(points: DataFrame, size: int = 32) -> DataFrame:
    return resample(track_channels(points), TRACK, TRACK_CHANNELS, size)


def object_series(points: DataFrame, size: int = 16) -> DataFrame:
    """Ten channels of every window object at ``size`` consecutive frames.

    An unseen object stays where it was last seen; before it is first seen it sits
    at the centroid of the window's first frame.  Frames without objects keep the
    last centroid ((0, 0) before the first).
    """
    objects = points.select("window_id", "sample_id", "track_id", "frame_start").distinct()
    slots = F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot")
    frames = points.select("window_id", "frame_start").distinct().select("window_id", "frame_start", slots)
    centers = points.groupBy("window_id", "frame_id").agg(F.avg("cx").alias("_x"), F.avg("cy").alias("_y"))
    grid = frames.withColumn("frame_id", F.col("frame_start") + F.col("slot"))
    upto = Window.partitionBy("window_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0.0)
    centroids = grid.join(centers, ["window_id", "frame_id"], "left").select(
        "window_id",
        "slot",
        F.coalesce(F.last("_x", ignorenulls=True).over(upto), zero).alias("gx"),
        F.coalesce(F.last("_y", ignorenulls=True).over(upto), zero).alias("gy"),
    )
    start = centroids.where("slot = 0").select("window_id", F.col("gx").alias("_x0"), F.col("gy").alias("_y0"))
    states = points.select(
        "window_id",
        "track_id",
        "frame_id",
        "cx",
        "cy",
        (F.col("w") * F.col("h")).alias("area"),
        F.when(F.col("num_modalities") == 2, F.col("modal_offset")).alias("modal_offset"),
    )
    # size rows per object
    mine = Window.partitionBy("window_id", "track_id").orderBy("slot")
    so_far = mine.rowsBetween(Window.unboundedPreceding, 0)
    rows = (
        objects.select("*", slots)
        .withColumn("frame_id", F.col("frame_start") + F.col("slot"))
        .join(states, ["window_id", "track_id", "frame_id"], "left")
        .join(start, "window_id")
        .join(centroids, ["window_id", "slot"])
        .withColumn("visible", F.col("cx").isNotNull().cast("double"))
        .withColumn("_sx", F.coalesce(F.last("cx", ignorenulls=True).over(so_far), F.col("_x0")))
        .withColumn("_sy", F.coalesce(F.last("cy", ignorenulls=True).over(so_far), F.col("_y0")))
    )
    vx = F.coalesce(F.col("_sx") - F.lag("_sx").over(mine), zero)
    vy = F.coalesce(F.col("_sy") - F.lag("_sy").over(mine), zero)
    moved = rows.withColumn("vx", vx).withColumn("vy", vy)
    return moved.select(
        "window_id",
        "sample_id",
        "track_id",
        "slot",
        F.col("_sx").alias("cx"),
        F.col("_sy").alias("cy"),
        (F.col("_sx") - F.col("gx")).alias("rel_x"),
        (F.col("_sy") - F.col("gy")).alias("rel_y"),
        "vx",
        "vy",
        length("vx", "vy").alias("speed"),
        F.coalesce("area", zero).alias("area"),
        F.coalesce("modal_offset", zero).alias("modal_offset"),
        "visible",
    )


def standardize_series(series: DataFrame, train: DataFrame, channels: Sequence[str], least: float = 1e-6) -> DataFrame:
    """Channels centred and scaled by the training mean and population deviation."""
    from trackloom.operators.ranks import column_profile

    profile = column_profile(train, channels)

    def scaled(c: str):
        std = profile[c]["std"] if profile[c]["std"] >= least else 1.0
        return ((F.col(c) - F.lit(profile[c]["mean"])) / F.lit(std)).alias(c)

    return series.select(*[c for c in series.columns if c not in channels], *[scaled(c) for c in channels])


def top_fraction_mean(errors: DataFrame, keys: Sequence[str], value: str, fraction: float) -> DataFrame:
    """Mean of the largest ceil(fraction * n) values of a fixed-length series."""
    f = max(min(fraction, 1.0), 0.0)
    packed = errors.groupBy(*keys).agg(F.sort_array(F.collect_list(value), asc=False).alias("_v"))
    k = F.greatest(F.ceil(F.size("_v") * F.lit(float(f))), F.lit(1)).cast("int")
    head = F.slice("_v", 1, k)
    return packed.select(*keys, (F.aggregate(head, F.lit(0.0), lambda a, v: a + v) / k).alias("score"))


# --------------------------------------------------------------------------- route, speed, shape
def sensor_points(observations: DataFrame, modalities: Sequence[str] = ("rgb", "thermal"), min_points: int = 3) -> DataFrame:
    """Centres with the sensor as a row; tracks with too few points per sensor drop out."""
    sides = F.array(
        *[
            F.struct(F.lit(m).alias("modality"), F.col(f"{m}_cx" if m != "fused" else "cx").alias("x"), F.col(f"{m}_cy" if m != "fused" else "cy").alias("y"))
            for m in modalities
        ]
    )
    long = (
        observations.select(*TRACK, "frame_id", F.explode(sides).alias("m"))
        .select(*TRACK, "frame_id", "m.*")
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    enough = (
        long.groupBy("sample_id", "modality")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= min_points)
        .select("sample_id", "modality")
    )
    return long.join(enough, ["sample_id", "modality"], "left_semi")


SENSOR_TRACK = [*TRACK, "modality"]


def speed_sequences(sensor: DataFrame) -> DataFrame:
    """Per-frame speed, 0 at the first point."""
    lagged = with_previous(sensor, SENSOR_TRACK, "frame_id", ["x", "y"], depth=1)
    gap = F.greatest(F.col("frame_id") - F.col("prev1_frame_id"), F.lit(1))
    step = length(F.col("x") - F.col("prev1_x"), F.col("y") - F.col("prev1_y"))
    return lagged.select(*SENSOR_TRACK, "frame_id", F.coalesce(step / gap, F.lit(0.0)).alias("speed"))


def route_sequences(sensor: DataFrame, step: float = 10.0) -> DataFrame:
    """Positions relative to the start at every ``step`` of travelled distance.

    The last grid point may lie past the end and repeats the end position; a track
    that never moves keeps its points as they are.
    """
    single = one_chunk(sensor, "frame_id")
    lagged = with_previous(sensor, SENSOR_TRACK, "frame_id", ["x", "y"], depth=1, single=single)
    moved = F.coalesce(length(F.col("x") - F.col("prev1_x"), F.col("y") - F.col("prev1_y")), F.lit(0.0))
    travelled = running(
        lagged.withColumn("_d", moved), SENSOR_TRACK, "frame_id", {"cum": ("sum", "_d")}, single=single
    )
    ends = lagged.withColumn("_d", moved).groupBy(*SENSOR_TRACK).agg(
        F.min_by(F.struct("x", "y"), "frame_id").alias("_a"),
        F.max("frame_id").alias("_end"),
        F.sum("_d").alias("_total"),
    )
    rows = travelled.join(ends, SENSOR_TRACK)
    still = F.col("_total") <= EPSILON
    before = F.col("cum") - F.col("_d")
    first = F.col("prev1_frame_id").isNull()
    low = F.when(first, F.lit(0)).otherwise(F.floor(before / step) + 1)
    high = F.when(F.col("frame_id") == F.col("_end"), F.ceil((F.col("_total") + step) / step) - 1).otherwise(
        F.when(first, F.lit(0)).otherwise(F.floor(F.col("cum") / step))
    )
    grid = F.when(still, F.array(F.lit(0).cast("bigint"))).when(
        high >= low, F.sequence(low.cast("bigint"), high.cast("bigint"))
    ).otherwise(F.array().cast("array<bigint>"))
    spread = rows.withColumn("slot", F.explode(grid))
    share = F.least((F.col("slot") * step - before) / F.col("_d"), F.lit(1.0))

    def at(c: str):
        here = F.col(c) - F.col(f"_a.{c}")
        then = F.col(f"prev1_{c}") - F.col(f"_a.{c}")
        return F.when(still | first | (F.col("_d") <= 0), here).otherwise(then + (here - then) * share)

    return spread.select(
        *SENSOR_TRACK,
        F.when(still, F.col("frame_id").cast("bigint")).otherwise(F.col("slot")).alias("slot"),
        at("x").alias("x"),
        at("y").alias("y"),
    )


def shape_sequences(
    sensor: DataFrame, time_step: float = 24.0, min_length: float = 1.0, min_moves: int = 2, min_variance: float = 1e-8
) -> DataFrame:
    """Length-normalised, resampled and axis-aligned shape of every sensor track.

    Consecutive duplicates are dropped, positions and times divided by the path
    length, resampled, standardised per track and turned to principal axes.  After
    standardising, the covariance of two axes is [[1, r], [r, 1]], so the axes are
    the two diagonals; a track without enough motion has no shape.
    """
    single = one_chunk(sensor, "frame_id")
    lagged = with_previous(sensor, SENSOR_TRACK, "frame_id", ["x", "y"], depth=1, single=single)
    kept = materialize(
        lagged.where(
            F.col("prev1_x").isNull() | (F.col("x") != F.col("prev1_x")) | (F.col("y") != F.col("prev1_y"))
        ).select(*SENSOR_TRACK, "frame_id", "x", "y")
    )
    placed = materialize(indexed(kept, SENSOR_TRACK))
    steps = with_previous(placed, SENSOR_TRACK, "frame_id", ["x", "y"], depth=1, single=single).withColumn(
        "_d", F.coalesce(length(F.col("x") - F.col("prev1_x"), F.col("y") - F.col("prev1_y")), F.lit(0.0))
    )
    stats = steps.groupBy(*SENSOR_TRACK).agg(
        F.min_by(F.struct("x", "y"), "frame_id").alias("_a"),
        F.sum("_d").alias("_len"),
        F.count(F.when(F.col("_d") > EPSILON, 1)).alias("_moves"),
    )
    usable = stats.where((F.col("_len") > max(EPSILON, min_length)) & (F.col("_moves") >= min_moves))
    rows = steps.join(usable, SENSOR_TRACK).where(F.col("n") >= 2)
    path, i, n = F.col("_len"), F.col("index"), F.col("n")
    total = (n - 1) / path
    stamp, before = i / path, (i - 1) / path
    whole = total >= time_step
    is_end = i == n - 1
    last_grid = F.ceil(total / time_step) - 1
    low = F.when(i == 0, F.lit(0)).otherwise(F.floor(before / time_step) + 1)
    high = F.when(i == 0, F.lit(0)).otherwise(F.least(F.floor(stamp / time_step), last_grid))
    inner = F.when(
        whole & (high >= low), F.sequence(low.cast("bigint"), high.cast("bigint"))
    ).otherwise(F.array().cast("array<bigint>"))
    tail = F.when(is_end, F.array((last_grid + 1).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    # short tracks keep the start (0, 0) and the end position
    short = F.when(i == 0, F.array(F.lit(0).cast("bigint"))).when(is_end, F.array(F.lit(1).cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )
    spread = rows.withColumn("slot", F.explode(F.when(whole, F.concat(inner, tail)).otherwise(short)))
    share = F.when(is_end & (F.col("slot") > last_grid), F.lit(1.0)).otherwise(
        (F.col("slot") * time_step - before) * path
    )

    def at(c: str):
        here = (F.col(c) - F.col(f"_a.{c}")) / path
        then = (F.col(f"prev1_{c}") - F.col(f"_a.{c}")) / path
        return F.when((i == 0) | ~whole, here).otherwise(then + (here - then) * share)

    curve = materialize(spread.select(*SENSOR_TRACK, "slot", at("x").alias("x"), at("y").alias("y")))
    moments = curve.groupBy(*SENSOR_TRACK).agg(
        F.avg("x").alias("_mx"),
        F.avg("y").alias("_my"),
        F.stddev_pop("x").alias("_vx"),
        F.stddev_pop("y").alias("_vy"),
        F.covar_pop("x", "y").alias("_c"),
    )
    grand = (F.col("_vx") ** 2 + F.col("_vy") ** 2) / 2 + ((F.col("_mx") - F.col("_my")) / 2) ** 2
    joined = curve.join(moments.where(grand > min_variance), SENSOR_TRACK)
    zx = F.when(F.col("_vx") > 0, (F.col("x") - F.col("_mx")) / F.col("_vx")).otherwise(F.lit(0.0))
    zy = F.when(F.col("_vy") > 0, (F.col("y") - F.col("_my")) / F.col("_vy")).otherwise(F.lit(0.0))
    root = F.sqrt(F.lit(2.0))
    flat = (F.col("_vx") <= 0) | (F.col("_vy") <= 0)
    main = F.when(F.col("_c") >= 0, (zx + zy) / root).otherwise((zx - zy) / root)
    side = F.when(F.col("_c") >= 0, (zx - zy) / root).otherwise((zx + zy) / root)
    return joined.select(
        *SENSOR_TRACK,
        "slot",
        F.when(flat, zx + zy).otherwise(main).alias("main_axis"),
        F.when(flat, F.lit(0.0)).otherwise(side).alias("side_axis"),
    )


def length_filter(sequences: DataFrame, keys: Sequence[str], low: int, high: int | None = None) -> DataFrame:
    """Sequences of at least ``low`` and at most ``high`` rows."""
    counts = sequences.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= low)
    if high is not None:
        counts = counts.where(F.col("_n") <= high)
    return sequences.join(counts.select(*keys), list(keys), "left_semi")
