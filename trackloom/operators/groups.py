"""Window and frame features of object groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions.geometry import length
from trackloom.operators.motion import TRACK, handcrafted_features
from trackloom.operators.neighbours import FRAME, neighbour_stats
from trackloom.operators.scale import percentiles
from trackloom.session import materialize

# Fixed values of the context features.
NEAR_DISTANCE = 10.0
ALONE_DISTANCE = 20.0
GROUP_FEATURES = [
    "num_objects",
    "num_frames",
    "mean_group_size",
    "max_group_size",
    "mean_dispersion",
    "max_dispersion",
    "mean_speed",
    "std_speed",
    "neighbor_churn",
]
SIGNATURES = [
    "num_objects",
    "edge_density",
    "mean_degree",
    "degree_std",
    "mean_pair_distance",
    "dispersion",
    "mean_speed",
    "neighbor_churn",
]
CONTEXT = [
    "context_num_neighbors",
    "context_nearest_distance_mean",
    "context_neighbor_distance_mean",
    "context_group_dispersion_mean",
    "context_isolation_ratio",
    "context_relative_speed_mean",
]


def frame_dispersion(points: DataFrame) -> DataFrame:
    """Size, centroid and mean distance to the centroid of every frame group."""
    center = points.groupBy(*FRAME).agg(F.avg("cx").alias("_mx"), F.avg("cy").alias("_my"))
    away = length(F.col("cx") - F.col("_mx"), F.col("cy") - F.col("_my"))
    return (
        points.join(center, FRAME)
        .groupBy(*FRAME)
        .agg(F.count(F.lit(1)).alias("size"), F.avg(away).alias("dispersion"))
    )


def window_speeds(points: DataFrame) -> DataFrame:
    """Speed into each point from the object's previous point in the window (null first)."""
    w = Window.partitionBy("window_id", "track_id").orderBy("frame_id")
    gap = F.greatest(F.col("frame_id") - F.lag("frame_id").over(w), F.lit(1))
    step = length(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w))
    return points.withColumn("speed", step / gap)


def nearest_ids(stats: DataFrame) -> DataFrame:
    return stats.select(*FRAME, "track_id", F.get("nearest", F.lit(0))["id"].alias("neighbour"))


def churn_since_seen(nearest: DataFrame) -> DataFrame:
    """Nearest neighbour against the last frame in which the object was seen."""
    w = Window.partitionBy("window_id", "track_id").orderBy("frame_id")
    seen = F.lag("frame_id").over(w)
    changed = ~F.lag("neighbour").over(w).eqNullSafe(F.col("neighbour"))
    return nearest.select(
        *FRAME,
        "track_id",
        F.when(seen.isNotNull(), F.lit(1)).otherwise(F.lit(0)).alias("compared"),
        F.when(seen.isNotNull() & changed, F.lit(1)).otherwise(F.lit(0)).alias("changed"),
    )


def churn_since_previous_frame(nearest: DataFrame) -> DataFrame:
    """Nearest neighbour against the previous frame that has objects, only.

    The frames of a window are few (window size); objects absent from the previous
    frame are not compared.
    """
    frames = nearest.select(*FRAME).distinct()
    order = Window.partitionBy("window_id").orderBy("frame_id")
    before = frames.withColumn("_before", F.lag("frame_id").over(order))
    w = Window.partitionBy("window_id", "track_id").orderBy("frame_id")
    rows = nearest.withColumns(
        {"_seen": F.lag("frame_id").over(w), "_was": F.lag("neighbour").over(w)}
    ).join(before, FRAME)
    compared = F.coalesce(F.col("_seen") == F.col("_before"), F.lit(False))
    changed = ~F.col("_was").eqNullSafe(F.col("neighbour"))
    return rows.select(
        *FRAME,
        "track_id",
        compared.cast("int").alias("compared"),
        (compared & changed).cast("int").alias("changed"),
    )


def _share(changed: str, compared: str):
    total = F.sum(compared)
    return F.when(total > 0, F.sum(changed) / total).otherwise(F.lit(0.0))


def group_features(points: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Nine features per window."""
    stats = stats if stats is not None else neighbour_stats(points, totals=False)
    frames = (
        frame_dispersion(points)
        .groupBy("window_id")
        .agg(
            F.count(F.lit(1)).alias("num_frames"),
            F.avg("size").alias("mean_group_size"),
            F.max("size").cast("double").alias("max_group_size"),
            F.avg("dispersion").alias("mean_dispersion"),
            F.max("dispersion").alias("max_dispersion"),
        )
    )
    speeds = window_speeds(points).groupBy("window_id", "sequence", "frame_start", "frame_end", "track_id").agg(
        F.sum("speed").alias("_s"), F.sum(F.col("speed") * F.col("speed")).alias("_ss"), F.count("speed").alias("_n")
    )
    n = F.sum("_n")
    mean = F.sum("_s") / n
    objects = speeds.groupBy("window_id", "sequence", "frame_start", "frame_end").agg(
        F.count(F.lit(1)).alias("num_objects"),
        F.coalesce(mean, F.lit(0.0)).alias("mean_speed"),
        F.coalesce(F.sqrt(F.greatest(F.sum("_ss") / n - mean * mean, F.lit(0.0))), F.lit(0.0)).alias("std_speed"),
    )
    churn = (
        churn_since_seen(nearest_ids(stats))
        .groupBy("window_id")
        .agg(_share("changed", "compared").alias("neighbor_churn"))
    )
    return (
        objects.join(frames, "window_id")
        .join(churn, "window_id")
        .select("window_id", "sequence", "frame_start", "frame_end", *GROUP_FEATURES)
    )


def frame_signatures(points: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Eight graph features per (window, frame) from nearest-neighbour edges."""
    stats = stats if stats is not None else neighbour_stats(points)
    nearest = nearest_ids(stats)
    edges = (
        nearest.where(F.col("neighbour").isNotNull())
        .select(*FRAME, F.least("track_id", "neighbour").alias("a"), F.greatest("track_id", "neighbour").alias("b"))
        .distinct()
    )
    degrees = (
        edges.select(*FRAME, F.explode(F.array("a", "b")).alias("track_id"))
        .groupBy(*FRAME, "track_id")
        .agg(F.count(F.lit(1)).alias("_d"))
        .groupBy(*FRAME)
        .agg(F.sum("_d").alias("_dsum"), F.sum(F.col("_d") * F.col("_d")).alias("_dsq"))
    )
    totals = stats.groupBy(*FRAME).agg(F.sum("sum_distance").alias("_pairs"))
    speeds = window_speeds(points).groupBy(*FRAME).agg(F.avg("speed").alias("_speed"))
    churn = (
        churn_since_previous_frame(nearest)
        .groupBy(*FRAME)
        .agg(_share("changed", "compared").alias("neighbor_churn"))
    )
    n = F.col("size")
    pairs = n * (n - 1)
    zero = F.lit(0.0)
    dsum = F.coalesce("_dsum", F.lit(0))
    mean_degree = dsum / n
    variance = F.coalesce("_dsq", F.lit(0)) / n - mean_degree * mean_degree
    return (
        frame_dispersion(points)
        .join(totals, FRAME)
        .join(speeds, FRAME)
        .join(churn, FRAME)
        .join(degrees, FRAME, "left")
        .select(
            *FRAME,
            n.cast("double").alias("num_objects"),
            F.when(pairs > 0, dsum / pairs).otherwise(zero).alias("edge_density"),
            mean_degree.alias("mean_degree"),
            F.sqrt(F.greatest(variance, zero)).alias("degree_std"),
            F.when(pairs > 0, F.col("_pairs") / pairs).otherwise(zero).alias("mean_pair_distance"),
            "dispersion",
            F.coalesce("_speed", zero).alias("mean_speed"),
            "neighbor_churn",
        )
    )


def context_features(points: DataFrame) -> DataFrame:
    """Six neighbourhood features per track, averaged over frames and windows.

    A frame seen by two overlapping windows counts twice, on purpose.  ``points``
    needs vx, vy (``with_window_motion``) and should be materialised.
    """
    stats = neighbour_stats(points, k=1, radius=NEAR_DISTANCE)
    frames = points.groupBy(*FRAME).agg(F.avg("vx").alias("_gx"), F.avg("vy").alias("_gy"))
    alone = F.col("num_others") == 0
    closest = F.coalesce(F.get("nearest", F.lit(0))["distance"], F.lit(ALONE_DISTANCE))
    mean_distance = F.when(alone, F.lit(ALONE_DISTANCE)).otherwise(F.col("sum_distance") / F.col("num_others"))
    isolated = alone | (closest > NEAR_DISTANCE)
    joined = (
        points.join(stats, [*FRAME, "track_id"])
        .join(frames, FRAME)
        .join(frame_dispersion(points).select(*FRAME, "dispersion"), FRAME)
    )
    return joined.groupBy(*TRACK).agg(
        F.avg("num_near").alias("context_num_neighbors"),
        F.avg(closest).alias("context_nearest_distance_mean"),
        F.avg(mean_distance).alias("context_neighbor_distance_mean"),
        F.avg("dispersion").alias("context_group_dispersion_mean"),
        F.avg(isolated.cast("double")).alias("context_isolation_ratio"),
        F.avg(length(F.col("vx") - F.col("_gx"), F.col("vy") - F.col("_gy"))).alias("context_relative_speed_mean"),
    )


def context_aware_features(points: DataFrame, window_points: DataFrame) -> DataFrame:
    """Track features with their context: by sample id, else by (sequence, track), else 0."""
    context = materialize(context_features(window_points))
    by_id = context.select("sample_id", *[F.col(c).alias(f"_i_{c}") for c in CONTEXT], F.lit(True).alias("_hit"))
    by_track = context.select("sequence", "track_id", *[F.col(c).alias(f"_t_{c}") for c in CONTEXT])
    base = handcrafted_features(points)
    joined = base.join(by_id, "sample_id", "left").join(by_track, ["sequence", "track_id"], "left")
    picked = [
        F.coalesce(F.when(F.col("_hit"), F.col(f"_i_{c}")), F.col(f"_t_{c}"), F.lit(0.0)).alias(c) for c in CONTEXT
    ]
    return joined.select(*base.columns, *picked)


def relative_displacement(points: DataFrame) -> DataFrame:
    """Motion of each object minus the median motion of its frame."""
    medians = percentiles(points, FRAME, {"_mx": ("vx", 0.5), "_my": ("vy", 0.5)})
    return points.join(medians, FRAME).withColumns(
        {"rel_dx": F.col("vx") - F.col("_mx"), "rel_dy": F.col("vy") - F.col("_my")}
    ).drop("_mx", "_my")


def neighbour_set_change(edges: DataFrame, points: DataFrame) -> DataFrame:
    """1 - Jaccard of an object's neighbours with those of the frame it was last seen in.

    Neighbour sets come from k-nearest edges; the exploded rows are compared by
    counting, so a much-linked object never becomes one long array.
    """
    links = edges.select(*FRAME, F.col("left").alias("track_id"), F.col("right").alias("other")).unionByName(
        edges.select(*FRAME, F.col("right").alias("track_id"), F.col("left").alias("other"))
    )
    w = Window.partitionBy("window_id", "track_id").orderBy("frame_id")
    seen = points.select(*FRAME, "track_id", F.lag("frame_id").over(w).alias("_before"))
    counts = links.groupBy(*FRAME, "track_id").agg(F.count(F.lit(1)).alias("_n"))
    earlier = seen.where(F.col("_before").isNotNull())
    now = earlier.join(links, [*FRAME, "track_id"])
    then = links.withColumnRenamed("frame_id", "_before")
    common = (
        now.join(then, ["window_id", "_before", "track_id", "other"], "left_semi")
        .groupBy(*FRAME, "track_id")
        .agg(F.count(F.lit(1)).alias("_both"))
    )
    zero = F.lit(0)
    both = F.coalesce("_both", zero)
    union = F.coalesce("_n", zero) + F.coalesce("_m", zero) - both
    change = F.when(F.col("_before").isNull() | (union == 0), F.lit(0.0)).otherwise(1.0 - both / union)
    return (
        seen.join(counts, [*FRAME, "track_id"], "left")
        .join(
            counts.select("window_id", F.col("frame_id").alias("_before"), "track_id", F.col("_n").alias("_m")),
            ["window_id", "_before", "track_id"],
            "left",
        )
        .join(common, [*FRAME, "track_id"], "left")
        .select(*FRAME, "track_id", change.alias("neighbour_change"))
    )
