"""Scoring of tracks and window objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import clamp, finite, length, saturate01
from trackloom.operators.knn import knn_join, local_outlier_factors, mean_neighbour_distance, vectorize
from trackloom.operators.motion import TRACK, simple_components, track_steps
from trackloom.operators.ranks import column_profile, robust_by_group, robust_columns
from trackloom.operators.scale import percentiles
from trackloom.operators.segments import WEIGHTS, frame_evidence
from trackloom.operators.windows import OBJECT
from trackloom.session import materialize

# Groups of features behind each component.
KINEMATIC_COMPONENTS = {
    "speed": ["mean_speed", "max_speed", "speed_variance", "stop_ratio"],
    "acceleration": ["mean_acceleration", "max_acceleration"],
    "jerk": ["mean_jerk", "max_jerk"],
    "turn": ["mean_turn_angle", "max_turn_angle"],
    "smoothness": ["path_efficiency", "smoothness_residual"],
}
GROUP_WEIGHTS = {"motion_inconsistency": 0.45, "group_leaving": 0.35, "modal_inconsistency": 0.20}
FUSION_ALPHA = 0.65


def simple_track_scores(points: DataFrame, with_events: bool = True) -> DataFrame:
    """Robustly scaled components, weighted; event score is the strongest frame."""
    steps = materialize(
        track_steps(points).select(*TRACK, "frame_id", "confidence", "modal_offset", "step", "heading_turn")
    )
    names = list(WEIGHTS)
    scaled = robust_columns(simple_components(steps, steps), TRACK, names)
    total = sum((F.col(f"n_{n}") * w for n, w in WEIGHTS.items()), F.lit(0.0))
    scores = scaled.withColumn("score", total)
    if not with_events:
        return scores
    events = frame_evidence(points, steps).groupBy("sample_id").agg(F.max("score").alias("event_score"))
    return scores.join(events, "sample_id", "left").withColumn(
        "event_score", F.coalesce("event_score", F.lit(0.0))
    )


def kinematic_profile_scores(train_features: DataFrame, score_features: DataFrame, eps: float = 1e-3) -> DataFrame:
    """Mean distance from the training medians in robust scales, by component.

    Without spread the scale is a share of the median size; no scale is below eps.
    """
    used = [f for fs in KINEMATIC_COMPONENTS.values() for f in fs]
    profile = column_profile(train_features, used)

    def residual(feature: str) -> Column:
        p = profile[feature]
        wide = 1.4826 * p["mad"] if p["mad"] > 0 else max(p["abs_median"], 1.0) * eps
        return F.abs(F.col(feature) - F.lit(float(p["median"]))) / F.lit(max(wide, eps))

    parts = {
        name: sum((residual(f) for f in fs), F.lit(0.0)) / len(fs)
        for name, fs in KINEMATIC_COMPONENTS.items()
    }
    scored = score_features.select(*TRACK, *[c.alias(n) for n, c in parts.items()])
    mean = sum((F.col(n) for n in parts), F.lit(0.0)) / len(parts)
    return scored.withColumn("score", finite(mean))


def _others_median(value: Column, low: Column, mid: Column, high: Column, n: Column) -> Column:
    """Median of the other n - 1 values from order statistics around the middle.

    With h = n div 2, ``low, mid, high`` are the sorted values at h-1, h, h+1.
    Taking out a value below, at or above the middle shifts the rest by one.
    """
    odd = (
        F.when(value < mid, (mid + high) / 2)
        .when(value > mid, (low + mid) / 2)
        .otherwise((low + high) / 2)
    )
    even = F.when(value <= low, mid).otherwise(low)
    return F.when(n <= 1, F.lit(0.0)).when(n % 2 == 1, odd).otherwise(even)


def lightweight_group_scores(points: DataFrame) -> DataFrame:
    """Objects that move unlike the others of the window, leave it, or drift apart.

    Every median over a window goes through ``percentiles``, so a window with very
    many objects is never gathered; the median of the *others* needs only three
    order statistics of the window.
    """
    center = F.struct("cx", "cy")
    ends = points.groupBy(*OBJECT).agg(
        F.min_by(center, "frame_id").alias("a"),
        F.max_by(center, "frame_id").alias("b"),
        F.count(F.lit(1)).alias("n"),
        F.percentile(F.when(F.col("num_modalities") == 2, F.col("modal_offset")), F.lit(0.5)).alias("_off"),
    )
    objects = materialize(
        ends.select(
            *OBJECT,
            F.col("a.cx").alias("ax"),
            F.col("a.cy").alias("ay"),
            F.col("b.cx").alias("bx"),
            F.col("b.cy").alias("by"),
            (F.col("b.cx") - F.col("a.cx")).alias("dx"),
            (F.col("b.cy") - F.col("a.cy")).alias("dy"),
            "n",
            F.coalesce("_off", F.lit(0.0)).alias("modal_inconsistency"),
        )
    )
    wanted: dict = {f"m_{c}": (c, 0.5) for c in ("ax", "ay", "bx", "by")}
    for c in ("dx", "dy"):
        wanted[f"l_{c}"] = (c, lambda n: F.greatest(F.floor(n / 2) - 1, F.lit(0)))
        wanted[f"h_{c}"] = (c, lambda n: F.floor(n / 2))
        wanted[f"u_{c}"] = (c, lambda n: F.least(F.floor(n / 2) + 1, n - 1))
    window = percentiles(objects, ["window_id"], wanted).join(
        objects.groupBy("window_id").agg(F.count(F.lit(1)).alias("_size")), "window_id"
    )

    def other(c: str) -> Column:
        return _others_median(
            F.col(c), F.col(f"l_{c}"), F.col(f"h_{c}"), F.col(f"u_{c}"), F.col("_size")
        )

    leaving = length(F.col("bx") - F.col("m_bx"), F.col("by") - F.col("m_by")) - length(
        F.col("ax") - F.col("m_ax"), F.col("ay") - F.col("m_ay")
    )
    raw = objects.join(window, "window_id").select(
        *OBJECT,
        length(F.col("dx") - other("dx"), F.col("dy") - other("dy")).alias("motion_inconsistency"),
        F.when(F.col("n") >= 2, F.greatest(F.lit(0.0), leaving)).otherwise(F.lit(0.0)).alias("group_leaving"),
        "modal_inconsistency",
    )
    scaled = robust_by_group(raw, ["window_id"], OBJECT, list(GROUP_WEIGHTS), tie="track_id")
    total = sum((F.col(f"n_{n}") * w for n, w in GROUP_WEIGHTS.items()), F.lit(0.0))
    return scaled.withColumn("score", total)


def fuse_scores(individual: DataFrame, group: DataFrame, alpha: float = FUSION_ALPHA) -> DataFrame:
    """alpha * individual + (1 - alpha) * group after robust scaling of each side.

    A track scored by one side only passes through.  Inputs need sample_id and
    score, and may carry event_score.
    """
    sides = []
    for name, df in (("ind", individual), ("grp", group)):
        event = F.col("event_score") if "event_score" in df.columns else F.lit(0.0)
        table = df.select("sample_id", "score", event.alias("event"))
        scaled = robust_columns(table, ["sample_id", "event"], ["score"])
        sides.append(
            scaled.select("sample_id", F.col("n_score").alias(f"s_{name}"), F.col("event").alias(f"e_{name}"))
        )
    joined = sides[0].join(sides[1], "sample_id", "full_outer")
    ind, grp = F.col("s_ind"), F.col("s_grp")
    score = (
        F.when(ind.isNotNull() & grp.isNotNull(), alpha * ind + (1.0 - alpha) * grp)
        .when(ind.isNotNull(), ind)
        .otherwise(grp)
    )
    used = F.concat_ws("+", F.when(ind.isNotNull(), F.lit("individual")), F.when(grp.isNotNull(), F.lit("group")))
    zero = F.lit(0.0)
    return joined.select(
        "sample_id",
        score.alias("score"),
        F.coalesce(ind, zero).alias("s_ind"),
        F.coalesce(grp, zero).alias("s_grp"),
        F.greatest(F.coalesce("e_ind", zero), F.coalesce("e_grp", zero)).alias("s_event"),
        used.alias("used_sources"),
    )


# Feature groups of the behaviour components.
BEHAVIOUR_COLUMNS = {
    "route": ["duration_frames", "num_points", "path_length", "displacement"],
    "speed": ["mean_speed", "max_speed", "std_speed", "mean_acceleration", "max_acceleration"],
    "shape": ["mean_turn_angle", "max_turn_angle", "bbox_area_mean", "bbox_area_std"],
    "modal": ["modal_offset_mean", "modal_offset_max"],
}


def behaviour_components(train_features: DataFrame, score_features: DataFrame) -> DataFrame:
    """Saturated robust distances from the training profile per kind of behaviour."""
    used = sorted({f for fs in BEHAVIOUR_COLUMNS.values() for f in fs})
    profile = column_profile(train_features, used)

    def scale(p: dict) -> float:
        return p["mad"] if p["mad"] > 1e-6 else p["std"] if p["std"] > 1e-6 else 1.0

    def distance(features: list[str]) -> Column:
        terms = [
            F.abs((F.col(f) - F.lit(float(profile[f]["median"]))) / F.lit(float(scale(profile[f]))))
            for f in features
        ]
        return saturate01(sum(terms, F.lit(0.0)) / len(terms))

    speed = profile["mean_speed"]
    slow = (F.lit(float(speed["median"])) - F.col("mean_speed")) / F.lit(float(scale(speed)))
    table = score_features.select(
        *TRACK,
        distance(BEHAVIOUR_COLUMNS["route"]).alias("route_score"),
        distance(BEHAVIOUR_COLUMNS["speed"]).alias("speed_score"),
        saturate01(slow).alias("speed_slowdown_score"),
        distance(["max_speed", "max_acceleration"]).alias("jump_score"),
        distance(BEHAVIOUR_COLUMNS["shape"]).alias("shape_score"),
        distance(BEHAVIOUR_COLUMNS["modal"]).alias("modal_offset_score"),
    )
    return table.withColumn("route_shape_score", F.greatest("route_score", "shape_score"))


def nearest_profile_scores(
    train_features: DataFrame, score_features: DataFrame, columns: list[str], id_col: str = "sample_id", k: int = 1
) -> DataFrame:
    """Mean distance to the k nearest training rows in standardised feature space."""
    profile = column_profile(train_features, columns)
    train = materialize(vectorize(train_features, id_col, columns, profile))
    score = materialize(vectorize(score_features, id_col, columns, profile))
    k = max(1, min(k, train.count()))
    return mean_neighbour_distance(knn_join(score, train, k)).withColumnRenamed("query_id", id_col)


def lof_scores(
    train_features: DataFrame, score_features: DataFrame, columns: list[str], id_col: str = "sample_id", k: int = 20
) -> DataFrame:
    """Local outlier factor in standardised feature space."""
    profile = column_profile(train_features, columns)
    train = materialize(vectorize(train_features, id_col, columns, profile))
    score = materialize(vectorize(score_features, id_col, columns, profile))
    return local_outlier_factors(train, score, k).withColumnRenamed("query_id", id_col)


def spread_to_objects(window_scores: DataFrame, objects: DataFrame) -> DataFrame:
    """A window's score copied to each of its objects."""
    return objects.select(*OBJECT).distinct().join(window_scores, "window_id")


def hybrid_rank_fusion(
    ranks: DataFrame,
    weights: tuple[float, float, float] = (0.6, 0.2, 0.2),
    gate: bool = False,
    gate_power: float = 1.0,
    gate_floor: float = 0.0,
) -> DataFrame:
    """Weighted prediction, graph and temporal ranks (columns r_prediction, r_graph, r_temporal).

    With the gate the last two count in proportion to floor + (1 - floor) * r^power of
    the prediction rank.
    """
    total = sum(weights)
    wp, wg, wt = (w / total for w in weights)
    floor = min(1.0, max(0.0, gate_floor))
    r = clamp(finite(F.col("r_prediction")))
    side = clamp(F.lit(floor) + (1.0 - floor) * F.pow(r, F.lit(max(0.0, gate_power))), floor, 1.0) if gate else F.lit(1.0)
    score = wp * r + side * (wg * clamp(finite(F.col("r_graph"))) + wt * clamp(finite(F.col("r_temporal"))))
    return ranks.withColumn("score", clamp(score))
