"""Sequence splits, anomaly injection and complete labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.operators.scale import dense_position, row_positions, running
from trackloom.session import materialize


def split_sequences(
    sequences: DataFrame, val_fraction: float = 0.25, seed: int = 42, test_sequences: tuple[str, ...] = ()
) -> DataFrame:
    """train / val / test by sequence.

    Of the n sequences outside the named test set, int(n * fraction) become val,
    at least one (when the fraction is positive) and at most n - 1 when n >= 2.
    The order is the md5 of seed and name, the same on every engine.
    """
    if not 0 <= val_fraction <= 1:
        raise ValueError("val_fraction must be between 0 and 1")
    named = sequences.select("sequence").distinct()
    test = F.col("sequence").isin(list(test_sequences)) if test_sequences else F.lit(False)
    hashed = named.where(~test).withColumn("_h", F.md5(F.concat(F.lit(f"{seed}:"), F.col("sequence"))))
    placed = row_positions(hashed, [], [("_h", True), ("sequence", True)])
    n = F.col("position_count")
    quota = F.floor(n * F.lit(float(val_fraction)))
    if val_fraction > 0:
        quota = F.when(n >= 2, F.least(F.greatest(quota, F.lit(1)), n - 1)).otherwise(quota)
    splits = placed.select(
        "sequence", F.when(F.col("position") < quota, F.lit("val")).otherwise(F.lit("train")).alias("split")
    )
    if test_sequences:
        splits = splits.unionByName(named.where(test).select("sequence", F.lit("test").alias("split")))
    return splits


def split_rows(rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Attach the split of its sequence to every row."""
    return rows.join(splits, "sequence")


# Anomaly kinds in rotation order and their magnitudes.
TRACK_ANOMALIES = ["route_shift", "speed_spike", "stop_or_slowdown", "jump", "shape_warp", "modal_offset"]
GROUP_ANOMALIES = [
    "leave_group",
    "against_motion",
    "neighbor_replacement",
    "population_change",
    "dispersion_change",
    "split_merge",
]
MODALITIES = ("rgb", "thermal")


def hash_order(seed: int, *keys: Column) -> Column:
    """md5 of seed and keys: a reproducible shuffle key, equal on every engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *keys))


def signed(seed: int, tag: str, key: Column, magnitude: float) -> Column:
    """Plus or minus the magnitude, by the first hash digit."""
    digit = F.substring(F.md5(F.concat(F.lit(f"{seed}:{tag}:"), key)), 1, 1)
    return F.when(digit < "8", F.lit(float(magnitude))).otherwise(F.lit(-float(magnitude)))


def pick(candidates: DataFrame, key: str, fraction: float, seed: int, kinds: list[str]) -> DataFrame:
    """ceil(n * fraction) keys (at least one) in hash order, kinds in rotation."""
    if not 0 <= fraction <= 1:
        raise ValueError("anomaly_fraction must be between 0 and 1")
    hashed = candidates.withColumn("_h", hash_order(seed, F.col(key)))
    placed = row_positions(hashed, [], [("_h", True), (key, True)])
    quota = F.greatest(F.ceil(F.col("position_count") * F.lit(float(fraction))), F.lit(1)) if fraction > 0 else F.lit(0)
    rotation = F.get(F.array(*[F.lit(k) for k in kinds]), F.pmod("position", F.lit(len(kinds))).cast("int"))
    return placed.where(F.col("position") < quota).select(*candidates.columns, rotation.alias("anomaly_type"))


def inject_track_anomalies(points: DataFrame, fraction: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Fused points with some tracks disturbed, and one label row per disturbed track.

    Kinds rotate along the hash order of the tracks.  A one-point track cannot
    speed up, stop or warp; it takes the next kind that applies.  Returns
    materialised ``(points, labels)``; the input stays as it is.
    """
    tracks = points.groupBy("sample_id", "sequence", "track_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("frame_id").alias("frame_start"),
        F.max("frame_id").alias("frame_end"),
    )
    chosen = pick(tracks, "sample_id", fraction, seed, TRACK_ANOMALIES)
    lonely = (
        F.when(F.col("anomaly_type").isin("speed_spike", "stop_or_slowdown"), F.lit("jump"))
        .when(F.col("anomaly_type") == "shape_warp", F.lit("modal_offset"))
        .otherwise(F.col("anomaly_type"))
    )
    chosen = materialize(
        chosen.withColumn("anomaly_type", F.when(F.col("n") < 2, lonely).otherwise(F.col("anomaly_type")))
    )
    labels = chosen.select(
        "sample_id",
        "sequence",
        "track_id",
        "frame_start",
        "frame_end",
        F.lit(1).alias("label"),
        "anomaly_type",
        F.lit(seed).alias("injection_seed"),
    )

    marks = chosen.select("sample_id", "anomaly_type", "n")
    touched = points.join(marks, "sample_id")
    touched = touched.join(
        dense_position(points.join(marks, "sample_id", "left_semi"), ["sample_id"], "frame_id", "index"),
        ["sample_id", "frame_id"],
    )
    middle = F.floor(F.col("n") / 2)
    anchor = F.greatest(middle - 1, F.lit(0))
    stats = touched.groupBy("sample_id").agg(
        F.min_by(F.struct("cx", "cy"), "frame_id").alias("first"),
        F.max(F.when(F.col("index") == anchor, F.struct("cx", "cy"))).alias("stop"),
        F.avg("cx").alias("mx"),
        F.avg("cy").alias("my"),
    )
    touched = touched.join(stats, "sample_id")
    kind, key = F.col("anomaly_type"), F.col("sample_id")
    sizes = {"x": (6.0, 10.0, 3.0, 1.25), "y": (4.0, 8.0, 2.0, 0.5)}

    def moved(column: str, axis: str) -> Column:
        shift, jump, offset, stretch = sizes[axis]
        c, primary, mean = F.col(column), F.col(f"c{axis}"), F.col(f"m{axis}")
        out = (
            F.when(kind == "route_shift", c + signed(seed, f"shift_{axis}", key, shift))
            .when((kind == "speed_spike") & (F.col("index") > 0), c + primary - F.col(f"first.c{axis}"))
            .when((kind == "stop_or_slowdown") & (F.col("index") > anchor), F.col(f"stop.c{axis}"))
            .when((kind == "jump") & (F.col("index") == middle), c + signed(seed, f"jump_{axis}", key, jump))
            .when(kind == "shape_warp", mean + (c - mean) * stretch)
        )
        if column.startswith(MODALITIES):
            out = out.when(kind == "modal_offset", c + signed(seed, f"offset_{axis}", key, offset))
        return F.when(c.isNotNull(), out.otherwise(c))

    columns = {f"{m}c{a}": moved(f"{m}c{a}", a) for m in ("", "rgb_", "thermal_") for a in ("x", "y")}
    disturbed = touched.select(*[columns.get(c, F.col(c)).alias(c) for c in points.columns])
    rest = points.join(marks, "sample_id", "left_anti")
    return materialize(disturbed.unionByName(rest)), labels


def complete_labels(keys: DataFrame, positives: DataFrame, seed: int = 42, by: tuple[str, ...] = ("sample_id",)) -> DataFrame:
    """A label row for every key: positives as given, the others 0 and normal.

    ``keys`` has the key columns, sequence, track_id, frame_start and frame_end.
    """
    by = list(by)
    marks = positives.select(*by, F.col("label").alias("_l"), F.col("anomaly_type").alias("_t"))
    return keys.join(marks, by, "left").select(
        *keys.columns,
        F.coalesce("_l", F.lit(0)).alias("label"),
        F.coalesce("_t", F.lit("normal")).alias("anomaly_type"),
        F.lit(seed).alias("injection_seed"),
    )


def track_keys(points: DataFrame) -> DataFrame:
    return points.groupBy("sample_id", "sequence", "track_id").agg(
        F.min("frame_id").alias("frame_start"), F.max("frame_id").alias("frame_end")
    )


def window_keys(points: DataFrame) -> DataFrame:
    return points.select(
        "window_id", "sample_id", "sequence", "track_id", "frame_start", "frame_end"
    ).distinct()


def inject_group_anomalies(points: DataFrame, fraction: float = 0.1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Window points with one object disturbed in some windows, and the labels.

    Windows are taken in hash order with rotating kinds; inside a window the object
    with the smallest hash is disturbed.  A kind that needs a neighbour falls back
    to the next one in a window of one object.
    """
    objects = window_keys(points)
    hashed = objects.withColumn("_h", hash_order(seed, F.col("window_id"), F.col("sample_id")))
    number = F.expr("try_cast(track_id AS BIGINT)")
    by_name = F.struct(number.isNull().alias("text"), number.alias("number"), F.col("track_id").alias("name"))
    windows = hashed.groupBy("window_id").agg(
        F.min_by("track_id", F.struct("_h", "sample_id")).alias("victim"),
        F.min(by_name)["name"].alias("lead"),
        F.count(F.lit(1)).alias("size"),
    )
    chosen = materialize(pick(windows, "window_id", fraction, seed, GROUP_ANOMALIES))
    second = (
        hashed.join(chosen.where(F.col("victim") == F.col("lead")).select("window_id", "lead"), "window_id")
        .where(F.col("track_id") != F.col("lead"))
        .groupBy("window_id")
        .agg(F.min(by_name)["name"].alias("second"))
    )
    chosen = materialize(
        chosen.join(second, "window_id", "left").select(
            "window_id",
            "victim",
            F.when(
                (F.col("size") < 2) & (F.col("anomaly_type") == "neighbor_replacement"), F.lit("population_change")
            )
            .otherwise(F.col("anomaly_type"))
            .alias("anomaly_type"),
            F.when(F.col("victim") == F.col("lead"), F.col("second")).otherwise(F.col("lead")).alias("other"),
        )
    )
    labels = (
        objects.join(chosen, (objects.window_id == chosen.window_id) & (objects.track_id == chosen.victim))
        .select(objects["*"], F.lit(1).alias("label"), "anomaly_type", F.lit(seed).alias("injection_seed"))
    )

    mine = points.join(
        chosen.select("window_id", F.col("victim").alias("track_id"), "anomaly_type", "other"),
        ["window_id", "track_id"],
    )
    # one object of one window: at most window-size rows
    w = Window.partitionBy("window_id", "track_id").orderBy("frame_id")
    back = Window.partitionBy("window_id", "track_id").orderBy(F.col("frame_id").desc())
    whole = Window.partitionBy("window_id", "track_id")
    ordered = mine.withColumns(
        {
            "_i": F.row_number().over(w) - 1,
            "_j": F.row_number().over(back) - 1,
            "_n": F.count(F.lit(1)).over(whole),
        }
    )
    centers = [f"{m}c{a}" for m in ("", "rgb_", "thermal_") for a in ("x", "y")]
    mirror = ordered.select("window_id", "track_id", F.col("_j").alias("_i"), *[F.col(c).alias(f"r_{c}") for c in centers])
    beside = points.join(
        chosen.where(F.col("anomaly_type") == "neighbor_replacement").select(
            "window_id", F.col("other").alias("track_id")
        ),
        ["window_id", "track_id"],
    ).select("window_id", "frame_id", *[F.col(c).alias(f"b_{c}") for c in centers])
    means = points.join(chosen.select("window_id"), "window_id", "left_semi").groupBy("window_id").agg(
        F.avg("cx").alias("_mx"), F.avg("cy").alias("_my")
    )
    full = (
        ordered.join(mirror, ["window_id", "track_id", "_i"])
        .join(beside, ["window_id", "frame_id"], "left")
        .join(means, "window_id")
    )
    kind = F.col("anomaly_type")
    key = F.concat_ws(":", "window_id", "sample_id")

    def moved(c: str) -> Column:
        axis = c[-1]
        own, mean = F.col(c), F.col(f"_m{axis}")
        away = own - mean
        side = F.when(F.col("_i") < F.floor(F.col("_n") / 2), F.lit(-5.0)).otherwise(F.lit(5.0))
        out = (
            F.when(kind == "leave_group", own + signed(seed, f"leave_{axis}", key, 12.0 if axis == "x" else 8.0))
            .when(kind == "against_motion", F.coalesce(F.col(f"r_{c}"), own))
            .when(kind == "neighbor_replacement", F.coalesce(F.col(f"b_{c}") + 1.5, own))
            .when(kind == "dispersion_change", own + F.when(away != 0, away).otherwise(F.lit(5.0)))
        )
        if axis == "x":
            out = out.when(kind == "split_merge", own + side)
        return F.when(own.isNotNull(), out.otherwise(own))

    changed = full.select(*[(moved(c) if c in centers else F.col(c)).alias(c) for c in points.columns])
    copies = mine.where(kind == "population_change").select(
        *[
            F.concat(F.col(c), F.lit(":population_copy")).alias(c) if c in ("sample_id", "track_id") else F.col(c)
            for c in points.columns
        ]
    )
    rest = points.join(
        chosen.select("window_id", F.col("victim").alias("track_id")), ["window_id", "track_id"], "left_anti"
    )
    return materialize(rest.unionByName(changed).unionByName(copies)), labels


def holdout_sample(rows: DataFrame, limit: int, seed: int = 42, key: str = "sample_id") -> DataFrame:
    """At most ``limit`` rows with the smallest md5 of seed and key."""
    return rows.orderBy(hash_order(seed, F.col(key)), key).limit(limit)


def split_by_quota(track_counts: DataFrame, ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """val sequences in hash order until they hold at least ratio of all tracks.

    ``track_counts`` has sequence and tracks.  A sequence is val while the tracks
    before it fall short of the quota.
    """
    hashed = materialize(track_counts.withColumn("_h", hash_order(seed, F.col("sequence"))))
    placed = row_positions(hashed, [], [("_h", True), ("sequence", True)])
    total = hashed.agg(F.sum("tracks")).first()[0] or 0
    summed = running(placed, [], "position", {"_upto": ("sum", "tracks")})
    before = F.col("_upto") - F.col("tracks")
    return summed.select(
        "sequence", "tracks", F.when(before < ratio * total, F.lit("val")).otherwise(F.lit("train")).alias("split")
    )
