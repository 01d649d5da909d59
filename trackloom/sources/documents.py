"""Nested track and window documents, built just before a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.operators.scale import CHUNK_FRAMES


def assemble_tracks(observations: DataFrame, part_frames: int = CHUNK_FRAMES) -> DataFrame:
    """Track documents with points sorted by frame.

    A document holds at most ``part_frames`` frames: a longer track becomes several
    documents, told apart by ``part`` and counted by ``parts``.  The visible frames and
    the category of every document are those of the whole track, so any part describes
    it; the points of all parts in order of ``part`` are its points.
    """
    track = ["sample_id", "sequence", "track_id"]
    part = F.floor(F.col("frame_id") / part_frames).cast("long")
    whole = observations.groupBy(*track).agg(
        F.count("rgb_cx").alias("visible_rgb_frames"),
        F.count("thermal_cx").alias("visible_thermal_frames"),
        F.count(F.when(F.col("rgb_cx").isNotNull() | F.col("thermal_cx").isNotNull(), 1)).alias("visible_any_frames"),
        F.min_by("category_name", "frame_id").alias("category_name"),
        F.count_distinct(part).alias("parts"),
    )
    point = F.struct(
        "frame_id",
        F.when(F.col("rgb_cx").isNotNull(), F.struct(F.col("rgb_cx").alias("x"), F.col("rgb_cy").alias("y"))).alias("rgb"),
        F.when(
            F.col("thermal_cx").isNotNull(),
            F.struct(F.col("thermal_cx").alias("x"), F.col("thermal_cy").alias("y")),
        ).alias("thermal"),
    )
    points = (
        observations.withColumn("part", part).groupBy(*track, "part").agg(F.sort_array(F.collect_list(point)).alias("points"))
    )
    return points.join(whole, track)


def assemble_windows(states: DataFrame, part_objects: int = 1024) -> DataFrame:
    """Window documents: every object with a state (or nulls) per frame of the window.

    A document holds about ``part_objects`` objects; a window with more becomes
    several documents, told apart by ``part``.
    """
    sides = [
        F.when(F.col(f"{m}_cx").isNotNull(), F.struct(F.col(f"{m}_cx").alias("x"), F.col(f"{m}_cy").alias("y"))).alias(m)
        for m in ("rgb", "thermal")
    ]
    window = ["window_id", "sequence", "frame_start", "frame_end"]
    frames = states.select("window_id", "frame_id").distinct()
    objects = states.select(*window, "sample_id", "track_id").distinct()
    grid = objects.join(frames, "window_id")
    filled = grid.join(states.select("window_id", "track_id", "frame_id", *sides), ["window_id", "track_id", "frame_id"], "left")
    # one state per frame of the window
    per_object = filled.groupBy(*window, "sample_id", "track_id").agg(
        F.sort_array(F.collect_list(F.struct("frame_id", "rgb", "thermal"))).alias("states")
    )
    sizes = per_object.groupBy("window_id").agg(F.ceil(F.count(F.lit(1)) / part_objects).cast("int").alias("_parts"))
    placed = per_object.join(sizes, "window_id").withColumn("part", F.pmod(F.xxhash64("track_id"), "_parts").cast("int"))
    number = F.expr("try_cast(track_id AS BIGINT)")
    entry = F.struct(number.isNull().alias("_t"), number.alias("_n"), "sample_id", "track_id", "states")
    docs = placed.groupBy(*window, "part").agg(F.sort_array(F.collect_list(entry)).alias("_o"))
    return docs.select(
        *window,
        "part",
        F.transform(
            "_o",
            lambda o: F.struct(
                o["sample_id"].alias("sample_id"), o["track_id"].alias("track_id"), o["states"].alias("states")
            ),
        ).alias("objects"),
    )
