"""Adapters from the driver's parquet tables to the track data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FRAME_SECONDS = 43200
SEQUENCES = 8


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as detections, one row per event, several per frame possible.

    A user is a track, eight users share a sequence round-robin, half a day is a
    frame.  The two sensors see an event at slightly different places and each
    misses some of them.
    """
    events = read_table(spark, sf_dir, "events")
    seconds = F.expr(
        "CAST(CAST(CAST(ts AS TIMESTAMP_NTZ) - TIMESTAMP_NTZ'2024-01-01 00:00:00' AS INTERVAL SECOND) AS BIGINT)"
    )
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("int").cast("double")
    base = events.select(
        F.concat(F.lit("s"), (F.col("user_id") % SEQUENCES).cast("string")).alias("sequence"),
        F.col("user_id").cast("string").alias("track_id"),
        F.floor(seconds / FRAME_SECONDS).cast("int").alias("frame_id"),
        "event_id",
        F.col("event_type").alias("category_name"),
        F.col("value").alias("px"),
        k.alias("py"),
    )
    e = F.col("event_id")
    rgb, thermal = e % 7 != 0, e % 5 != 0
    return base.select(
        "sequence",
        "track_id",
        "frame_id",
        "event_id",
        "category_name",
        F.when(rgb, F.col("px")).alias("rgb_cx"),
        F.when(rgb, F.col("py")).alias("rgb_cy"),
        F.when(thermal, F.col("px") + (e % 11 - 5) * 0.5).alias("thermal_cx"),
        F.when(thermal, F.col("py") + (e % 9 - 4) * 0.25).alias("thermal_cy"),
        (4 + e % 6).cast("double").alias("w"),
        (4 + e % 5).cast("double").alias("h"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide observations: the first event of a (sequence, track, frame) wins."""
    raw = raw_detections(spark, sf_dir)
    keys = ["sequence", "track_id", "frame_id"]
    rest = [c for c in raw.columns if c not in keys]
    first = raw.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col("event_id")).alias("r"))
    return first.select(
        F.concat_ws(":", "sequence", "track_id").alias("sample_id"), *keys, *[f"r.{c}" for c in rest]
    )


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long detections: one row per event and sensor that saw it."""
    raw = raw_detections(spark, sf_dir)
    half = {
        m: F.struct(
            F.lit(m).alias("modality"),
            (F.col(f"{m}_cx") - F.col("w") / 2).alias("x"),
            (F.col(f"{m}_cy") - F.col("h") / 2).alias("y"),
            F.col("w").alias("w"),
            F.col("h").alias("h"),
        )
        for m in ("rgb", "thermal")
    }
    return (
        raw.withColumn("d", F.explode(F.array(half["rgb"], half["thermal"])))
        .where(F.col("d.x").isNotNull())
        .select("sequence", "track_id", "frame_id", "event_id", "category_name", "d.*")
    )


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("vector"), "label"
    )
