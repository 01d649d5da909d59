"""Sinks: flat CSV and JSONL, nested documents, split tables, model inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.scale import row_positions
from trackloom.sources.documents import assemble_tracks, assemble_windows


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("nullValue", "").csv(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_tracks(observations: DataFrame, path: str) -> None:
    assemble_tracks(observations).write.json(path)


def write_windows(states: DataFrame, path: str) -> None:
    assemble_windows(states).write.json(path)


def write_by_split(df: DataFrame, path: str) -> None:
    """Parquet partitioned by split, so that a reader of one split skips the rest."""
    df.write.partitionBy("split").parquet(path)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("split") == split)


def cell_tokens(points: DataFrame, grid: float) -> DataFrame:
    """Grid cell of every centre as a token, e.g. ``cell_3_-1``."""
    cell = lambda c: F.floor(F.col(c) / grid).cast("string")
    return points.select(
        "sample_id", "frame_id", F.concat_ws("_", F.lit("cell"), cell("cx"), cell("cy")).alias("token")
    )


def token_vocabulary(tokens: DataFrame) -> DataFrame:
    """Every token with a dense id in text order."""
    named = tokens.select("token").distinct()
    return row_positions(named, [], [("token", True)], out="token_id").select("token", "token_id")


def trajectory_ids(points: DataFrame) -> DataFrame:
    """Samples renumbered 0, 1, ... in order of their id."""
    named = points.select("sample_id").distinct()
    return row_positions(named, [], [("sample_id", True)], out="trajectory_id").select("sample_id", "trajectory_id")


def padded_centers(points: DataFrame, size: int) -> DataFrame:
    """The first ``size`` centres per track as one flat list, the last one repeated; ``length`` and ``truncated`` tell what was cut.

    ``size`` is the model's input width; the row_number filter prunes before the shuffle.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("sample_id").orderBy("frame_id")
    head = points.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= size)
    sizes = points.groupBy("sample_id").agg(F.count(F.lit(1)).alias("length"))
    rows = head.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("frame_id", "cx", "cy"))).alias("_p"))
    pad = F.array_repeat(F.element_at("_p", -1), F.greatest(F.lit(size) - F.size("_p"), F.lit(0)))
    return rows.join(sizes, "sample_id").select(
        "sample_id",
        F.flatten(F.transform(F.concat("_p", pad), lambda p: F.array(p["cx"], p["cy"]))).alias("values"),
        "length",
        (F.col("length") > size).alias("truncated"),
    )
