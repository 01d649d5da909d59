"""Structured Streaming forms of two batch operators over a live detection stream."""

from __future__ import annotations

import uuid
from bisect import insort
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from trackloom.session import shared_dir

#: Time of the end mark of a finished stream.
FAR = datetime(2999, 1, 1, tzinfo=timezone.utc)
EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_trigger: int = 64) -> DataFrame:
    """Detections as they arrive: the event files of a folder."""
    rows = (
        spark.readStream.schema(EVENTS)
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )
    return stream_points(rows)


def stream_points(events: DataFrame) -> DataFrame:
    """Fused centre of every event that a sensor saw (stateless)."""
    e = F.col("event_id")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("double")
    rgb, th = e % 7 != 0, e % 5 != 0
    tx, ty = F.col("value") + (e % 11 - 5) * 0.5, k + (e % 9 - 4) * 0.25
    both = rgb & th
    return events.where(rgb | th).select(
        F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string"), F.lit(":"), F.col("user_id").cast("string")).alias("sample_id"),
        F.concat(F.lit("s"), (F.col("user_id") % 8).cast("string")).alias("sequence"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        F.when(both, (F.col("value") + tx) / 2).when(rgb, F.col("value")).otherwise(tx).alias("cx"),
        F.when(both, (k + ty) / 2).when(rgb, k).otherwise(ty).alias("cy"),
        rgb.alias("has_rgb"),
        th.alias("has_thermal"),
    )


def window_coverage(points: DataFrame, size: str = "8 days", slide: str = "4 days", late: str | None = "1 day") -> DataFrame:
    """Coverage counts per sequence and sliding time window; late rows end at the watermark.

    The same code runs on a stream and, with ``late=None``, on a finished table.
    """
    rows = points if late is None else points.withWatermark("ts", late)
    one = F.lit(1)
    counts = rows.groupBy(F.window("ts", size, slide).alias("w"), "sequence").agg(
        F.count(one).alias("points"),
        F.count(F.when(F.col("has_rgb") & F.col("has_thermal"), one)).alias("paired_points"),
        F.count(F.when(F.col("has_rgb") & ~F.col("has_thermal"), one)).alias("rgb_only_points"),
        F.count(F.when(~F.col("has_rgb") & F.col("has_thermal"), one)).alias("thermal_only_points"),
    )
    return counts.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "sequence",
        "points",
        "paired_points",
        "rgb_only_points",
        "thermal_only_points",
    )


def window_mass(points: DataFrame, shares: DataFrame, size: str = "8 days", slide: str = "4 days", late: str | None = "1 day") -> DataFrame:
    """Score mass per sequence and sliding time window of a stream joined with a table of shares (sample_id, share).

    A detection that arrives again within the watermark counts once; tracks without a share carry none.  The same code runs on a
    stream and, with ``late=None``, on a finished table.
    """
    if late is None:
        rows = points.dropDuplicates(["event_id"])
    else:
        rows = points.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    mass = rows.join(shares, "sample_id").groupBy(F.window("ts", size, slide).alias("w"), "sequence").agg(
        F.sum("share").alias("mass"), F.count(F.lit(1)).alias("points")
    )
    return mass.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "sequence", "points", "mass")


STATE = "x double, y double, history array<double>"
CHANGES = "sample_id string, event_id long, step double, change double"


def step_changes(history: int | None = None, idle_ms: int | None = None):
    """Step from the track's last centre and its change against the median of the earlier steps.

    State per track: the last centre and its earlier steps, or the last ``history`` of them if the caller
    bounds the memory; with ``idle_ms`` of event time a silent track is forgotten.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        x, y, past = state.get if state.exists else (None, None, [])
        past = list(past)
        rows = pd.concat(list(batches)).sort_values("event_id")
        ordered = sorted(past)
        steps, changes = [], []
        for cx, cy in zip(rows["cx"], rows["cy"]):
            step = 0.0 if x is None else float(np.hypot(cx - x, cy - y))
            change = 0.0
            if x is not None and ordered:
                n = len(ordered)
                base = (ordered[(n - 1) // 2] + ordered[n // 2]) / 2
                change = abs(step - base) if base <= 0 else abs(step / base - 1.0)
            if x is not None:
                past.append(step)
                insort(ordered, step)
                if history is not None and len(past) > history:
                    ordered.remove(past.pop(0))
            x, y = float(cx), float(cy)
            steps.append(step)
            changes.append(change)
        state.update((x, y, past))
        if idle_ms is not None:
            latest = int(rows["ts"].max().timestamp() * 1000)
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"sample_id": key[0], "event_id": rows["event_id"], "step": steps, "change": changes})

    return update


def track_changes(points: DataFrame, late: str = "1 day", history: int | None = None, idle_ms: int | None = None) -> DataFrame:
    """Online step changes over all earlier steps of a track; see ``step_changes`` for bounds on the state."""
    timeout = GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.EventTimeTimeout
    return (
        points.withWatermark("ts", late)
        .select("sample_id", "event_id", "ts", "cx", "cy")
        .groupBy("sample_id")
        .applyInPandasWithState(step_changes(history, idle_ms), CHANGES, STATE, "append", timeout)
    )


def run_to_table(stream: DataFrame, base: str | None = None) -> DataFrame:
    """Run a stream over what is there now into a table of the shared folder and read it.

    A second run with the same ``base`` goes on where the first one ended.
    """
    spark = stream.sparkSession
    base = base or _base(spark)
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", f"{base}/checkpoint")
        .option("path", f"{base}/table")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/table")


def _base(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def finished_coverage(spark: SparkSession, folder: str, **windows: str) -> DataFrame:
    """``window_coverage`` of a stream that has ended, with the windows that were still open at its end."""
    return finished(event_stream(spark, folder), lambda points: window_coverage(points, **windows))


def finished_mass(spark: SparkSession, folder: str, shares: DataFrame, **windows: str) -> DataFrame:
    """``window_mass`` of a stream that has ended."""
    return finished(event_stream(spark, folder), lambda points: window_mass(points, shares, **windows))


def finished(points: DataFrame, windowed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A windowed aggregate of a stream that has ended.

    The points flow together with a stream of end marks.  After the points a mark far in the future moves the watermark
    past all windows, so a second run of the same query emits the rest; the mark's own windows stay open.
    """
    spark = points.sparkSession
    base = _base(spark)
    marks = f"{base}/marks"
    spark.createDataFrame([], points.schema).write.parquet(marks)
    ends = spark.readStream.schema(points.schema).parquet(marks)
    counted = windowed(points.unionByName(ends))
    run_to_table(counted, base)
    end = points.schema.fieldNames().index("ts")
    row = [None] * len(points.schema)
    row[end] = FAR
    spark.createDataFrame([tuple(row)], points.schema).write.mode("append").parquet(marks)
    return run_to_table(counted, base)
