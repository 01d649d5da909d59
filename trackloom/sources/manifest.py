"""Annotation manifests: annotations joined with images and videos by whatever keys a data set happens to have, and paired over two sensors.

Every record is one JSON object kept as a map of texts, since the fields differ from data set to data set.  A key is found by a cascade of
fallbacks in one projection over one left join: sequence by name fields of the annotation or the image, by the video, by folders of the
file name; track by four id fields, then the annotation's own id; frame by four fields of the image or the annotation, then by the file name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Field names in the order in which they are tried.
NAME_FIELDS = ["sequence", "seq", "video", "video_name"]
VIDEO_FIELDS = ["name", "file_name", "video_name", "id"]
TRACK_FIELDS = ["track_id", "instance_id", "object_id", "target_id", "id"]
FRAME_FIELDS = ["frame_id", "frame", "frame_index", "frame_number"]
SENSOR_FOLDERS = ["00", "01"]
KEY = ["sequence", "track_id", "frame_id"]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``record`` (map of texts) of every line of JSON-lines files; nested values stay JSON text, lines that are no objects go."""
    rows = spark.read.text(path).select(F.from_json("value", "map<string,string>").alias("record"))
    return rows.where(F.col("record").isNotNull())


def _first(record: str, fields: Sequence[str]) -> Column:
    """The first field that is present and not empty."""
    return F.coalesce(*[F.nullif(F.col(record)[f], F.lit("")) for f in fields])


def _name(value: Column) -> Column:
    """Forward slashes, no slashes at the ends, without a last folder of a sensor."""
    slashed = F.regexp_replace(F.replace(value, F.lit("\\"), F.lit("/")), "^/+|/+$", "")
    return F.regexp_replace(slashed, f"/({'|'.join(SENSOR_FOLDERS)})$", "")


def _whole(value: Column) -> Column:
    """The text as a whole number, or null."""
    return F.when(value.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(value).cast("long"))


def annotation_records(annotations: DataFrame, images: DataFrame, videos: DataFrame, order: str = "id") -> DataFrame:
    """``sequence``, ``track_id``, ``frame_id``, ``x``, ``y``, ``w``, ``h``, ``cx``, ``cy``: the first annotation of every key.

    Inputs have ``record`` maps.  First is the smallest ``order`` field (a number; records without one come last, by their JSON text).  Of images or videos of one id one
    counts (the largest JSON text).  Annotations whose sequence, track or frame can't be found are left out; a box of fewer than
    four finite numbers is null.
    """

    def by_id(df: DataFrame, name: str) -> DataFrame:
        known = df.where(F.col("record")["id"].isNotNull())
        return known.groupBy(F.col("record")["id"].alias(f"_{name}_id")).agg(F.max_by("record", F.to_json("record")).alias(name))

    rows = annotations.select(F.col("record").alias("a")).join(
        by_id(images, "image").withColumnRenamed("image", "i"), F.col("a")["image_id"] == F.col("_image_id"), "left"
    )
    video = F.coalesce(F.col("i")["video_id"], F.col("a")["video_id"])
    rows = rows.withColumn("_video", video).join(by_id(videos, "video").withColumnRenamed("video", "v"), F.col("_video") == F.col("_video_id"), "left")
    named = F.coalesce(*[F.coalesce(F.nullif(F.col("a")[f], F.lit("")), F.nullif(F.col("i")[f], F.lit(""))) for f in NAME_FIELDS])
    file = F.coalesce(F.nullif(F.col("i")["file_name"], F.lit("")), F.nullif(F.col("a")["file_name"], F.lit("")))
    parts = F.filter(F.split(file, "/"), lambda p: (p != "") & (p != "."))
    n = F.size(parts)
    folder = F.when((n >= 3) & F.get(parts, n - 2).isin(SENSOR_FOLDERS), F.get(parts, n - 3)).when(n >= 2, F.get(parts, F.lit(0)))
    frames = [_whole(F.when(F.map_contains_key("i", F.lit(f)), F.col("i")[f]).otherwise(F.col("a")[f])) for f in FRAME_FIELDS]
    stem = F.regexp_replace(F.element_at(parts, -1), r"(.)\.[^.]*$", "$1")
    box = F.from_json(F.col("a")["bbox"], "array<string>")
    sides = [F.get(box, F.lit(k)).try_cast("double") for k in range(4)]
    good = F.lit(True)
    for side in sides:
        good = good & side.isNotNull() & ~F.isnan(side) & (F.abs(side) < float("inf"))
    x, y, w, h = (F.when(good, side) for side in sides)
    found = rows.select(
        _name(F.coalesce(named, _first("v", VIDEO_FIELDS), folder)).alias("sequence"),
        _first("a", TRACK_FIELDS).alias("track_id"),
        F.coalesce(*frames, _whole(stem)).alias("frame_id"),
        F.struct(x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), (x + w / 2).alias("cx"), (y + h / 2).alias("cy")).alias("_box"),
        F.struct(F.coalesce(F.col("a")[order].try_cast("double"), F.lit(float("inf"))), F.to_json("a")).alias("_order"),
    )
    keyed = found.where(F.col("sequence").isNotNull() & F.col("track_id").isNotNull() & F.col("frame_id").isNotNull())
    return keyed.groupBy(*KEY).agg(F.min_by("_box", "_order").alias("_b")).select(*KEY, "_b.*")


def manifest(rgb: DataFrame, thermal: DataFrame, paired: bool = False) -> DataFrame:
    """Records of both sensors by key, all of them or only the keys that both have; ``has_rgb``, ``has_thermal`` and both centres."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*KEY, F.lit(True).alias(f"has_{name}"), F.col("cx").alias(f"{name}_cx"), F.col("cy").alias(f"{name}_cy"))

    met = side(rgb, "rgb").join(side(thermal, "thermal"), KEY, "inner" if paired else "full")
    return met.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("has_rgb", "has_thermal")})


def manifest_summary(pairs: DataFrame) -> DataFrame:
    """Keys, pairs and coverage of both sensors per sequence."""
    one = F.lit(1)
    both = F.col("has_rgb") & F.col("has_thermal")
    counts = pairs.groupBy("sequence").agg(
        F.count(one).alias("num_observation_keys"),
        F.count(F.when(F.col("has_rgb"), one)).alias("num_rgb_annotations"),
        F.count(F.when(F.col("has_thermal"), one)).alias("num_thermal_annotations"),
        F.count(F.when(both, one)).alias("num_paired_annotations"),
    )
    share = {
        f"{n}_annotation_coverage": F.col(f"num_{n}_annotations") / F.col("num_observation_keys") for n in ("rgb", "thermal", "paired")
    }
    return counts.withColumns(share)
