"""File sources: observation CSV, annotation JSON, MOT trees, JSONL, scores, logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.operators.report import first_present, normalize_sequence_name

OBSERVATION_SCHEMA = (
    "sample_id string, sequence string, track_id string, frame_id int, event_id long, category_name string, "
    "rgb_cx double, rgb_cy double, thermal_cx double, thermal_cy double, w double, h double"
)
POINT = "struct<frame_id:int,rgb:struct<x:double,y:double>,thermal:struct<x:double,y:double>>"
TRACK_SCHEMA = f"sample_id string, sequence string, track_id string, category_name string, part long, points array<{POINT}>"
WINDOW_SCHEMA = (
    "window_id string, sequence string, frame_start int, frame_end int, part int, "
    f"objects array<struct<sample_id:string,track_id:string,states:array<{POINT}>>>"
)

# Column names external score files use, and MOT profiles.
ID_COLUMNS = ["sample_id", "trajectory_id", "track_id", "id"]
SCORE_COLUMNS = ["score", "anomaly_score", "final_score", "cetrajad_score", "nll", "log_perplexity"]
VISIBILITY_PROFILES = ["motchallenge", "m3ot", "dancetrack", "sportsmot"]
SINGLE_CATEGORY_PROFILES = ["dancetrack", "sportsmot"]


def read_observations(
    spark: SparkSession, path: str, sequence: str | None = None, track_id: str | None = None
) -> DataFrame:
    """Wide observation CSV; empty text is null, rows without a frame are dropped."""
    rows = (
        spark.read.schema(OBSERVATION_SCHEMA).option("header", True).option("nullValue", "").csv(path)
    ).where(F.col("frame_id").isNotNull())
    if sequence is not None:
        rows = rows.where(F.col("sequence") == sequence)
    if track_id is not None:
        rows = rows.where(F.col("track_id") == track_id)
    return rows


def read_annotations(
    spark: SparkSession, path: str, modality: str, track_field: str = "track_id", include_ignored: bool = False
) -> DataFrame:
    """Detections of one annotation file (images, videos, annotations, categories).

    A single JSON document is read by one task by nature of the format; everything
    after the explode is spread again.  Annotations without an image or a track are
    dropped, and the last annotation of a key wins.
    """
    schema = (
        "images array<struct<id:long,video_id:long,frame_id:int,mot_frame_id:int,file_name:string>>, "
        "videos array<struct<id:long,name:string,fps:double>>, "
        f"annotations array<struct<id:long,image_id:long,{track_field}:string,bbox:array<double>,category_id:int,ignore:int,iscrowd:int>>, "
        "categories array<struct<id:int,name:string>>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    part = lambda name: doc.select(F.explode(name).alias("r")).select("r.*")
    images = part("images").select(
        F.col("id").alias("image_id"), "video_id", F.coalesce("mot_frame_id", "frame_id", F.lit(0)).alias("frame_id"), "file_name"
    )
    videos = part("videos").select(F.col("id").alias("video_id"), "name", "fps")
    categories = part("categories").select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    rows = part("annotations").repartition("image_id")
    if not include_ignored:
        rows = rows.where((F.coalesce("ignore", F.lit(0)) == 0) & (F.coalesce("iscrowd", F.lit(0)) == 0))
    joined = (
        rows.where(F.col(track_field).isNotNull())
        .join(images, "image_id")
        .join(videos, "video_id", "left")
        .join(categories, "category_id", "left")
    )
    named = F.nullif(normalize_sequence_name(F.col("name")), F.lit(""))
    box = F.struct(*[F.get("bbox", F.lit(i)).alias(c) for i, c in enumerate(("x", "y", "w", "h"))])
    detections = joined.select(
        F.lit(modality).alias("modality"),
        F.coalesce(named, F.split(normalize_sequence_name(F.col("file_name")), "/")[0]).alias("sequence"),
        F.col(track_field).alias("track_id"),
        "frame_id",
        F.col("id").alias("event_id"),
        F.coalesce("category_name", F.col("category_id").cast("string")).alias("category_name"),
        "fps",
        box.alias("b"),
    )
    keys = ["modality", "sequence", "track_id", "frame_id"]
    last = detections.groupBy(*keys).agg(F.max_by(F.struct("event_id", "category_name", "fps", "b"), "event_id").alias("r"))
    return last.select(*keys, "r.event_id", "r.category_name", "r.fps", "r.b.*")


def read_mot_tree(
    spark: SparkSession,
    root: str,
    profile: str = "motchallenge",
    split: str | None = None,
    fps: float | None = None,
    keep_categories: Sequence[int] | None = (1,),
    include_ignored: bool = False,
    name_source: str = "directory",
) -> DataFrame:
    """Detections of every ``<sequence>/gt/gt.txt`` below a folder.

    Lines with a ``#`` are comments; at least seven columns are needed.  ``fps``,
    image folder and extension come from ``seqinfo.ini`` beside ``gt``.
    """
    if name_source not in ("directory", "seqinfo", "relative"):
        raise ValueError("name_source must be directory, seqinfo or relative")
    columns = ["frame", "track", "left", "top", "width", "height", "conf", "category", "visibility"]
    lines = (
        spark.read.schema(", ".join(f"{c} string" for c in columns))
        .option("comment", "#")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "gt.txt")
        .option("ignoreLeadingWhiteSpace", True)
        .csv(root)
        .withColumn("_path", F.col("_metadata.file_path"))
    )
    folder = F.regexp_extract("_path", "^(.*)/gt/gt\\.txt$", 1)
    rows = lines.where(F.col("_path").rlike("/gt/gt\\.txt$")).withColumn("_dir", folder)
    if split:
        rows = rows.where(F.col("_dir").contains(f"/{split}/"))
    info = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "seqinfo.ini")
        .text(root)
        .select(
            F.regexp_extract(F.col("_metadata.file_path"), "^(.*)/seqinfo\\.ini$", 1).alias("_dir"),
            F.lower(F.trim(F.regexp_extract("value", "^([^=]+)=", 1))).alias("_key"),
            F.trim(F.regexp_extract("value", "=(.*)$", 1)).alias("_value"),
        )
    )
    pick = lambda k: F.max(F.when(F.col("_key") == k, F.col("_value")))
    info = info.groupBy("_dir").agg(
        pick("name").alias("_name"),
        F.coalesce(pick("fps"), pick("framerate")).cast("double").alias("_fps"),
        pick("imdir").alias("_imdir"),
        pick("imext").alias("_imext"),
    )
    joined = rows.join(info, "_dir", "left")
    last_part = F.element_at(F.split("_dir", "/"), -1)
    names = {
        "directory": last_part,
        "seqinfo": F.coalesce("_name", last_part),
        "relative": F.regexp_replace("_dir", f"^.*{root.rstrip('/')}/", ""),
    }
    number = lambda c: F.col(c).try_cast("double")
    category = F.lit(1) if profile in SINGLE_CATEGORY_PROFILES else number("category").cast("int")
    visibility = number("visibility") if profile in VISIBILITY_PROFILES else F.lit(None).cast("double")
    digits = 8 if profile == "dancetrack" else 6
    out = joined.select(
        names[name_source].alias("sequence"),
        number("track").cast("long").cast("string").alias("track_id"),
        number("frame").cast("int").alias("frame_id"),
        number("left").alias("x"),
        number("top").alias("y"),
        number("width").alias("w"),
        number("height").alias("h"),
        number("conf").alias("confidence"),
        category.alias("category_id"),
        visibility.alias("visibility"),
        (F.lit(float(fps)) if fps is not None else F.col("_fps")).alias("fps"),
        F.when(
            F.col("_imdir").isNotNull(),
            F.concat(
                names[name_source], F.lit("/"), F.col("_imdir"), F.lit("/"),
                F.format_string(f"%0{digits}d", number("frame").cast("int")), F.coalesce("_imext", F.lit(".jpg")),
            ),
        ).alias("file"),
        F.assert_true(F.col("conf").isNotNull(), F.concat(F.lit("fewer than seven columns in "), F.col("_path"))).alias("_bad"),
    )
    return filter_detections(out.where(F.col("_bad").isNull()).drop("_bad"), keep_categories, include_ignored)


def filter_detections(
    detections: DataFrame, keep_categories: Sequence[int] | None = None, include_ignored: bool = False
) -> DataFrame:
    """Drop detections without confidence (unless asked) and of other categories."""
    rows = detections
    if not include_ignored:
        rows = rows.where(F.col("confidence").isNull() | (F.col("confidence") > 0))
    if keep_categories is not None:
        rows = rows.where(F.col("category_id").isNull() | F.col("category_id").isin(list(keep_categories)))
    return rows


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Track documents (one JSON per line) exploded to observations."""
    docs = spark.read.schema(TRACK_SCHEMA).json(path)
    rows = docs.select("sample_id", "sequence", "track_id", "category_name", F.explode("points").alias("p"))
    return rows.select(
        "sample_id",
        "sequence",
        "track_id",
        "category_name",
        "p.frame_id",
        F.col("p.rgb.x").alias("rgb_cx"),
        F.col("p.rgb.y").alias("rgb_cy"),
        F.col("p.thermal.x").alias("thermal_cx"),
        F.col("p.thermal.y").alias("thermal_cy"),
    )


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Window documents exploded to one row per (window, object, frame) that has a sensor."""
    docs = spark.read.schema(WINDOW_SCHEMA).json(path)
    objects = docs.select("window_id", "sequence", "frame_start", "frame_end", F.explode("objects").alias("o"))
    states = objects.select(
        "window_id", "sequence", "frame_start", "frame_end", "o.sample_id", "o.track_id", F.explode("o.states").alias("p")
    )
    return states.select(
        "window_id",
        "sequence",
        "frame_start",
        "frame_end",
        "sample_id",
        "track_id",
        "p.frame_id",
        F.col("p.rgb.x").alias("rgb_cx"),
        F.col("p.rgb.y").alias("rgb_cy"),
        F.col("p.thermal.x").alias("thermal_cx"),
        F.col("p.thermal.y").alias("thermal_cy"),
    ).where(F.col("rgb_cx").isNotNull() | F.col("thermal_cx").isNotNull())


def _by_suffix(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    if path.rstrip("/").endswith((".csv", ".tsv")):
        sep = "\t" if path.rstrip("/").endswith(".tsv") else ","
        return reader.option("header", True).option("sep", sep).csv(path)
    if path.rstrip("/").endswith(".jsonl"):
        return reader.json(path)
    return reader.option("multiLine", True).json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label rows from CSV or JSONL with integer frames, label and seed."""
    rows = _by_suffix(spark, path)
    whole = lambda c: F.col(c).try_cast("double").cast("int").alias(c)
    numbers = {"frame_start", "frame_end", "label", "injection_seed"}
    return rows.select(*[whole(c) if c in numbers else F.col(c) for c in rows.columns])


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score rows from CSV or JSONL with a double score."""
    rows = _by_suffix(spark, path)
    return rows.withColumn("score", F.col("score").try_cast("double"))


def read_external_scores(
    spark: SparkSession,
    path: str,
    source: str,
    sidecar: DataFrame | None = None,
    score_column: str | None = None,
    id_column: str | None = None,
) -> DataFrame:
    """Scores of another tool: find its id and score columns, map ids by a sidecar.

    Several candidate score columns are an error, and so is an id without sidecar row.
    """
    rows = _by_suffix(spark, path)
    ids = [id_column] if id_column else [c for c in ID_COLUMNS if c in rows.columns]
    found = [score_column] if score_column else [c for c in SCORE_COLUMNS if c in rows.columns]
    if not ids or ids[0] not in rows.columns:
        raise ValueError(f"{path} has none of the id columns {ID_COLUMNS}")
    if len(found) != 1 or found[0] not in rows.columns:
        raise ValueError(f"{path} needs exactly one score column, found {found}")
    key = ids[0]
    named = rows.select(F.col(key).cast("string").alias(key), F.col(found[0]).try_cast("double").alias("score"))
    if sidecar is not None and key != "sample_id":
        side = sidecar.select(F.col(key).cast("string").alias(key), "sample_id").dropDuplicates([key])
        named = named.join(side, key, "left")
        sample = F.coalesce("sample_id", F.raise_error(F.concat(F.lit("no sidecar row for "), F.col(key))).cast("string"))
    else:
        sample = first_present(named, [key])
    return named.select(sample.alias("sample_id"), "score", F.lit(source).alias("source"))


def read_pose_log(spark: SparkSession, path: str) -> DataFrame:
    """``i j n`` headers followed by four matrix lines: (file, i, j, pose of twelve numbers)."""
    text = spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("file"), F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "").alias("lines")
    )
    rows = text.select("file", F.posexplode("lines").alias("line", "value"))
    numbers = F.transform(F.split(F.trim("value"), "\\s+"), lambda v: v.try_cast("double"))
    tagged = rows.select(
        "file", F.floor(F.col("line") / 5).alias("block"), (F.col("line") % 5).alias("row"), numbers.alias("numbers")
    )
    # five rows per block
    blocks = tagged.groupBy("file", "block").agg(F.sort_array(F.collect_list(F.struct("row", "numbers"))).alias("b"))
    head = F.get("b", F.lit(0))["numbers"]
    body = F.flatten(F.transform(F.slice("b", 2, 3), lambda r: r["numbers"]))
    return blocks.select(
        "file",
        head[0].cast("int").alias("i"),
        head[1].cast("int").alias("j"),
        F.when((F.size("b") == 5) & (F.size(body) == 12), body).alias("pose"),
    )


def read_metric_files(spark: SparkSession, path: str) -> DataFrame:
    """Metric JSON documents below a folder, one row per file."""
    return spark.read.option("recursiveFileLookup", True).option("multiLine", True).option(
        "pathGlobFilter", "*.json"
    ).json(path)


def read_pair_results(spark: SparkSession, path: str) -> DataFrame:
    """Rows of ``pair_results`` of a registration summary."""
    schema = (
        "pair_results array<struct<method:string,batch_idx:int,sample_idx:int,group_ref_idx:int,rotation_error_deg:double,"
        "translation_error:double,chamfer_distance:double,runtime_sec:double,success:boolean,skipped:boolean>>"
    )
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return doc.select(F.explode("pair_results").alias("r")).select("r.*")


def read_image_places(spark: SparkSession, path: str, pattern: str = "*.jpg") -> DataFrame:
    """Image paths with the coordinates in their names (``@east@north@...``); contents unread."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    ).select("path")
    parts = F.split("path", "@")
    return files.select("path", parts[1].cast("double").alias("x"), parts[2].cast("double").alias("y"))


def coerce_points(value: Column, limit: int | None = None) -> Column:
    """A JSON list of triples as finite (x, y, z) points; a preview asks for the first ``limit`` of them."""
    triples = F.from_json(value, "array<array<double>>")
    shaped = F.transform(triples, lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"), F.get(p, F.lit(2)).alias("z")))

    def good(p):
        each = [p[a].isNotNull() & ~F.isnan(p[a]) & (F.abs(p[a]) < float("inf")) for a in ("x", "y", "z")]
        return each[0] & each[1] & each[2]

    points = F.filter(shaped, good)
    return points if limit is None else F.slice(points, 1, limit)
