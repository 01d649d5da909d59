"""Queries that go through files, streams, registries and model-input exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from trackloom.operators import detectors, evaluate, matrix, motion, protocol, ranks, registry, report, windows
from trackloom.plans import oracle as sql
from trackloom.plans.detector_queries import points
from trackloom.plans.protocol_queries import _CURVE, _HAND, _INJECTED, FRACTION, METHODS, injected
from trackloom.plans.registry import query, select
from trackloom.session import materialize, shared_dir
from trackloom.sources import manifest, readers, sinks
from trackloom.sources.documents import assemble_windows
from trackloom.sources.tables import observations, raw_detections, read_table
from trackloom.streaming import live, state


def scratch(spark, suffix: str = "") -> str:
    return f"{shared_dir(spark)}/file-{uuid.uuid4().hex}{suffix}"


_OBS_COLS = "sample_id, sequence, track_id, frame_id, ~rgb_cx, ~rgb_cy, ~thermal_cx, ~thermal_cy"
_OBS_NAMES = ["sample_id", "sequence", "track_id", "frame_id", "rgb_cx", "rgb_cy", "thermal_cx", "thermal_cy"]


@query("csv_observations", select(_OBS_COLS + ", category_name, event_id", "obs", sql.BASE))
def csv_observations(spark, sf):
    """Observations written as CSV and scanned again."""
    path = scratch(spark)
    names = [f.split()[0] for f in readers.OBSERVATION_SCHEMA.split(", ")]
    sinks.write_csv(observations(spark, sf).select(*names), path)
    return readers.read_observations(spark, path).select(*_OBS_NAMES, "category_name", "event_id")


@query("csv_one_sequence", select(_OBS_COLS, "obs", sql.BASE, "WHERE sequence = 's3'"))
def csv_one_sequence(spark, sf):
    path = scratch(spark)
    names = [f.split()[0] for f in readers.OBSERVATION_SCHEMA.split(", ")]
    sinks.write_csv(observations(spark, sf).select(*names), path)
    return readers.read_observations(spark, path, sequence="s3").select(*_OBS_NAMES)


@query("jsonl_tracks", select(_OBS_COLS, "obs", sql.BASE))
def jsonl_tracks(spark, sf):
    """Track documents written as JSON lines and exploded again."""
    path = scratch(spark)
    sinks.write_tracks(observations(spark, sf), path)
    return readers.read_tracks(spark, path).select(*_OBS_NAMES)


@query(
    "jsonl_windows",
    select(
        "window_id, frame_start, frame_end, sample_id, frame_id, ~rgb_cx, ~rgb_cy, ~thermal_cx, ~thermal_cy",
        "wstates",
        sql.WINDOWED,
    ),
)
def jsonl_windows(spark, sf):
    path = scratch(spark)
    sinks.write_windows(materialize(windows.window_states(observations(spark, sf))), path)
    return readers.read_windows(spark, path).drop("sequence", "track_id")


@query(
    "window_documents",
    select(
        "window_id, count(*) AS num_objects, min(nf) AS num_states",
        "wobj JOIN (SELECT window_id, count(DISTINCT frame_id) AS nf FROM wstates0 JOIN (SELECT window_id, track_id FROM wobj) o USING (window_id, track_id) GROUP BY window_id) f USING (window_id)",
        sql.WINDOWED,
        "GROUP BY window_id",
    ),
)
def window_documents(spark, sf):
    """Objects per window document, each with one state per frame of the window."""
    docs = assemble_windows(materialize(windows.window_states(observations(spark, sf))))
    objects = docs.select("window_id", F.explode("objects").alias("o"))
    return objects.groupBy("window_id").agg(
        F.count(F.lit(1)).alias("num_objects"), F.min(F.size("o.states")).cast("long").alias("num_states")
    )


@query(
    "score_file",
    select("sample_id, window_id, ~score", "pred", [*sql.WINDOWED, sql.PREDICTION]),
)
def score_file(spark, sf):
    path = scratch(spark, ".jsonl")
    predicted = windows.linear_prediction(windows.window_points(observations(spark, sf)))
    sinks.write_jsonl(predicted.select("sample_id", "window_id", "score"), path)
    return readers.read_scores(spark, path).select("sample_id", "window_id", "score")


@query("label_file", select("sample_id, frame_start, frame_end, label, anomaly_type", "lab", _HAND))
def label_file(spark, sf):
    path = scratch(spark, ".csv")
    pts, positives = injected(spark, sf)
    sinks.write_csv(protocol.complete_labels(protocol.track_keys(pts), positives), path)
    return readers.read_labels(spark, path).select("sample_id", "frame_start", "frame_end", "label", "anomaly_type")


@query("external_scores", select("sample_id, ~max_speed AS score, 'speed_tool' AS source", "hand", [*sql.MOTION, sql.HANDCRAFTED]))
def external_scores(spark, sf):
    """Another tool scores renumbered tracks; the sidecar maps them back."""
    path = scratch(spark, ".csv")
    features = materialize(motion.handcrafted_features(points(spark, sf)))
    sidecar = materialize(sinks.trajectory_ids(features))
    theirs = features.join(sidecar, "sample_id").select("trajectory_id", F.col("max_speed").alias("anomaly_score"))
    sinks.write_csv(theirs, path)
    return readers.read_external_scores(spark, path, "speed_tool", sidecar)


@query("split_table", select("sample_id, frame_id, split", "fused JOIN split USING (sequence)", [*sql.POINTS, sql.SPLIT], "WHERE split = 'val'"))
def split_table(spark, sf):
    """Points written by split; reading one split prunes the other folders."""
    path = scratch(spark)
    pts = points(spark, sf)
    sinks.write_by_split(protocol.split_rows(pts, protocol.split_sequences(pts)), path)
    return sinks.read_split(spark, path, "val").select("sample_id", "frame_id", "split")


_CELLS = "cells AS (SELECT sample_id, frame_id, 'cell_' || floor(cx / 16)::BIGINT || '_' || floor(cy / 16)::BIGINT AS token FROM fused)"


@query("cell_tokens", select("sample_id, frame_id, token", "cells", [*sql.POINTS, _CELLS]))
def cell_tokens(spark, sf):
    return sinks.cell_tokens(points(spark, sf), 16.0)


@query(
    "token_vocabulary",
    select("token, row_number() OVER (ORDER BY token) - 1 AS token_id", "(SELECT DISTINCT token FROM cells) d", [*sql.POINTS, _CELLS]),
)
def token_vocabulary(spark, sf):
    return sinks.token_vocabulary(sinks.cell_tokens(points(spark, sf), 16.0))


@query(
    "padded_centers",
    select(
        "sample_id, len(xs) AS length, len(xs) > 12 AS truncated, pos - 1 AS slot, ~CASE WHEN pos % 2 = 1 THEN xs[least((pos + 1) // 2, len(xs))] ELSE ys[least((pos + 1) // 2, len(ys))] END AS value",
        "(SELECT *, unnest(generate_series(1, 24)) AS pos FROM (SELECT sample_id, list(cx ORDER BY frame_id) AS xs, list(cy ORDER BY frame_id) AS ys FROM fused GROUP BY sample_id) l) p",
        sql.POINTS,
    ),
)
def padded_centers(spark, sf):
    rows = sinks.padded_centers(points(spark, sf), 12)
    return rows.select("sample_id", "length", "truncated", F.posexplode("values").alias("slot", "value")).withColumn("slot", F.col("slot").cast("long"))


# ------------------------------------------------------------------ manifests
def _written_records(spark, sf, cx, cy):
    """Detections of one sensor as JSON lines in which every fallback of the keys is needed; read back as maps."""
    rows = raw_detections(spark, sf).where(F.col(cx).isNotNull())
    e = F.col("event_id")
    no = F.lit(None).cast("string")
    text = lambda c: F.col(c).cast("string")
    track = {n: F.when(e % 5 == k, text("track_id")) for k, n in enumerate(("track_id", "instance_id", "object_id", "target_id"))}
    named = {n: F.when(e % 7 == k, F.concat(F.lit("/"), "sequence", F.lit("/00"))) for k, n in enumerate(("sequence", "video_name"))}
    box = F.when(e % 9 == 0, F.array(F.lit(1.0))).otherwise(F.array(F.col(cx) - F.col("w") / 2, F.col(cy) - F.col("h") / 2, "w", "h"))
    annotations = rows.select(F.to_json(F.struct(e.alias("id"), e.alias("image_id"), *[c.alias(n) for n, c in {**track, **named}.items()], box.alias("bbox"), F.when(e % 3 == 0, F.col("frame_id")).alias("frame_number"))).alias("value"))
    folder = F.when(e % 2 == 0, F.concat("sequence", F.lit("/x/"))).otherwise(F.concat(F.lit("root/"), "sequence", F.lit("/01/")))
    images = rows.select(F.to_json(F.struct(
        e.alias("id"), F.when(e % 7 == 2, F.concat("sequence", F.lit("\\\\"))).alias("seq"), F.when(e % 7 == 3, F.col("sequence")).alias("video_id"),
        F.when(e % 7 > 3, F.concat(folder, F.lpad(text("frame_id"), 6, "0"), F.lit(".jpg"))).otherwise(F.concat(F.lpad(text("frame_id"), 6, "0"), F.lit(".jpg"))).alias("file_name"),
        F.when(e % 3 == 1, text("frame_id")).alias("frame_index"),
    )).alias("value"))
    videos = rows.select("sequence").distinct().select(F.to_json(F.struct(F.col("sequence").alias("id"), no.alias("name"), F.col("sequence").alias("file_name"))).alias("value"))
    tables = []
    for part in (annotations, images, videos):
        path = scratch(spark)
        part.write.text(path)
        tables.append(manifest.read_records(spark, path))
    return manifest.annotation_records(*tables)


def _record_sql(name: str, cx: str, cy: str) -> str:
    return f"""{name} AS (SELECT sequence, track, frame_id, arg_min(cx, event_id) AS cx, arg_min(cy, event_id) AS cy FROM (SELECT sequence, CASE WHEN event_id % 5 = 4 THEN event_id::VARCHAR ELSE track_id END AS track, frame_id, event_id,
      CASE WHEN event_id % 9 <> 0 THEN {{'v': {cx}}} ELSE {{'v': NULL::DOUBLE}} END AS cx, CASE WHEN event_id % 9 <> 0 THEN {{'v': {cy}}} ELSE {{'v': NULL::DOUBLE}} END AS cy FROM raw WHERE {cx} IS NOT NULL) r GROUP BY ALL)"""


_MANIFEST = [sql.RAW, _record_sql("ra", "rgb_cx", "rgb_cy"), _record_sql("ta", "thermal_cx", "thermal_cy")]


@query(
    "annotation_manifest",
    select(
        """sequence, track AS track_id, frame_id::BIGINT AS frame_id, ra.cx IS NOT NULL AS has_rgb, ta.cx IS NOT NULL AS has_thermal,
        ~ra.cx.v AS rgb_cx, ~ra.cy.v AS rgb_cy, ~ta.cx.v AS thermal_cx, ~ta.cy.v AS thermal_cy""",
        "ra FULL JOIN ta USING (sequence, track, frame_id)",
        _MANIFEST,
    ),
)
def annotation_manifest(spark, sf):
    return manifest.manifest(_written_records(spark, sf, "rgb_cx", "rgb_cy"), _written_records(spark, sf, "thermal_cx", "thermal_cy"))


@query(
    "manifest_summary",
    select(
        """sequence, count(*) AS num_observation_keys, count(ra.cx) AS num_rgb_annotations, count(ta.cx) AS num_thermal_annotations, count(*) FILTER (ra.cx IS NOT NULL AND ta.cx IS NOT NULL) AS num_paired_annotations,
        ~count(ra.cx) / count(*) AS rgb_annotation_coverage, ~count(ta.cx) / count(*) AS thermal_annotation_coverage, ~count(*) FILTER (ra.cx IS NOT NULL AND ta.cx IS NOT NULL) / count(*) AS paired_annotation_coverage""",
        "ra FULL JOIN ta USING (sequence, track, frame_id)",
        _MANIFEST,
        "GROUP BY sequence",
    ),
)
def manifest_summary(spark, sf):
    return manifest.manifest_summary(annotation_manifest(spark, sf))


# ------------------------------------------------------------------ streams
@query(
    "stream_window_coverage",
    """WITH e AS (SELECT ts, 's' || (user_id % 8) AS sequence, event_id % 7 <> 0 AS rgb, event_id % 5 <> 0 AS th FROM events),
    w AS (SELECT *, unnest([d, d - 4]) AS day FROM (SELECT *, (floor(epoch(ts) / 345600) * 4)::BIGINT AS d FROM e WHERE rgb OR th) p)
    SELECT make_timestamp(day * 86400000000) AS window_start, make_timestamp((day + 8) * 86400000000) AS window_end, sequence, count(*) AS points,
      count(*) FILTER (rgb AND th) AS paired_points, count(*) FILTER (rgb AND NOT th) AS rgb_only_points, count(*) FILTER (NOT rgb AND th) AS thermal_only_points
    FROM w GROUP BY ALL""",
)
def stream_window_coverage(spark, sf):
    return live.finished_coverage(spark, sf)


@query(
    "stream_track_changes",
    select(
        """sample_id, event_id, ~coalesce(step, 0) AS step, ~CASE WHEN base IS NULL THEN 0 WHEN base <= 0 THEN abs(step - base) ELSE abs(step / base - 1) END AS change""",
        """(SELECT *, median(step) OVER (PARTITION BY sample_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM
            (SELECT *, sqrt((cx - lag(cx) OVER t)^2 + (cy - lag(cy) OVER t)^2) AS step FROM
              (SELECT sample_id, event_id, CASE WHEN rgb_cx IS NOT NULL AND thermal_cx IS NOT NULL THEN (rgb_cx + thermal_cx) / 2 ELSE coalesce(rgb_cx, thermal_cx) END AS cx,
                      CASE WHEN rgb_cy IS NOT NULL AND thermal_cy IS NOT NULL THEN (rgb_cy + thermal_cy) / 2 ELSE coalesce(rgb_cy, thermal_cy) END AS cy
               FROM raw WHERE rgb_cx IS NOT NULL OR thermal_cx IS NOT NULL) p WINDOW t AS (PARTITION BY sample_id ORDER BY event_id)) s) m""",
        [sql.RAW],
    ),
)
def stream_track_changes(spark, sf):
    return live.run_to_table(live.track_changes(live.event_stream(spark, sf)))


@query(
    "stream_track_states",
    select(
        """sample_id, event_id, ~coalesce(step, 0) AS step, ~coalesce(step / greatest(event_id - before, 1), 0) AS speed,
           ~CASE WHEN base IS NULL THEN 0 WHEN base <= 0 THEN abs(step - base) ELSE abs(step / base - 1) END AS change""",
        """(SELECT *, median(step) OVER (PARTITION BY sample_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM
            (SELECT *, sqrt((cx - lag(cx) OVER t)^2 + (cy - lag(cy) OVER t)^2) AS step, lag(event_id) OVER t AS before FROM
              (SELECT sample_id, event_id, CASE WHEN rgb_cx IS NOT NULL AND thermal_cx IS NOT NULL THEN (rgb_cx + thermal_cx) / 2 ELSE coalesce(rgb_cx, thermal_cx) END AS cx,
                      CASE WHEN rgb_cy IS NOT NULL AND thermal_cy IS NOT NULL THEN (rgb_cy + thermal_cy) / 2 ELSE coalesce(rgb_cy, thermal_cy) END AS cy
               FROM raw WHERE rgb_cx IS NOT NULL OR thermal_cx IS NOT NULL) p WINDOW t AS (PARTITION BY sample_id ORDER BY event_id)) s) m""",
        [sql.RAW],
    ),
)
def stream_track_states(spark, sf):
    """Step, speed and change of every detection from keyed state with a count per step length."""
    with state.stored(spark):
        return live.run_to_table(state.track_states(live.event_stream(spark, sf)))


@query(
    "stream_frame_mass",
    select(
        "make_timestamp(day * 86400000000) AS window_start, make_timestamp((day + 8) * 86400000000) AS window_end, sequence, count(*) AS points, ~sum(share) AS mass",
        """(SELECT *, unnest([d, d - 4]) AS day FROM (SELECT (floor(epoch(ts) / 345600) * 4)::BIGINT AS d, 's' || (user_id % 8) AS sequence, 's' || (user_id % 8) || ':' || user_id AS sample_id
             FROM events WHERE event_id % 7 <> 0 OR event_id % 5 <> 0) e JOIN (SELECT sample_id, score / n AS share FROM ind JOIN
               (SELECT sample_id, count(*) AS n FROM fused GROUP BY ALL) c USING (sample_id)) s USING (sample_id)) w""",
        sql.SIMPLE,
        "GROUP BY day, sequence",
    ),
)
def stream_frame_mass(spark, sf):
    """Every detection carries an equal share of its track's score into its windows."""
    pts = points(spark, sf)
    scores = detectors.simple_track_scores(pts, with_events=False).select("sample_id", "score")
    counts = pts.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    shares = scores.join(counts, "sample_id").select("sample_id", (F.col("score") / F.col("n")).alias("share"))
    return live.finished_mass(spark, sf, materialize(shares))


# ------------------------------------------------------------------ registries
def _registry(spark, sf):
    """Suppliers stand for registered methods, their nation for the task."""
    s = read_table(spark, sf, "supplier")
    return s.select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("task"),
        F.col("s_name").alias("name"),
        F.array(F.concat(F.lit("m"), (F.col("s_suppkey") % 40).cast("string")), F.lower("s_name")).alias("aliases"),
        F.when(F.col("s_acctbal") > 0, F.lit("our_method")).alias("owner"),
    )


_REG = "reg AS (SELECT 'n' || s_nationkey AS task, s_name AS name, 'm' || (s_suppkey % 40) AS alias1, lower(s_name) AS alias2, CASE WHEN s_acctbal > 0 THEN 'our_method' END AS owner FROM supplier)"


@query(
    "registry_violations",
    select(
        "*",
        """(SELECT task, name, 'missing owner' AS problem FROM reg WHERE owner IS NULL
            UNION ALL SELECT task, name, 'duplicate name' FROM reg GROUP BY task, name HAVING count(*) > 1
            UNION ALL SELECT task, alias, 'duplicate alias' FROM (SELECT task, name, alias1 AS alias FROM reg UNION ALL SELECT task, name, alias2 FROM reg) a GROUP BY task, alias HAVING count(DISTINCT name) > 1
            UNION ALL SELECT DISTINCT r.task, a.alias, 'alias is a name' FROM reg r JOIN (SELECT task, name, alias1 AS alias FROM reg UNION ALL SELECT task, name, alias2 FROM reg) a
              ON r.task = a.task AND r.name = a.alias AND a.name <> a.alias) u""",
        [_REG],
    ),
)
def registry_violations(spark, sf):
    return registry.registry_violations(_registry(spark, sf), ["owner"])


@query(
    "registry_lookup",
    select(
        """q.task, q.method, n.name, coalesce(n.owner, CASE WHEN n.name IS NULL THEN 'unregistered' ELSE 'unregistered' END) AS owner, coalesce(n.c, 0) AS candidates""",
        """(SELECT DISTINCT 'n' || c_nationkey AS task, 'm' || (c_custkey % 60) AS method FROM customer) q
           LEFT JOIN (SELECT task, alias1 AS method, min(name) AS name, arg_min(coalesce(owner, 'unregistered'), name) AS owner, count(DISTINCT name) AS c FROM reg GROUP BY ALL) n
           ON q.task = n.task AND q.method = n.method""",
        [_REG],
    ),
)
def registry_lookup(spark, sf):
    c = read_table(spark, sf, "customer")
    requests = c.select(
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("task"),
        F.concat(F.lit("m"), (F.col("c_custkey") % 60).cast("string")).alias("method"),
    ).distinct()
    return registry.lookup(requests, _registry(spark, sf), ["owner"])


@query(
    "override_categories",
    select(
        "method, ~total, coalesce(r, c, '') AS owner",
        """(SELECT c_mktsegment AS method, sum(c_acctbal) AS total, min(c_mktsegment) AS c, CASE WHEN c_mktsegment < 'C' THEN 'our_method' END AS r FROM customer GROUP BY c_mktsegment) s""",
        [],
    ),
)
def override_categories(spark, sf):
    c = read_table(spark, sf, "customer").select(F.col("c_mktsegment").alias("method"), "c_acctbal")
    summary = c.groupBy("method").agg(F.sum("c_acctbal").alias("total"))
    named = c.select("method").distinct()
    theirs = named.withColumn("owner", F.col("method"))
    ours = named.withColumn("owner", F.when(F.col("method") < "C", F.lit("our_method")).otherwise(F.lit("unregistered")))
    return registry.override_categories(summary, theirs, ours, ["owner"])


_GRID = [(f"{a}-{b}-{c}", (a, b, c)) for a in (0, 1, 2) for b in (0, 1, 2) for c in (0, 1, 2) if a + b + c]


@query(
    "score_grid",
    select(
        """method, ~sum(pos * ((total - p) - (predicted - tp) + (n - pos) / 2)) / (max(p) * (max(total) - max(p))) AS auroc""",
        "gcur",
        [
            *_HAND,
            sql.rank01("rr", "hand", "sample_id", METHODS, "sample_id"),
            "w AS (SELECT a, b, c, a || '-' || b || '-' || c AS method FROM (SELECT unnest([0, 1, 2]) AS a) x, (SELECT unnest([0, 1, 2]) AS b) y, (SELECT unnest([0, 1, 2]) AS c) z WHERE a + b + c > 0)",
            f"gs AS (SELECT sample_id, method, round((r_{METHODS[0]} * a + r_{METHODS[1]} * b + r_{METHODS[2]} * c) / (a + b + c), 9) AS score FROM rr, w)",
            """gpts AS (SELECT method, score, sum(label) AS pos, count(*) AS n FROM gs JOIN lab USING (sample_id) GROUP BY ALL),
gcur AS (SELECT *, sum(pos) OVER d AS tp, sum(n) OVER d AS predicted, sum(pos) OVER (PARTITION BY method) AS p, sum(n) OVER (PARTITION BY method) AS total
        FROM gpts WINDOW d AS (PARTITION BY method ORDER BY score DESC))""",
        ],
        "GROUP BY method",
    ),
)
def score_grid(spark, sf):
    """All weight variants of three ranks scored and evaluated in one job."""
    pts, positives = injected(spark, sf)
    labels = protocol.complete_labels(protocol.track_keys(pts), positives)
    ranked = materialize(ranks.rank01(motion.handcrafted_features(pts), ["sample_id"], METHODS, ["sample_id"]))
    grid = registry.score_grid(ranked, [f"r_{m}" for m in METHODS], _GRID).withColumn("score", F.round("score", 9))
    return evaluate.curve_metrics(grid.join(labels.select("sample_id", "label"), "sample_id")).select("method", "auroc")


def _apart(ctes: list[str]) -> list[str]:
    """The injection SQL with the tracks of each split drawn on their own."""
    out = []
    for c in ctes:
        if c.startswith("poslab AS"):
            c = c.replace("OVER (ORDER BY md5", "OVER (PARTITION BY split ORDER BY md5").replace("count(*) OVER () AS total FROM trk", "count(*) OVER (PARTITION BY split) AS total FROM trk JOIN split USING (sequence)")
        out.append(c)
    return [*out[:2], sql.SPLIT, *out[2:]]


def _holdout(spark, sf):
    """Points of the two splits, each disturbed on its own, and their complete labels."""
    pts = points(spark, sf)
    split = materialize(protocol.split_sequences(pts))
    parts = {}
    for name in ("train", "val"):
        mine = materialize(protocol.split_rows(pts, split).where(F.col("split") == name).drop("split"))
        out, positives = protocol.inject_track_anomalies(mine, FRACTION)
        parts[name] = mine, out, materialize(protocol.complete_labels(protocol.track_keys(out), positives))
    return parts


@query(
    "holdout_protocol",
    select(
        "coalesce(anomaly_type, '*') AS anomaly_type, split, count(*) AS num_rows, sum(label)::BIGINT AS num_positive",
        "lab JOIN split USING (sequence)",
        _apart(_INJECTED),
        "GROUP BY GROUPING SETS ((split, anomaly_type), (split))",
    ),
)
def holdout_protocol(spark, sf):
    """Training and evaluation parts injected and labelled each on its own."""
    parts = [report.label_distribution(labels).withColumn("split", F.lit(name)) for name, (_, _, labels) in _holdout(spark, sf).items()]
    return report.stack_tables(parts)


_HELD = "sc AS (" + " UNION ALL ".join(f"SELECT sample_id, '{m}' AS method, round({m}, 9) AS score FROM hand" for m in METHODS[:2])
_HELD += " UNION ALL SELECT sample_id, 'kinematic_profile', round((speed + acceleration + jerk + turn + smoothness) / 5, 9) FROM kscore)"


@query(
    "holdout_metrics",
    select(
        "'track' AS level, 42::INT AS seed, method, ~sum(pos * ((total - p) - (predicted - tp) + (n - pos) / 2)) / (max(p) * (max(total) - max(p))) AS auroc, ~sum(pos * tp / predicted) / max(p) AS auprc, max(p)::BIGINT AS num_positive, max(total)::BIGINT AS num_total",
        "cur",
        [
            *_apart(_INJECTED), sql.STEPS, sql.HANDCRAFTED, sql.KINEMATIC, *sql.kinematic_scores(), _HELD,
            "al AS (SELECT l.sample_id, method, label, anomaly_type, score FROM lab l JOIN sc USING (sample_id) JOIN split USING (sequence) WHERE split = 'val')", _CURVE,
        ],
        "GROUP BY method",
    ),
)
def holdout_metrics(spark, sf):
    """Detectors trained on the disturbed training part and scored on the evaluation part, through the matrix run."""
    parts = _holdout(spark, sf)
    folder = scratch(spark)
    named = {"track": {"kinematic_profile": ("kinematic_profile", {}), **{m: ("feature", {"column": m}) for m in METHODS[:2]}}}
    matrix.run({"track": parts["val"][0]}, named, [42], folder, FRACTION, train={"track": parts["train"][1]})
    return matrix.metrics(spark, folder).select("level", "seed", "method", "auroc", "auprc", "num_positive", "num_total")


@query(
    "point_lists",
    select(
        "vec_id, 21 AS num_points, ~embedding[4]::DOUBLE AS second_x, ~list_sum(embedding[1:63]::DOUBLE[]) AS total",
        "embeddings",
        [],
    ),
)
def point_lists(spark, sf):
    """All components but the last as a JSON list of points, read back; the last alone is no point."""
    e = read_table(spark, sf, "embeddings")
    triples = F.array(*[F.slice(F.col("embedding").cast("array<double>"), 1 + 3 * i, 3) for i in range(22)])
    found = readers.coerce_points(F.to_json(triples))
    total = F.aggregate(found, F.lit(0.0), lambda a, p: a + p["x"] + p["y"] + p["z"])
    return e.select("vec_id", F.size(found).alias("num_points"), found[1]["x"].alias("second_x"), total.alias("total"))
