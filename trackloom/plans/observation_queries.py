"""Queries on detections, observations and fused points."""

from __future__ import annotations

from pyspark.sql import functions as F

from trackloom.operators import motion, pairing, quality, tracking
from trackloom.operators.medians import running_medians
from trackloom.operators.scale import dense_position
from trackloom.plans import oracle as sql
from trackloom.plans.registry import query, select
from trackloom.session import materialize
from trackloom.sources.tables import detections, observations, raw_detections

def points(spark, sf):
    return materialize(pairing.fuse_points(observations(spark, sf)))


_DET = """det AS (
  SELECT 'rgb' AS modality, sequence, track_id, frame_id, event_id, rgb_cx AS cx, rgb_cy AS cy, w, h FROM raw WHERE rgb_cx IS NOT NULL
  UNION ALL
  SELECT 'thermal', sequence, track_id, frame_id, event_id, thermal_cx, thermal_cy, w, h FROM raw WHERE thermal_cx IS NOT NULL),
firsts AS (SELECT * EXCLUDE (rn), cx - w / 2 AS x, cy - h / 2 AS y FROM (
  SELECT *, row_number() OVER (PARTITION BY modality, sequence, track_id, frame_id ORDER BY event_id) AS rn FROM det) d WHERE rn = 1),
lasts AS (SELECT * EXCLUDE (rn), cx - w / 2 AS x, cy - h / 2 AS y FROM (
  SELECT *, row_number() OVER (PARTITION BY modality, sequence, track_id, frame_id ORDER BY event_id DESC) AS rn FROM det) d WHERE rn = 1)"""
_PAIR_COLS = """sample_id, sequence, track_id, frame_id, ~rgb_x, ~rgb_y, ~rgb_w, ~rgb_h, ~rgb_cx, ~rgb_cy,
 ~thermal_x, ~thermal_y, ~thermal_w, ~thermal_h, ~thermal_cx, ~thermal_cy, ~modal_dx, ~modal_dy, ~modal_offset, ~modal_iou"""


def _pair(source: str, join: str) -> str:
    iou = (
        "(greatest(0, least(r.x + r.w, t.x + t.w) - greatest(r.x, t.x)) * "
        "greatest(0, least(r.y + r.h, t.y + t.h) - greatest(r.y, t.y)))"
    )
    return f"""pairs AS (
  SELECT sequence || ':' || track_id AS sample_id, sequence, track_id, frame_id,
         r.x AS rgb_x, r.y AS rgb_y, r.w AS rgb_w, r.h AS rgb_h, r.x + r.w / 2 AS rgb_cx, r.y + r.h / 2 AS rgb_cy,
         t.x AS thermal_x, t.y AS thermal_y, t.w AS thermal_w, t.h AS thermal_h, t.x + t.w / 2 AS thermal_cx, t.y + t.h / 2 AS thermal_cy,
         t.cx - r.cx AS modal_dx, t.cy - r.cy AS modal_dy, sqrt((t.cx - r.cx)^2 + (t.cy - r.cy)^2) AS modal_offset,
         CASE WHEN r.x IS NOT NULL AND t.x IS NOT NULL THEN {iou} / (r.w * r.h + t.w * t.h - {iou}) END AS modal_iou
  FROM (SELECT * FROM {source} WHERE modality = 'rgb') r {join} JOIN
       (SELECT * FROM {source} WHERE modality = 'thermal') t USING (sequence, track_id, frame_id))"""


@query("pair_modalities", select(_PAIR_COLS, "pairs", [sql.RAW, _DET, _pair("firsts", "FULL")]))
def pair_modalities(spark, sf):
    return pairing.pair_modalities(detections(spark, sf))


@query("pair_modalities_last_wins", select(_PAIR_COLS, "pairs", [sql.RAW, _DET, _pair("lasts", "FULL")]))
def pair_last(spark, sf):
    return pairing.pair_modalities(detections(spark, sf), on_duplicate="last")


@query("pair_modalities_paired_only", select(_PAIR_COLS, "pairs", [sql.RAW, _DET, _pair("firsts", "INNER")]))
def pair_inner(spark, sf):
    return pairing.pair_modalities(detections(spark, sf), how="paired")


@query(
    "duplicate_detections",
    select(
        "modality, sequence, track_id, frame_id, count(*) AS rows",
        "det",
        [sql.RAW, _DET],
        "GROUP BY ALL HAVING count(*) > 1",
    ),
)
def duplicate_detections(spark, sf):
    return pairing.duplicate_detections(detections(spark, sf))


@query(
    "standardize_observations",
    select(
        """sample_id, frame_id, rgb_cx IS NOT NULL AS has_rgb, thermal_cx IS NOT NULL AS has_thermal,
        rgb_cx IS NOT NULL AND thermal_cx IS NOT NULL AS is_paired,
        concat_ws(',', CASE WHEN rgb_cx IS NULL THEN 'rgb' END, CASE WHEN thermal_cx IS NULL THEN 'thermal' END) AS missing_modalities,
        ~sqrt((thermal_cx - rgb_cx)^2 + (thermal_cy - rgb_cy)^2) AS pair_offset""",
        "obs",
        sql.BASE,
    ),
)
def standardize(spark, sf):
    return pairing.standardize(observations(spark, sf)).select(
        "sample_id",
        "frame_id",
        "has_rgb",
        "has_thermal",
        "is_paired",
        F.concat_ws(",", "missing_modalities").alias("missing_modalities"),
        "pair_offset",
    )


@query(
    "fuse_points",
    select(
        "sample_id, sequence, track_id, frame_id, ~cx, ~cy, num_modalities, source_modalities, ~modal_offset, ~confidence",
        "fused",
        sql.POINTS,
    ),
)
def fuse_points(spark, sf):
    return pairing.fuse_points(observations(spark, sf)).select(
        "sample_id",
        "sequence",
        "track_id",
        "frame_id",
        "cx",
        "cy",
        "num_modalities",
        "source_modalities",
        "modal_offset",
        "confidence",
    )


_COVER = """count(*) AS total_points, count(rgb_cx) AS rgb_points, count(thermal_cx) AS thermal_points,
 count(*) FILTER (rgb_cx IS NOT NULL AND thermal_cx IS NOT NULL) AS paired_points,
 count(*) FILTER (rgb_cx IS NOT NULL AND thermal_cx IS NULL) AS rgb_only_points,
 count(*) FILTER (rgb_cx IS NULL AND thermal_cx IS NOT NULL) AS thermal_only_points,
 count(*) FILTER (rgb_cx IS NULL AND thermal_cx IS NULL) AS missing_both_points,
 count(*) FILTER (rgb_cx IS NOT NULL OR thermal_cx IS NOT NULL) AS fused_points,
 ~count(*) FILTER (rgb_cx IS NOT NULL AND thermal_cx IS NOT NULL) / count(*) AS paired_ratio,
 ~count(*) FILTER (rgb_cx IS NOT NULL OR thermal_cx IS NOT NULL) / count(*) AS fused_ratio"""


@query("modality_coverage", select(_COVER, "obs", sql.BASE))
def modality_coverage(spark, sf):
    return quality.coverage(observations(spark, sf))


@query("coverage_by_sequence", select("sequence, " + _COVER, "obs", sql.BASE, "GROUP BY sequence"))
def coverage_by_sequence(spark, sf):
    return quality.coverage(observations(spark, sf), ["sequence"])


@query(
    "conversion_summary",
    select(
        """count(*) AS num_rows, count(DISTINCT sequence) AS num_sequences, count(DISTINCT sample_id) AS num_tracks,
        count(*) FILTER (rgb_cx IS NOT NULL AND thermal_cx IS NOT NULL) AS paired_points,
        count(*) FILTER (rgb_cx IS NOT NULL AND thermal_cx IS NULL) AS rgb_only_points,
        count(*) FILTER (rgb_cx IS NULL AND thermal_cx IS NOT NULL) AS thermal_only_points,
        count(*) FILTER (rgb_cx IS NULL AND thermal_cx IS NULL) AS missing_both_points,
        ~count(*) FILTER (rgb_cx IS NOT NULL AND thermal_cx IS NOT NULL) / count(*) AS paired_ratio""",
        "obs",
        sql.BASE,
    ),
)
def conversion_summary(spark, sf):
    return quality.conversion_summary(observations(spark, sf))


@query(
    "category_counts",
    select("category_name, count(*) AS num_rows", "obs", sql.BASE, "GROUP BY category_name"),
)
def category_counts(spark, sf):
    return quality.category_counts(observations(spark, sf))


_QUALITY = """q AS (
  SELECT coalesce(sequence, '*') AS sequence, count(*) AS num_keys,
   count(*) FILTER (rgb_cx IS NOT NULL AND thermal_cx IS NOT NULL) AS num_paired,
   count(*) FILTER (rgb_cx IS NULL) AS num_missing_rgb, count(*) FILTER (thermal_cx IS NULL) AS num_missing_thermal,
   avg(off) AS omean, max(off) AS omax, avg(iou) AS imean
  FROM (SELECT *, sqrt((thermal_cx - rgb_cx)^2 + (thermal_cy - rgb_cy)^2) AS off,
               CASE WHEN rgb_cx IS NOT NULL AND thermal_cx IS NOT NULL THEN
               greatest(0, w - abs(thermal_cx - rgb_cx)) * greatest(0, h - abs(thermal_cy - rgb_cy))
               / (2 * w * h - greatest(0, w - abs(thermal_cx - rgb_cx)) * greatest(0, h - abs(thermal_cy - rgb_cy))) END AS iou
        FROM obs WHERE rgb_cx IS NOT NULL OR thermal_cx IS NOT NULL) o
  GROUP BY ROLLUP (sequence))"""


@query(
    "quality_by_sequence",
    select(
        """sequence, num_keys, num_paired, num_missing_rgb, num_missing_thermal,
        ~(num_keys - num_missing_rgb) / num_keys AS rgb_coverage, ~(num_keys - num_missing_thermal) / num_keys AS thermal_coverage,
        ~num_paired / num_keys AS paired_coverage, ~coalesce(omean, 0) AS modal_offset_mean, ~coalesce(omax, 0) AS modal_offset_max,
        ~coalesce(imean, 0) AS modal_iou_mean, CASE WHEN num_missing_rgb + num_missing_thermal > 0 THEN 'partial' ELSE 'ok' END AS status""",
        "q",
        [*sql.BASE, _QUALITY],
    ),
)
def quality_by_sequence(spark, sf):
    return quality.cross_modal_quality(observations(spark, sf))


_LINK = """link AS (
  SELECT sample_id, sequence, track_id, min(frame_id) AS frame_start, max(frame_id) AS frame_end, count(*) AS num_points,
         coalesce(max(gap), 0) AS max_frame_gap, coalesce(avg(gap), 0) AS mean_frame_gap,
         CAST(max(frame_id) - min(frame_id) + 1 - count(*) AS BIGINT) AS missing_frames,
         coalesce(string_agg((frame_id - gap) || ':' || gap, ',' ORDER BY frame_id) FILTER (gap > 1), '') AS gaps,
         count(*) FILTER (rgb_cx IS NOT NULL OR thermal_cx IS NOT NULL) AS visible_any_frames
  FROM (SELECT *, frame_id - lag(frame_id) OVER (PARTITION BY sample_id ORDER BY frame_id) AS gap FROM obs) o
  GROUP BY ALL)"""


@query(
    "temporal_linkage",
    select(
        "sample_id, sequence, track_id, frame_start, frame_end, num_points, max_frame_gap, ~mean_frame_gap, missing_frames, gaps",
        "link",
        [*sql.BASE, _LINK],
    ),
)
def temporal_linkage(spark, sf):
    found = motion.temporal_linkage(materialize(observations(spark, sf)))
    text = F.transform("gaps", lambda g: F.concat_ws(":", g["frame_id"].cast("string"), g["gap"].cast("string")))
    return found.withColumn("gaps", F.array_join(text, ","))


@query(
    "preferred_centers",
    select(
        """sample_id, frame_id, event_id, CASE WHEN thermal_cx IS NOT NULL AND event_id % 9 <> 0 THEN 'thermal' WHEN b AND event_id % 9 <> 0 THEN 'fused' WHEN rgb_cx IS NOT NULL THEN 'rgb' END AS center_source,
        ~CASE WHEN thermal_cx IS NOT NULL AND event_id % 9 <> 0 THEN thermal_cx ELSE rgb_cx END AS cx,
        ~CASE WHEN thermal_cx IS NOT NULL AND event_id % 9 <> 0 THEN thermal_cy ELSE rgb_cy END AS cy""",
        "(SELECT *, rgb_cx IS NOT NULL AND thermal_cx IS NOT NULL AS b FROM obs) o",
        sql.BASE,
    ),
)
def preferred_centers(spark, sf):
    """Thermal before fused before RGB; some thermal coordinates are not finite."""
    rows = observations(spark, sf).withColumn("thermal_cy", F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("thermal_cy")))
    found = pairing.preferred_centers(rows, ("thermal", "fused", "rgb"))
    return found.select("sample_id", "frame_id", "event_id", "center_source", "cx", "cy")


@query(
    "box_areas",
    select(
        "sample_id, count(a) AS num_boxes, ~avg(a) AS mean_area, ~max(a) AS max_area",
        """(SELECT sample_id, CASE WHEN rgb_cx IS NULL THEN NULL WHEN event_id % 3 <> 0 THEN w * h
             WHEN w < rgb_cx - w / 2 OR h < rgb_cy - h / 2 THEN w * h
             ELSE (w - (rgb_cx - w / 2)) * (h - (rgb_cy - h / 2)) END AS a FROM obs) o""",
        sql.BASE,
        "GROUP BY sample_id",
    ),
)
def box_areas(spark, sf):
    """A third of the boxes come as corner and size; they are told by their negative extent."""
    rows = observations(spark, sf)
    x, y = F.col("rgb_cx") - F.col("w") / 2, F.col("rgb_cy") - F.col("h") / 2
    sized = F.col("event_id") % 3 == 0
    seen = F.col("rgb_cx").isNotNull()
    boxes = rows.select(
        "sample_id",
        x.alias("x0"),
        y.alias("y0"),
        F.when(seen, F.when(sized, F.col("w")).otherwise(x + F.col("w"))).alias("x1"),
        F.when(seen, F.when(sized, F.col("h")).otherwise(y + F.col("h"))).alias("y1"),
    )
    return pairing.box_area_stats(boxes)


_TEXT = """txt AS (SELECT *, CASE WHEN event_id % 4 = 0 THEN event_id % 13 - 6.5::DOUBLE END AS g, event_id % 4 = 0 AS given,
    rgb_cx IS NOT NULL AND thermal_cx IS NOT NULL AND event_id % 6 <> 0 AS paired,
    rgb_cx - w / 2 AS rx, rgb_cy - h / 2 AS ry, thermal_cx - w / 2 AS tx, thermal_cy - h / 2 AS ty FROM obs),
  rel AS (SELECT *, greatest(least(rx, tx) + w - greatest(rx, tx), 0) * greatest(least(ry, ty) + h - greatest(ry, ty), 0) AS cut FROM txt)"""


@query(
    "parsed_relations",
    select(
        """sample_id, frame_id, event_id, CASE WHEN given THEN 'given' WHEN paired THEN 'inferred' END AS relation_source,
        ~CASE WHEN given THEN g WHEN paired THEN thermal_cx - rgb_cx END AS modal_offset_dx,
        ~CASE WHEN paired AND NOT given THEN thermal_cy - rgb_cy END AS modal_offset_dy,
        ~CASE WHEN paired AND NOT given THEN sqrt((thermal_cx - rgb_cx)^2 + (thermal_cy - rgb_cy)^2) END AS modal_offset_distance,
        ~CASE WHEN paired AND NOT given THEN cut / (2 * w * h - cut) END AS modal_bbox_iou""",
        "rel",
        [*sql.BASE, _TEXT],
    ),
)
def parsed_relations(spark, sf):
    """Observations as text cells; some bring a relation of their own, some have an unreadable cell."""
    rows = observations(spark, sf)
    corner = {"x": ("cx", "w"), "y": ("cy", "h")}
    rows = rows.withColumns(
        {f"{m}_{a}": F.col(f"{m}_{c}") - F.col(s) / 2 for m in ("rgb", "thermal") for a, (c, s) in corner.items()}
        | {f"{m}_{s}": F.col(s) for m in ("rgb", "thermal") for s in ("w", "h")}
    )
    cells = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for m in ("rgb", "thermal") for c in (f"{m}_{k}" for k in ("cx", "cy", "x", "y", "w", "h"))}
    cells["thermal_cy"] = F.when(F.col("event_id") % 6 == 0, F.lit("n/a")).otherwise(cells["thermal_cy"])
    own = F.when(F.col("event_id") % 4 == 0, (F.col("event_id") % 13 - 6.5).cast("string")).otherwise(F.lit(" "))
    text = rows.withColumns(cells | {"modal_offset_dx": own} | {c: F.lit("") for c in pairing.RELATION[1:]})
    return pairing.parse_relation(text).select("sample_id", "frame_id", "event_id", "relation_source", *pairing.RELATION)


_TQ = """tq AS (SELECT *, visible_any_frames / num_points AS fused_ratio,
  concat_ws(',', CASE WHEN num_points < 25 THEN 'short_track' END, CASE WHEN visible_any_frames < 24 THEN 'low_visible_frames' END,
            CASE WHEN max_frame_gap > 8 THEN 'large_frame_gap' END, CASE WHEN visible_any_frames / num_points < 0.95 THEN 'low_fused_ratio' END) AS drop_reasons
  FROM link)"""
_TQ_RULES = {"min_points": 25, "min_visible": 24, "max_frame_gap": 8, "min_fused_ratio": 0.95}


@query(
    "track_quality",
    select(
        """sample_id, sequence, track_id, num_points, visible_any_frames, ~fused_ratio, max_frame_gap, missing_frames,
        drop_reasons, drop_reasons = '' AS keep""",
        "tq",
        [*sql.BASE, _LINK, _TQ],
    ),
)
def track_quality(spark, sf):
    return quality.track_quality(materialize(observations(spark, sf)), **_TQ_RULES).withColumn(
        "drop_reasons", F.concat_ws(",", "drop_reasons")
    )


@query(
    "drop_reason_counts",
    select(
        "reason, count(*) AS num_tracks",
        "(SELECT unnest(string_split(drop_reasons, ',')) AS reason FROM tq) u",
        [*sql.BASE, _LINK, _TQ],
        "WHERE reason <> '' GROUP BY reason",
    ),
)
def drop_reason_counts(spark, sf):
    return quality.drop_reason_counts(quality.track_quality(materialize(observations(spark, sf)), **_TQ_RULES))


@query(
    "keep_tracks",
    select(
        "f.sample_id, f.frame_id, ~f.cx AS cx, ~f.cy AS cy",
        "fused f SEMI JOIN (SELECT * FROM tq WHERE drop_reasons = '') k USING (sample_id)",
        [*sql.POINTS, _LINK, _TQ],
    ),
)
def keep_tracks(spark, sf):
    obs = materialize(observations(spark, sf))
    kept = quality.keep_tracks(pairing.fuse_points(obs), quality.track_quality(obs, **_TQ_RULES))
    return kept.select("sample_id", "frame_id", "cx", "cy")


_VEL = """vel AS (
  SELECT sample_id, modality, frame_id, (cx - lag(cx) OVER m) / greatest(frame_id - lag(frame_id) OVER m, 1) AS vx,
         (cy - lag(cy) OVER m) / greatest(frame_id - lag(frame_id) OVER m, 1) AS vy
  FROM (SELECT sample_id, frame_id, 'rgb' AS modality, rgb_cx AS cx, rgb_cy AS cy FROM obs WHERE rgb_cx IS NOT NULL
        UNION ALL SELECT sample_id, frame_id, 'thermal', thermal_cx, thermal_cy FROM obs WHERE thermal_cx IS NOT NULL) u
  WINDOW m AS (PARTITION BY sample_id, modality ORDER BY frame_id))"""


@query(
    "velocity",
    select(
        "sample_id, modality, frame_id, ~vx, ~vy, ~sqrt(vx * vx + vy * vy) AS speed, ~sqrt(vx * vx + vy * vy) * 10 AS speed_per_second",
        "vel",
        [*sql.BASE, _VEL],
    ),
)
def velocity(spark, sf):
    return motion.modality_velocity(materialize(observations(spark, sf)), fps=10.0).select(
        "sample_id", "modality", "frame_id", "vx", "vy", "speed", "speed_per_second"
    )


_PAST = "PARTITION BY sample_id ORDER BY frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _change(value: str, base: str, increase_only: bool) -> str:
    if increase_only:
        return f"CASE WHEN {base} IS NULL THEN 0 WHEN {base} <= 0 THEN greatest(0, {value}) ELSE greatest(0, {value} / {base} - 1) END"
    return f"CASE WHEN {base} IS NULL THEN 0 WHEN {base} <= 0 THEN abs({value} - {base}) ELSE abs({value} / {base} - 1) END"


@query(
    "history_change",
    select(
        f"sample_id, frame_id, ~speed_before, ~{_change('coalesce(speed, 0)', 'speed_before', False)} AS speed_change, ~{_change('cx', 'cx_before', True)} AS cx_increase",
        f"(SELECT *, median(speed) OVER ({_PAST}) AS speed_before, median(cx) OVER ({_PAST}) AS cx_before FROM steps) s",
        sql.MOTION,
    ),
)
def history_change(spark, sf):
    """Against the median of all earlier rows of a track; chunks of 500 frames, so that tracks span several."""
    steps = materialize(motion.track_steps(points(spark, sf)).select("sample_id", "frame_id", "speed", "cx"))
    rows = running_medians(steps, ["sample_id"], "frame_id", ["speed", "cx"], chunk=500)
    return rows.select(
        "sample_id",
        "frame_id",
        "speed_before",
        tracking.history_change(F.coalesce("speed", F.lit(0.0)), F.col("speed_before"), False).alias("speed_change"),
        tracking.history_change(F.col("cx"), F.col("cx_before"), True).alias("cx_increase"),
    )


@query(
    "track_steps",
    select(
        "sample_id, frame_id, ~step, ~speed, ~acceleration, ~jerk, ~turn, ~heading_turn", "steps", sql.MOTION
    ),
)
def track_steps(spark, sf):
    return motion.track_steps(points(spark, sf)).select(
        "sample_id", "frame_id", "step", "speed", "acceleration", "jerk", "turn", "heading_turn"
    )


def _features(names: list[str]) -> str:
    exact = {"duration_frames", "num_points"}
    return ", ".join(["sample_id", "sequence", "track_id", *[n if n in exact else f"~{n}" for n in names]])


@query("track_features", select(_features(motion.HANDCRAFTED), "hand", [*sql.MOTION, sql.HANDCRAFTED]))
def track_features(spark, sf):
    return motion.handcrafted_features(points(spark, sf))


@query("kinematic_features", select(_features(motion.KINEMATIC), "kin", [*sql.MOTION, sql.KINEMATIC]))
def kinematic_features(spark, sf):
    return motion.kinematic_features(points(spark, sf))


@query(
    "simple_components",
    select(
        "sample_id, sequence, track_id, ~speed_spike, ~turn_irregularity, ~low_confidence_ratio, ~modal_offset_median",
        "comp",
        [*sql.MOTION, sql.SIMPLE_COMPONENTS],
    ),
)
def simple_components(spark, sf):
    return motion.simple_components(materialize(motion.track_steps(points(spark, sf))))


@query("distinct_sequences", select("DISTINCT sequence", "obs", sql.BASE))
def distinct_sequences(spark, sf):
    return observations(spark, sf).select("sequence").where(F.trim("sequence") != "").distinct()


@query(
    "frame_positions",
    select(
        "sequence, frame_id, dense_rank() OVER (PARTITION BY sequence ORDER BY frame_id) - 1 AS position",
        "(SELECT DISTINCT sequence, frame_id FROM obs) d",
        sql.BASE,
    ),
)
def frame_positions(spark, sf):
    return dense_position(observations(spark, sf), ["sequence"], "frame_id")


@query(
    "tracks",
    select(
        """sample_id, count(*) AS num_points, count(rgb_cx) AS visible_rgb_frames, count(thermal_cx) AS visible_thermal_frames,
        arg_min(category_name, frame_id) AS category_name, string_agg(frame_id::VARCHAR, ',' ORDER BY frame_id) AS frames""",
        "obs",
        sql.BASE,
        "GROUP BY sample_id",
    ),
)
def tracks(spark, sf):
    """Nested track documents (points bounded per document by frame chunks)."""
    from trackloom.sources.documents import assemble_tracks

    docs = assemble_tracks(observations(spark, sf))
    return docs.select(
        "sample_id",
        F.size("points").cast("long").alias("num_points"),
        "visible_rgb_frames",
        "visible_thermal_frames",
        "category_name",
        F.concat_ws(",", F.transform("points", lambda p: p["frame_id"].cast("string"))).alias("frames"),
    )


@query(
    "majority_category",
    select(
        "sample_id, arg_min(category_name, (-n, category_name)) AS category_name, max(n) AS votes",
        "(SELECT sample_id, category_name, count(*) AS n FROM raw GROUP BY ALL) c",
        [sql.RAW],
        "GROUP BY sample_id",
    ),
)
def majority_category(spark, sf):
    from trackloom.operators.report import majority

    rows = raw_detections(spark, sf).select(
        F.concat_ws(":", "sequence", "track_id").alias("sample_id"), "category_name"
    )
    return majority(rows, ["sample_id"], "category_name")
