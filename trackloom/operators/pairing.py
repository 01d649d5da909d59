"""From per-sensor detections to paired observations and fused points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.functions.geometry import box_center, box_iou, fused_confidence, length, repaired_box_area

KEYS = ["sequence", "track_id", "frame_id"]
BOX = ["x", "y", "w", "h"]


def pair_modalities(detections: DataFrame, how: str = "full", on_duplicate: str = "first") -> DataFrame:
    """One row per (sequence, track, frame) with the boxes of both sensors.

    Equal to the full outer (``how='full'``) or inner (``how='paired'``) join of
    the two sensors on the key, written as one aggregation: duplicates collapse
    before the shuffle, and the table is shuffled once instead of twice.  Of
    several detections of one sensor the first or last by ``event_id`` wins.
    """
    if how not in ("full", "paired"):
        raise ValueError("how must be 'full' or 'paired'")
    pick = {"first": F.min_by, "last": F.max_by}[on_duplicate]
    body = F.struct(*BOX)
    sides = []
    for m in ("rgb", "thermal"):
        mine = F.col("modality") == m
        sides.append(pick(F.when(mine, body), F.when(mine, F.col("event_id"))).alias(m))
    paired = detections.groupBy(*KEYS).agg(*sides)
    if how == "paired":
        paired = paired.where(F.col("rgb").isNotNull() & F.col("thermal").isNotNull())
    out = [F.concat_ws(":", "sequence", "track_id").alias("sample_id"), *[F.col(k) for k in KEYS]]
    for m in ("rgb", "thermal"):
        side = {c: F.col(f"{m}.{c}") for c in BOX}
        cx, cy = box_center(side["x"], side["y"], side["w"], side["h"])
        out += [side[c].alias(f"{m}_{c}") for c in BOX] + [cx.alias(f"{m}_cx"), cy.alias(f"{m}_cy")]
    return modal_relation(paired.select(*out))


def duplicate_detections(detections: DataFrame) -> DataFrame:
    """Keys that one sensor reports more than once, with their count."""
    return (
        detections.groupBy("modality", *KEYS)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
    )


def modal_relation(observations: DataFrame) -> DataFrame:
    """Thermal minus RGB offset and box IoU; null unless both sensors are present."""
    both = F.col("rgb_cx").isNotNull() & F.col("thermal_cx").isNotNull()
    dx = F.col("thermal_cx") - F.col("rgb_cx")
    dy = F.col("thermal_cy") - F.col("rgb_cy")
    boxes = {m: {c: F.col(f"{m}_{c}") for c in BOX} for m in ("rgb", "thermal")}
    return observations.withColumns(
        {
            "modal_dx": F.when(both, dx),
            "modal_dy": F.when(both, dy),
            "modal_offset": F.when(both, length(dx, dy)),
            "modal_iou": box_iou(boxes["rgb"], boxes["thermal"]),
        }
    )


PREFERENCE = ("fused", "rgb", "thermal")


def preferred_centers(observations: DataFrame, order: Sequence[str] = PREFERENCE) -> DataFrame:
    """``cx``, ``cy`` and ``center_source`` of each observation: the first centre of ``order`` with two finite coordinates.

    Without ``fused_cx`` and ``fused_cy`` the fused centre is the mean of both sensors.  Observations without any stay, with nulls.
    """
    rows = observations
    if "fused" in order and "fused_cx" not in rows.columns:
        rows = rows.withColumns({f"fused_{c}": (F.col(f"rgb_{c}") + F.col(f"thermal_{c}")) / 2 for c in ("cx", "cy")})

    def finite(c: str) -> Column:
        return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))

    seen = {m: finite(f"{m}_cx") & finite(f"{m}_cy") for m in order}
    pick = F.coalesce(*[F.when(seen[m], F.struct(F.col(f"{m}_cx").alias("cx"), F.col(f"{m}_cy").alias("cy"), F.lit(m).alias("source"))) for m in order])
    return rows.withColumn("_c", pick).select(
        *observations.columns, F.col("_c.cx").alias("cx"), F.col("_c.cy").alias("cy"), F.col("_c.source").alias("center_source")
    )


def box_area_stats(boxes: DataFrame, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Mean and largest area per key of boxes (x0, y0, x1, y1), of which some are x, y, w, h in truth; null boxes do not count."""
    area = repaired_box_area(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    return boxes.groupBy(*keys).agg(F.count(area).alias("num_boxes"), F.avg(area).alias("mean_area"), F.max(area).alias("max_area"))


RELATION = ["modal_offset_dx", "modal_offset_dy", "modal_offset_distance", "modal_bbox_iou"]


def parse_relation(rows: DataFrame, keep_empty: bool = True) -> DataFrame:
    """Text cells to numbers: both sensors' centres and boxes, and the relation between them.

    Empty and unreadable cells are null, and a sensor counts only with both centre coordinates.  If all four RELATION
    cells are empty and both sensors are there, the relation is inferred from them
    (``relation_source`` says which); ``keep_empty=False`` drops rows without any relation.
    """

    def number(c: str) -> Column:
        return F.trim(F.col(c).cast("string")).try_cast("double")

    sides = {m: {c: number(f"{m}_{c}") for c in ("cx", "cy", *BOX)} for m in ("rgb", "thermal")}
    seen = {m: s["cx"].isNotNull() & s["cy"].isNotNull() for m, s in sides.items()}
    parsed = {f"{m}_{c}": F.when(seen[m], v) for m, s in sides.items() for c, v in s.items()}
    given = {c: number(c) for c in RELATION}
    out = rows.withColumns(parsed | given)
    dx, dy = F.col("thermal_cx") - F.col("rgb_cx"), F.col("thermal_cy") - F.col("rgb_cy")
    boxes = [{c: F.col(f"{m}_{c}") for c in BOX} for m in ("rgb", "thermal")]
    inferred = dict(zip(RELATION, (dx, dy, length(dx, dy), box_iou(*boxes))))
    none = F.coalesce(*RELATION).isNull()
    both = F.col("rgb_cx").isNotNull() & F.col("thermal_cx").isNotNull()
    source = F.when(~none, F.lit("given")).when(both, F.lit("inferred"))
    out = out.withColumn("relation_source", source).withColumns(
        {c: F.when(F.col("relation_source") == "inferred", inferred[c]).otherwise(F.col(c)) for c in RELATION}
    )
    return out if keep_empty else out.where(F.col("relation_source").isNotNull())


def standardize(observations: DataFrame) -> DataFrame:
    """Availability flags, missing list and pair relation of each observation.

    A sensor counts as present only when both centre coordinates are.
    """
    has = {m: F.col(f"{m}_cx").isNotNull() & F.col(f"{m}_cy").isNotNull() for m in ("rgb", "thermal")}
    both = has["rgb"] & has["thermal"]
    missing = F.array_compact(
        F.array(*[F.when(~has[m], F.lit(m)) for m in ("rgb", "thermal")])
    )
    offset = length(F.col("thermal_cx") - F.col("rgb_cx"), F.col("thermal_cy") - F.col("rgb_cy"))
    return observations.select(
        "*",
        has["rgb"].alias("has_rgb"),
        has["thermal"].alias("has_thermal"),
        both.alias("is_paired"),
        missing.alias("missing_modalities"),
        F.when(both, offset).alias("pair_offset"),
    )


def fuse_points(observations: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One fused centre per observation that has any sensor (others are dropped).

    ``keep`` names further columns to carry along (window ids and the like).
    """
    has_rgb = F.col("rgb_cx").isNotNull() & F.col("rgb_cy").isNotNull()
    has_th = F.col("thermal_cx").isNotNull() & F.col("thermal_cy").isNotNull()
    both = has_rgb & has_th
    offset = F.when(
        both, length(F.col("thermal_cx") - F.col("rgb_cx"), F.col("thermal_cy") - F.col("rgb_cy"))
    ).otherwise(F.lit(0.0))

    def merged(axis: str):
        r, t = F.col(f"rgb_c{axis}"), F.col(f"thermal_c{axis}")
        return F.when(both, (r + t) / 2).when(has_rgb, r).otherwise(t)

    return observations.where(has_rgb | has_th).select(
        "sample_id",
        "sequence",
        "track_id",
        "frame_id",
        "category_name",
        *keep,
        F.when(has_rgb, F.col("rgb_cx")).alias("rgb_cx"),
        F.when(has_rgb, F.col("rgb_cy")).alias("rgb_cy"),
        F.when(has_th, F.col("thermal_cx")).alias("thermal_cx"),
        F.when(has_th, F.col("thermal_cy")).alias("thermal_cy"),
        merged("x").alias("cx"),
        merged("y").alias("cy"),
        F.col("w"),
        F.col("h"),
        F.when(both, F.lit(2)).otherwise(F.lit(1)).alias("num_modalities"),
        F.when(both, F.lit("rgb+thermal")).when(has_rgb, F.lit("rgb")).otherwise(F.lit("thermal")).alias(
            "source_modalities"
        ),
        offset.alias("modal_offset"),
        fused_confidence(both, offset).alias("confidence"),
    )
