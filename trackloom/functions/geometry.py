"""Scalar column functions on centres, boxes and steps (all whole-stage codegen)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the fusion rule.
OFFSET_SCALE = 25.0
SINGLE_MODALITY_CONFIDENCE = 0.55


def length(x: Column | str, y: Column | str) -> Column:
    """Root of the sum of squares, step by step as in the SQL: ``hypot`` differs in the last bit, which decides ties."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.sqrt(x * x + y * y)


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return length(x1 - x0, y1 - y0)


def box_center(x: Column, y: Column, w: Column, h: Column) -> tuple[Column, Column]:
    return x + w / 2, y + h / 2


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """IoU of two x, y, w, h boxes; null when the union is empty or a side is missing."""
    width = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    height = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    overlap = F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))
    union = a["w"] * a["h"] + b["w"] * b["h"] - overlap
    complete = a["x"].isNotNull() & b["x"].isNotNull()
    return F.when(complete & (union > 0), overlap / union)


def repaired_box_area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Area of an x0, y0, x1, y1 box; a negative extent means the box was x, y, w, h; null without all four."""
    width, height = x1 - x0, y1 - y0
    as_size = (width < 0) | (height < 0)
    zero = F.lit(0.0)
    area = F.greatest(F.when(as_size, x1).otherwise(width), zero) * F.greatest(
        F.when(as_size, y1).otherwise(height), zero
    )
    return F.when(width.isNotNull() & height.isNotNull(), area)


def fused_confidence(both: Column, offset: Column) -> Column:
    return F.when(both, 1.0 / (1.0 + offset / OFFSET_SCALE)).otherwise(F.lit(SINGLE_MODALITY_CONFIDENCE))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def finite(value: Column, default: float = 0.0) -> Column:
    """Replace null, NaN and infinities by ``default``."""
    bad = value.isNull() | F.isnan(value) | (F.abs(value) == F.lit(float("inf")))
    return F.when(bad, F.lit(default)).otherwise(value)


def saturate01(value: Column) -> Column:
    """x / (1 + x) of the non-negative finite part, inside 0..1."""
    positive = F.greatest(finite(value), F.lit(0.0))
    return clamp(positive / (1.0 + positive))


def step_angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Angle between two steps; null when either has no length."""
    na, nb = length(ax, ay), length(bx, by)
    return F.when((na != 0) & (nb != 0), F.acos(clamp((ax * bx + ay * by) / (na * nb), -1.0, 1.0)))


def heading_change(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Wrapped difference of the two step headings, 0..pi (a zero step heads east)."""
    delta = F.abs(F.atan2(by, bx) - F.atan2(ay, ax))
    return F.least(delta, F.lit(2 * math.pi) - delta)


def frame_iou(s0: Column, e0: Column, s1: Column, e1: Column) -> Column:
    """IoU of two inclusive frame intervals."""
    zero = F.lit(0)
    inter = F.greatest(zero, F.least(e0, e1) - F.greatest(s0, s1) + 1)
    union = F.greatest(zero, e0 - s0 + 1) + F.greatest(zero, e1 - s1 + 1) - inter
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))
