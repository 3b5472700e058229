"""Boxes in the normalized space 0..1000 and in pixels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = 1000


def yxyx_to_xyxy(box: Column) -> Column:
    """A box given y first, as x first; null unless it has a positive extent inside the space."""
    y0, x0, y1, x1 = (F.get(box, F.lit(i)) for i in range(4))
    valid = (F.size(box) == 4) & (x0 >= 0) & (y0 >= 0) & (x0 < x1) & (y0 < y1) & (x1 <= SPACE) & (y1 <= SPACE)
    return F.when(valid, F.array(x0, y0, x1, y1))


def valid_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return (x0 >= 0) & (y0 >= 0) & (x0 < x1) & (y0 < y1) & (x1 <= SPACE) & (y1 <= SPACE)


def pixel_low(value: Column, size: Column | int) -> Column:
    size = size if isinstance(size, Column) else F.lit(size)
    return F.greatest(F.lit(0), F.least(size - 1, F.floor(value * size / SPACE))).cast("long")


def pixel_high(value: Column, low: Column, size: Column | int) -> Column:
    size = size if isinstance(size, Column) else F.lit(size)
    return F.least(size, F.greatest(low + 1, F.ceil(value * size / SPACE))).cast("long")


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 where the union is empty."""
    width = F.greatest(F.lit(0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    height = F.greatest(F.lit(0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    both = width * height
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def center_distance(a: list[Column], b: list[Column]) -> Column:
    return F.hypot((a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2)


def padded(box: list[Column], ratio: float) -> list[Column]:
    """The box grown by a share of its sides, which is rounded half to even, and clamped to the space."""
    dx, dy = (F.bround((box[i + 2] - box[i]) * ratio, 0).cast("long") for i in (0, 1))
    low = lambda v: F.greatest(F.lit(0), v)
    high = lambda v: F.least(F.lit(SPACE), v)
    return [low(box[0] - dx), low(box[1] - dy), high(box[2] + dx), high(box[3] + dy)]


def to_xywh(box: list[Column], width: int, height: int) -> list[Column]:
    """Pixels (x, y, w, h) of a normalized box; at least one pixel each way, inside the picture."""
    scale = lambda v, n: F.bround(v * n / SPACE, 0).cast("long")
    x = F.least(F.greatest(scale(box[0], width), F.lit(0)), F.lit(width - 1))
    y = F.least(F.greatest(scale(box[1], height), F.lit(0)), F.lit(height - 1))
    w = F.greatest(F.lit(1), F.least(scale(box[2], width), F.lit(width)) - x)
    h = F.greatest(F.lit(1), F.least(scale(box[3], height), F.lit(height)) - y)
    return [x, y, w, h]
