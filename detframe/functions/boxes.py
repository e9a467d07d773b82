"""Box arithmetic as column expressions (all in double, JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN = float("nan")


def cxcywh_to_xyxy(cx, cy, w, h) -> tuple[Column, Column, Column, Column]:
    cx, cy, w, h = map(F.col, (cx, cy, w, h)) if isinstance(cx, str) else (cx, cy, w, h)
    return cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2


def xyxy_to_cxcywh(x1, y1, x2, y2):
    return (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1


def coco_to_normalized(x, y, w, h, width, height, size: int = 640):
    """Pixel x, y, w, h of a width x height image -> cxcywh in [0, 1], through the size x size frame."""
    sx, sy = F.lit(float(size)) / width, F.lit(float(size)) / height
    return (x + w / 2) * sx / size, (y + h / 2) * sy / size, w * sx / size, h * sy / size


def kitti_to_xywh(x1, y1, x2, y2):
    return x1, y1, x2 - x1, y2 - y1


def _overlap(a, b) -> tuple[Column, Column]:
    iw = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    ih = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    inter = iw * ih
    return inter, (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter


def iou(a, b, clamp: float | None = 1e-6) -> Column:
    """IoU of xyxy boxes; clamp bounds the union from below, None gives NaN for an empty union."""
    inter, union = _overlap(a, b)
    if clamp is not None:
        return inter / F.greatest(union, F.lit(clamp))
    return F.when(union == 0, F.lit(NAN)).otherwise(F.try_divide(inter, union))


def giou(a, b, check: bool = False) -> Column:
    """Generalised IoU; check raises for boxes whose corners are swapped."""
    inter, union = _overlap(a, b)
    hull = (F.greatest(a[2], b[2]) - F.least(a[0], b[0])) * (F.greatest(a[3], b[3]) - F.least(a[1], b[1]))
    plain = F.when(union == 0, F.lit(NAN)).otherwise(F.try_divide(inter, union))
    out = F.when(hull == 0, F.lit(NAN)).otherwise(plain - F.try_divide(hull - union, hull))
    if check:
        good = (a[2] >= a[0]) & (a[3] >= a[1]) & (b[2] >= b[0]) & (b[3] >= b[1])
        out = F.when(good, out).otherwise(F.raise_error(F.lit("box corners out of order")).cast("double"))
    return out


def l1(a, b) -> Column:
    return sum((F.abs(x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))


def clip01(c) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def class_index(c) -> Column:
    """An integer class; NaN and null give -1."""
    return F.when(F.isnan(c) | c.isNull(), F.lit(-1)).otherwise(c.cast("int"))
