"""Ground truth x prediction pairs of one sample: an equi-join on sample_id, never a global cross join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import cxcywh_to_xyxy, giou, iou

SIZE = 640


def pairs(gt: DataFrame, pred: DataFrame, size: int = SIZE, prune: bool = True, clamp: float | None = 1e-6, with_giou: bool = False) -> DataFrame:
    """(sample_id, gt_idx, pred_idx, gt_cls, pred_label, score, iou[, giou]); boxes in normalised units.

    prune keeps overlapping pairs only: pairs of IoU 0 change no metric once both spines are joined back.
    """
    g1, g2, g3, g4 = cxcywh_to_xyxy("cx", "cy", "w", "h")
    g = gt.select("sample_id", "gt_idx", F.col("cls").alias("gt_cls"), g1.alias("gx1"), g2.alias("gy1"), g3.alias("gx2"), g4.alias("gy2"))
    p = pred.select("sample_id", "pred_idx", F.col("label").alias("pred_label"), "score", *[(F.col(c) / size).alias("p" + c) for c in ("x1", "y1", "x2", "y2")])
    both = g.join(p, "sample_id")
    if prune:
        both = both.where("gx1 < px2 AND px1 < gx2 AND gy1 < py2 AND py1 < gy2")
    a, b = ([F.col(s + c) for c in ("x1", "y1", "x2", "y2")] for s in "gp")
    out = [iou(a, b, clamp).alias("iou")] + ([giou(a, b).alias("giou")] if with_giou else [])
    return both.select("sample_id", "gt_idx", "pred_idx", "gt_cls", "pred_label", "score", *out)


def per_sample(gt: DataFrame, pred: DataFrame, size: int = SIZE, spine: DataFrame | None = None) -> DataFrame:
    """(sample_id, gts, preds): both sides of a sample as arrays in index order, null where a side is empty.

    spine: the samples to have a row for, else those with either side.

    The caps of ground truth and predictions bound a row. What follows reads each pair inside its row, so that
    one exchange a side is all that several results of the same pairs need.
    """
    corners = lambda xs: [c.alias(n) for c, n in zip(xs, ("x1", "y1", "x2", "y2"), strict=True)]
    g = gt.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("gt_idx", "cls", *corners(cxcywh_to_xyxy("cx", "cy", "w", "h"))))).alias("gts"))
    p = pred.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pred_idx", "label", F.col("score").cast("double").alias("score"), *corners([F.col(c) / size for c in ("x1", "y1", "x2", "y2")])))).alias("preds"))
    return g.join(p, "sample_id", "full") if spine is None else spine.select("sample_id").join(g, "sample_id", "left").join(p, "sample_id", "left")


def overlap(a, b):
    return (a["x1"] < b["x2"]) & (b["x1"] < a["x2"]) & (a["y1"] < b["y2"]) & (b["y1"] < a["y2"])


def iou_of(a, b, clamp: float | None = 1e-6):
    return iou(*([x[c] for c in ("x1", "y1", "x2", "y2")] for x in (a, b)), clamp)
