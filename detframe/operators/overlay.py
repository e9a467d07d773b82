"""Box overlays: a row for each ground-truth and predicted box to draw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import class_index, clip01
from .samples import class_name


def overlay_boxes(gt: DataFrame, pred: DataFrame, size: int = 640) -> DataFrame:
    """sample_id, kind, x, y (centre), width, height, confidence, label; predictions clipped to the image."""
    of_gt = gt.select("sample_id", F.lit("_GT").alias("kind"), F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("w").alias("width"), F.col("h").alias("height"), F.lit(1.0).alias("confidence"), class_name(class_index(F.col("cls").cast("double"))).alias("label"))
    x1, y1, x2, y2 = (clip01(F.col(c) / size) for c in ("x1", "y1", "x2", "y2"))
    of_pred = pred.select("sample_id", F.lit("_PRED").alias("kind"), ((x1 + x2) / 2).alias("x"), ((y1 + y2) / 2).alias("y"), (x2 - x1).alias("width"), (y2 - y1).alias("height"), F.col("score").cast("double").alias("confidence"), class_name(class_index(F.col("label").cast("double"))).alias("label"))
    return of_gt.unionByName(of_pred)
