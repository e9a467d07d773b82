"""Model output: threshold, top-k and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD, TOP_K = 0.3, 300


def top_predictions(pred: DataFrame, threshold: float = THRESHOLD, k: int = TOP_K) -> DataFrame:
    """pred(sample_id, query_idx, label, x1, y1, x2, y2, score) -> pred_idx 0..k-1 by falling score, ties by query.

    The threshold is inclusive and compared as float; NaN scores go (Spark orders NaN above all numbers).
    """
    good = pred.where(~F.isnan("score") & (F.col("score").cast("float") >= F.lit(threshold).cast("float")))
    rank = F.row_number().over(Window.partitionBy("sample_id").orderBy(F.desc("score"), "query_idx"))
    return good.withColumn("pred_idx", rank - 1).where(F.col("pred_idx") < k)


def packed(samples: DataFrame, top: DataFrame) -> DataFrame:
    """One array of [x1, y1, x2, y2, score, label] rows a sample, best first; empty where nothing is left."""
    row = F.struct("pred_idx", F.array(*[F.col(c).cast("float") for c in ("x1", "y1", "x2", "y2", "score", "label")]).alias("r"))
    rows = top.groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["r"]).alias("packed"))
    return samples.select("sample_id").join(rows, "sample_id", "left").withColumn("packed", F.coalesce("packed", F.array().cast("array<array<float>>")))


def from_arrays(raw: DataFrame) -> DataFrame:
    """Long form of model output raw(sample_id, boxes, scores, labels): boxes an array of [x1, y1, x2, y2], or one such box alone.

    Query numbers are places in the arrays; a sample with empty or null arrays has no rows.
    """
    flat = raw.schema["boxes"].dataType.elementType.typeName() != "array"
    boxes = F.when(F.size("boxes") > 0, F.array("boxes")) if flat else F.col("boxes")
    zipped = F.arrays_zip(boxes.alias("box"), F.col("scores").alias("score"), F.col("labels").alias("label"))
    p = raw.select("sample_id", F.posexplode(zipped).alias("query_idx", "r"))
    corners = [F.col("r")["box"][i].cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))]
    return p.select("sample_id", "query_idx", F.col("r")["label"].cast("int").alias("label"), *corners, F.col("r")["score"].cast("double").alias("score"))


def unpacked(batches: DataFrame) -> DataFrame:
    """Long form of batches(sample_ids, packed): one array of [x1, y1, x2, y2, score, label] rows for each sample of a batch.

    Every item of a batch is read; pred_idx is the place in its array, best first.
    """
    items = batches.select(F.explode(F.arrays_zip("sample_ids", "packed")).alias("i")).select(F.col("i.sample_ids").alias("sample_id"), F.posexplode("i.packed").alias("pred_idx", "r"))
    numbers = [F.col("r")[i].cast("double").alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2", "score"))]
    return items.select("sample_id", "pred_idx", F.col("r")[5].cast("int").alias("label"), *numbers)
