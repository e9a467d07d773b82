"""Ground truth in long form, and its padded dense views at the export edge."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import coco_to_normalized
from .samples import with_valid_class

SIZE, MAX_GT = 640, 400


def ground_truth(samples: DataFrame, annotations: DataFrame, cats: DataFrame, size: int = SIZE, max_gt: int = MAX_GT) -> DataFrame:
    """gt(sample_id, gt_idx, cls, cx, cy, w, h): valid annotations in file order, capped after the filter.

    samples: sample_id, width, height; annotations: sample_id, ann_pos, category_id, x, y, w, h.
    """
    valid = with_valid_class(annotations, cats)
    order = Window.partitionBy("sample_id").orderBy("ann_pos")
    valid = valid.withColumn("gt_idx", F.row_number().over(order) - 1).where(F.col("gt_idx") < max_gt)
    sized = valid.join(samples.select("sample_id", "width", "height"), "sample_id")
    cx, cy, w, h = coco_to_normalized(*(F.col(c) for c in ("x", "y", "w", "h", "width", "height")), size=size)
    return sized.select("sample_id", "gt_idx", "cls", cx.alias("cx"), cy.alias("cy"), w.alias("w"), h.alias("h"))


def padded(samples: DataFrame, gt: DataFrame, max_gt: int = MAX_GT) -> DataFrame:
    """gt_padded (max_gt rows of cls, cx, cy, w, h; -1 where there is none), gt_boxes (0), gt_labels (-1), gt_mask."""
    rows = gt.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("gt_idx", "cls", "cx", "cy", "w", "h"))).alias("g"))
    flat = F.transform("g", lambda r: F.array(*[r[c].cast("float") for c in ("cls", "cx", "cy", "w", "h")]))
    real = lambda r: r[0] >= 0
    zeros, minus = F.array_repeat(F.lit(0.0).cast("float"), 4), F.array_repeat(F.lit(-1.0).cast("float"), 5)
    own = rows.select("sample_id", flat.alias("__flat")).select(
        "sample_id", "__flat", F.transform("__flat", lambda r: F.when(real(r), F.slice(r, 2, 4)).otherwise(zeros)).alias("__boxes"),
        F.transform("__flat", lambda r: r[0].cast("int")).alias("__labels"), F.transform("__flat", lambda r: real(r).cast("float")).alias("__mask"),
    )
    # Functions run over a sample's own rows, below the join; what fills up to max_gt above it is a constant.
    filled = lambda c, none: F.slice(F.concat(F.coalesce(c, F.array().cast(own.schema[c].dataType)), F.array_repeat(none, max_gt)), 1, max_gt)
    fill = {"gt_padded": ("__flat", minus), "gt_boxes": ("__boxes", zeros), "gt_labels": ("__labels", F.lit(-1)), "gt_mask": ("__mask", F.lit(0.0).cast("float"))}
    return samples.select("sample_id").join(own, "sample_id", "left").select("sample_id", *[filled(*f).alias(n) for n, f in fill.items()])


def from_padded(dense: DataFrame) -> DataFrame:
    """Long form of a padded tensor: a row with -1 in any column is padding."""
    g = dense.select("sample_id", F.posexplode("gt_padded").alias("gt_idx", "r")).where(~F.exists("r", lambda x: x == -1))
    return g.select("sample_id", "gt_idx", F.col("r")[0].cast("int").alias("cls"), *[F.col("r")[i].cast("double").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"), 1)])


def valid_targets(dense: DataFrame) -> DataFrame:
    """Long form of the dense views gt_boxes, gt_labels and gt_mask: rows whose mask exceeds 0.5, renumbered in order."""
    places = F.filter(F.sequence(F.lit(0), F.size("gt_mask") - 1), lambda i: F.get("gt_mask", i) > 0.5)
    rows = F.transform(F.when(F.size("gt_mask") > 0, places), lambda i: F.struct(F.get("gt_boxes", i).alias("gt_boxes"), F.get("gt_labels", i).alias("gt_labels")))
    g = dense.select("sample_id", F.posexplode(rows).alias("gt_idx", "r"))
    boxes = [F.col("r.gt_boxes")[i].cast("float").alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))]
    return g.select("sample_id", "gt_idx", F.col("r.gt_labels").cast("long").alias("cls"), *boxes)


def original_size(samples: DataFrame, size: int = SIZE) -> DataFrame:
    return samples.select("sample_id", F.array(F.lit(float(size)).cast("float"), F.lit(float(size)).cast("float")).alias("orig_size"))


def sized_boxes(boxes: DataFrame, min_width: float = 20, min_height: float = 20, max_side: float = 9999) -> DataFrame:
    """Boxes (w, h in pixels) whose sides lie within the limits, both included."""
    return boxes.where((F.col("w") >= min_width) & (F.col("h") >= min_height) & (F.greatest("w", "h") <= max_side))
