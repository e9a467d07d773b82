"""Per-sample descriptive metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import coco_to_normalized
from .samples import CATEGORIES, with_valid_class


def sample_profile(samples: DataFrame, annotations: DataFrame, cats: DataFrame, rows=CATEGORIES) -> DataFrame:
    """Counts, area and centre statistics and per-class counts of valid annotations (uncapped).

    One aggregate over the annotations; NaN where a sample has none, and for classes it lacks.
    """
    nan = F.lit(float("nan"))
    valid = with_valid_class(annotations, cats).join(samples.select("sample_id", "width", "height"), "sample_id")
    cx, cy, w, h = coco_to_normalized(*(F.col(c) for c in ("x", "y", "w", "h", "width", "height")))
    v = valid.select("sample_id", "cls", cx.alias("cx"), cy.alias("cy"), (w * h).alias("area"))
    aggs = [F.count(F.lit(1)).alias("n_objects"), F.count_distinct("cls").alias("n_classes")]
    aggs += [f("area").alias(f"area_{n}") for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max), ("var", F.var_pop))]
    aggs += [f(c).alias(f"{c}_{n}") for c in ("cx", "cy") for n, f in (("mean", F.avg), ("median", F.median))]
    aggs += [(F.var_pop("cx") + F.var_pop("cy")).alias("center_var")]
    aggs += [F.sum((F.col("cls") == idx).cast("int")).alias(f"n_{name}") for _, name, idx in rows]
    stats = v.groupBy("sample_id").agg(*aggs)
    out = samples.select("sample_id").join(stats, "sample_id", "left")
    names = [c for c in stats.columns if c not in ("sample_id", "n_objects", "n_classes")]
    classes = {f"n_{name}" for _, name, _ in rows}
    filled = [F.when(F.coalesce(F.col(c), F.lit(0)) == 0, nan).otherwise(F.col(c).cast("double")).alias(c) if c in classes else F.coalesce(F.col(c), nan).alias(c) for c in names]
    return out.select("sample_id", F.coalesce("n_objects", F.lit(0)).alias("n_objects"), F.coalesce("n_classes", F.lit(0)).alias("n_classes"), *filled)
