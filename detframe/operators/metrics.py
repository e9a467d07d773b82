"""Per-sample detection metrics and confusion elements.

Everything is keyed by sample_id, so one exchange of each input serves the pair join, the windows and the
aggregates. Precision and recall follow the greedy rule in closed form: each prediction proposes only its best
ground truth, so the true positives are the distinct proposed ones at or above the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import reached
from .pairs import iou_of, overlap, pairs, per_sample
from .samples import class_name

IOU_THRESHOLD = 0.1
#: The bucket of ground truth among score points, below all others.
GROUND_TRUTH = -(1 << 40)


def _nan():
    return F.lit(float("nan"))


def scored_pairs(pair: DataFrame) -> DataFrame:
    """Pairs with best (this is the prediction's best ground truth) and top (it reaches the prediction's maximum)."""
    own = Window.partitionBy("sample_id", "pred_idx")
    rank = F.row_number().over(own.orderBy(F.desc("iou"), "gt_idx"))
    return pair.withColumn("best", rank == 1).withColumn("top", F.col("iou") == F.max("iou").over(own))


def sample_metrics(samples: DataFrame, gt: DataFrame, pred: DataFrame, threshold: float = IOU_THRESHOLD) -> DataFrame:
    """sample_id, precision, recall, f1, fp, tp, fn, iou, accuracy; NaN where a side is empty (see the branches)."""
    s = scored_pairs(pairs(gt, pred))
    picked = F.max(F.when(F.col("top"), F.struct("iou", -F.col("pred_idx"), "pred_label")))
    by_gt = s.groupBy("sample_id", "gt_idx").agg(
        F.max((F.col("best") & (F.col("iou") >= threshold)).cast("int")).alias("hit"),
        F.max(F.when(F.col("top"), F.col("iou"))).alias("top_iou"), picked["pred_label"].alias("picked"), F.first("gt_cls").alias("cls"),
    )
    per_pred = pred.groupBy("sample_id").agg(F.count(F.lit(1)).alias("p"), F.max(F.when(F.col("pred_idx") == 0, F.col("label"))).alias("first_label"))
    # Ground truth that no prediction picked is compared with the first prediction: of all ground truth that
    # equals it, those picked are taken off again. So every join is on sample_id alone.
    first = (F.col("first_label") == F.col("cls")).cast("int")
    chosen = F.col("picked").isNotNull()
    per_gt = gt.select("sample_id", "cls").join(per_pred, "sample_id", "left").groupBy("sample_id").agg(F.count(F.lit(1)).alias("g"), F.sum(first).alias("like_first"))
    per_pick = by_gt.join(per_pred, "sample_id").groupBy("sample_id").agg(
        F.sum("hit").alias("tp"), F.sum("top_iou").alias("iou_sum"), F.sum((F.col("picked") == F.col("cls")).cast("int")).alias("right"), F.sum(F.when(chosen, first)).alias("picked_like_first"),
    )
    m = samples.select("sample_id").join(per_gt, "sample_id", "left").join(per_pick, "sample_id", "left").join(per_pred, "sample_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    accuracy = F.try_divide(count("like_first") - count("picked_like_first") + count("right"), "g")
    m = m.select("sample_id", F.try_divide(F.coalesce("iou_sum", F.lit(0.0)), "g").alias("iou"), accuracy.alias("accuracy"), *[count(c).alias(c) for c in ("g", "p", "tp")])
    fp, fn = F.col("p") - F.col("tp"), F.col("g") - F.col("tp")
    precision, recall = F.try_divide("tp", "p"), F.try_divide("tp", "g")
    no_gt, no_pred = F.col("g") == 0, F.col("p") == 0
    f1 = F.when(F.col("tp") > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    return m.select(
        "sample_id",
        F.when(no_pred, _nan()).otherwise(precision).alias("precision"),
        F.when(no_gt, _nan()).otherwise(recall).alias("recall"),
        f1.alias("f1"), fp.cast("int").alias("fp"), F.col("tp").cast("int").alias("tp"), fn.cast("int").alias("fn"),
        F.when(no_gt & no_pred, 1.0).when(no_gt | no_pred, 0.0).otherwise(F.col("iou")).alias("iou"),
        F.when(no_gt & no_pred, 1.0).when(no_gt | no_pred, 0.0).otherwise(F.col("accuracy")).alias("accuracy"),
    )


def confusion_elements(samples: DataFrame, gt: DataFrame, pred: DataFrame, threshold: float = IOU_THRESHOLD) -> DataFrame:
    """sample_id, elem_kind, class_name, polarity, confidence; here the threshold is exclusive.

    A detected prediction counts under the class of its best ground truth. Samples without ground truth give
    one `Unknown` and one `background` element and leave their predictions out.
    """
    d = per_sample(gt, pred, spine=samples)
    kind = "array<struct<kind:string,cls:int,name:string,polarity:string,confidence:double>>"
    element = lambda kind, cls, name, polarity, confidence: F.struct(F.lit(kind), cls.cast("int"), F.lit(name), polarity, confidence)
    near = lambda a, b: overlap(a, b) & (iou_of(a, b) > threshold)
    best = lambda p: F.array_max(F.transform(F.filter("gts", lambda g: near(g, p)), lambda g: F.struct(iou_of(g, p), -g["gt_idx"], g["cls"].alias("cls"))))["cls"]
    found = F.transform("preds", lambda p: F.struct(p["label"].alias("label"), p["score"].alias("score"), best(p).alias("cls")))
    of_pred = F.transform(found, lambda p: element("prediction", F.coalesce(p["cls"], p["label"]), None, F.when(p["cls"].isNotNull(), "Positive").otherwise("Negative"), p["score"]))
    positive, zero, no_class = F.lit("Positive"), F.lit(0.0), F.lit(None)
    missed = F.filter("gts", lambda g: ~F.exists(F.coalesce("preds", F.array()), lambda p: near(g, p)))
    of_gt = F.transform(missed, lambda g: element("ground truth", g["cls"], None, positive, zero))
    no_gt, background = element("ground truth", no_class, "Unknown", positive, zero), element("background", no_class, "background", positive, zero)
    none = F.array().cast(kind)
    elements = F.when(F.col("gts").isNull(), F.array(no_gt, background).cast(kind)).otherwise(
        F.concat(F.coalesce(of_pred.cast(kind), none), of_gt.cast(kind), F.when(F.size(of_gt) == F.size("gts"), F.array(background).cast(kind)).otherwise(none))
    )
    e = d.select("sample_id", F.inline(elements).alias("elem_kind", "cls", "name", "polarity", "confidence"))
    return e.select("sample_id", "elem_kind", F.coalesce("name", class_name(F.col("cls"))).alias("class_name"), "polarity", "confidence")


def confusion_matrix(elements: DataFrame) -> DataFrame:
    return elements.groupBy("class_name", "polarity").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("mean_confidence"))


def metrics_rollup(metrics: DataFrame, samples: DataFrame) -> DataFrame:
    """Sums by state and subset with subtotals; level 0 is one subset, 1 a state, 3 everything."""
    joined = metrics.join(samples.select("sample_id", "state", "subset"), "sample_id")
    return joined.rollup("state", "subset").agg(F.grouping_id().cast("int").alias("level"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("f1").alias("mean_f1"))


def average_precision(gt: DataFrame, pred: DataFrame, threshold: float = 0.5, buckets: int = 256) -> DataFrame:
    """AP per class: area under the interpolation-free precision-recall curve, over all samples.

    Predictions match per sample and class by falling score, once per ground truth. Curves are summed over
    score buckets first, so no class runs through one task row by row; within a bucket rows are ordered. Buckets end at
    quantiles of all scores, so that a detector whose scores crowd together fills them evenly, too.
    """
    fits = lambda g, p: (g["cls"] == p["label"]) & overlap(g, p) & (iou_of(g, p) >= threshold)
    best = lambda p: F.array_max(F.transform(F.filter("gts", lambda g: fits(g, p)), lambda g: F.struct(iou_of(g, p), (-g["gt_idx"]).alias("g"))))["g"]
    d = per_sample(gt, pred).withColumn("proposed", F.transform("preds", lambda p: F.coalesce(best(p), F.lit(1))))  # 1: none
    # Of the predictions that propose one ground truth the first is right.
    first = lambda i: (F.get("proposed", i) <= 0) & (F.array_position("proposed", F.get("proposed", i)) == i + 1)
    kind = "array<struct<label:int,score:double,tp:int>>"
    of_pred = F.transform("preds", lambda p, i: F.struct(p["label"], p["score"], F.coalesce(first(i), F.lit(False)).cast("int"))).cast(kind)
    # Ground truth rides along as points beyond all scores, so that one aggregate serves both.
    of_gt = F.transform("gts", lambda g: F.struct(g["cls"], F.lit(float("inf")), F.lit(0))).cast(kind)
    none = F.array().cast(kind)
    scored = d.select(F.inline(F.concat(F.coalesce(of_pred, none), F.coalesce(of_gt, none))))
    # Equal scores are one point of the curve.
    points = scored.groupBy("label", "score").agg(F.sum("tp").alias("tp"), F.count(F.lit(1)).alias("n"))
    quantiles = F.percentile_approx(F.when(F.col("score") < float("inf"), F.col("score")), [i / buckets for i in range(1, buckets)], 100 * buckets)
    # All columns are read and no row is filtered out, so that the cuts come from the points' own exchange.
    cuts = points.agg(F.struct(quantiles.alias("cuts"), F.max("tp"), F.max("n")).alias("c")).scalar()["cuts"]
    points = points.withColumn("cuts", cuts)
    points = points.withColumn("bucket", F.when(F.col("score") == float("inf"), GROUND_TRUTH).otherwise(buckets - reached(F.col("cuts"), F.col("score"), buckets))).drop("cuts")
    real = F.col("bucket") != GROUND_TRUTH
    sums = points.groupBy("label", "bucket").agg(F.sum("tp").alias("btp"), F.sum("n").alias("bn"))
    so_far = Window.partitionBy("label").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(F.when(real, F.col(c))).over(so_far), F.lit(0))
    sums = sums.select(F.col("label").alias("of_label"), F.col("bucket").alias("of_bucket"), before("btp").alias("tp0"), before("bn").alias("n0"))
    inside = Window.partitionBy("label", "bucket").orderBy(F.desc("score"))
    curve = points.withColumn("ctp", F.sum("tp").over(inside)).withColumn("cn", F.sum("n").over(inside))
    # An equality that takes nulls puts no filter below the points: both sides read one exchange of them.
    curve = curve.join(sums, F.col("label").eqNullSafe(F.col("of_label")) & F.col("bucket").eqNullSafe(F.col("of_bucket")))
    area = F.sum(F.when(real, F.col("tp") * (F.col("ctp") + F.col("tp0")) / (F.col("cn") + F.col("n0"))))
    total = curve.groupBy("label").agg(F.sum(F.when(~real, F.col("n"))).alias("n_gt"), area.alias("area")).where("n_gt > 0")
    return total.select(class_name(F.col("label")).alias("class_name"), "n_gt", F.coalesce(F.col("area") / F.col("n_gt"), F.lit(0.0)).alias("ap"))
