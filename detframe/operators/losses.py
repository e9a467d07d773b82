"""Criterion losses per sample, from matched pairs and logits, as expressions and sums.

A `head` column (main, aux_i, dn_i, enc_i) rides along where the inputs have it: auxiliary, denoising and
encoder outputs are more rows, not more code.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import cxcywh_to_xyxy, giou, iou, l1
from ..functions.scalars import bce_with_logits, focal_loss, sigmoid
from .matching import COST_BOX, COST_CLASS, COST_GIOU, assignments, denoising_matches, match_costs

#: Weights of the loss components; components without a weight are dropped from totals.
WEIGHTS = {"loss_vfl": 1.0, "loss_bbox": 5.0, "loss_giou": 2.0}
ALPHA, GAMMA = 0.75, 2.0
BOX = ("cx", "cy", "w", "h")


def _keys(d: DataFrame) -> list[str]:
    return ["sample_id", "head"] if "head" in d.columns else ["sample_id"]


def num_boxes(samples: DataFrame, gt: DataFrame, groups: int = 1, world: int = 1, by: str = "sample_id") -> DataFrame:
    """Boxes of each value of `by` (a column of samples) over the number of workers, at least one, times the groups."""
    n = gt.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    each = samples.select("sample_id", *({by} - {"sample_id"})).join(n, "sample_id", "left")
    return each.groupBy(by).agg((F.greatest(F.coalesce(F.sum("n"), F.lit(0)) / world, F.lit(1.0)) * groups).alias("num_boxes"))


def matched_pairs(queries: DataFrame, gt: DataFrame, matches: DataFrame, check: bool = True) -> DataFrame:
    """Matched query and ground-truth boxes with their unclamped IoU and GIoU: pairs only, no matrix.

    check: boxes with a negative side are an error.
    """
    k = _keys(queries)
    q = queries.select(*k, "query_idx", *[F.col(c).alias("q" + c) for c in BOX])
    m = matches.select(*[c for c in k if c in matches.columns], "query_idx", "gt_idx").join(gt, ["sample_id", "gt_idx"]).join(q, [*[c for c in k if c in matches.columns], "query_idx"])
    a, b = [F.col("q" + c) for c in BOX], [F.col(c) for c in BOX]
    corners = cxcywh_to_xyxy(*a), cxcywh_to_xyxy(*b)
    return m.select(*k, "query_idx", "gt_idx", "cls", iou(*corners, clamp=None).alias("iou"), giou(*corners, check).alias("giou"), l1(a, b).alias("l1"))


def _cells(queries: DataFrame, pairs: DataFrame, value: str = "iou") -> DataFrame:
    """One row a logit: its value x, whether it is the matched class (t), and the pair's value (its IoU) there (q)."""
    k = [*_keys(queries), "query_idx"]
    cells = queries.select(*k, F.posexplode("logits").alias("c", "x"))
    j = cells.join(pairs.select(*k, "cls", F.col(value).alias("value")), k, "left")
    hit = F.coalesce(F.col("c") == F.col("cls"), F.lit(False))
    return j.select(*k, F.col("x").cast("double").alias("x"), hit.cast("double").alias("t"), F.when(hit, F.col("value")).otherwise(0.0).alias("q"))


def loss_vfl(queries: DataFrame, pairs: DataFrame, alpha: float = ALPHA, gamma: float = GAMMA, value: str = "iou") -> DataFrame:
    """Varifocal sums, not yet divided by the number of boxes."""
    x, t, q = F.col("x"), F.col("t"), F.col("q")
    weight = alpha * F.pow(sigmoid(x), F.lit(gamma)) * (1 - t) + q
    return _cells(queries, pairs, value).groupBy(*_keys(queries)).agg(F.sum(weight * bce_with_logits(x, q)).alias("loss_vfl"))


def loss_focal(queries: DataFrame, pairs: DataFrame, alpha: float = ALPHA, gamma: float = GAMMA) -> DataFrame:
    return _cells(queries, pairs).groupBy(*_keys(queries)).agg(F.sum(focal_loss(F.col("x"), F.col("t"), alpha, gamma)).alias("loss_focal"))


def loss_boxes(queries: DataFrame, pairs: DataFrame, weight: str | None = None) -> DataFrame:
    """L1 and 1 - GIoU sums; weight is None, `iou` or `giou`, anything else an error."""
    if weight not in (None, "iou", "giou"):
        raise AttributeError(f"no box weight {weight!r}")
    scale = F.col(weight) if weight else F.lit(1.0)
    return pairs.groupBy(*_keys(queries)).agg(F.sum("l1").alias("loss_bbox"), F.sum((1 - F.col("giou")) * scale).alias("loss_giou"))


#: Components by name: of queries, matched pairs, alpha, gamma and the format of box weights (which vfl takes as its value, too).
LOSSES = {
    "vfl": lambda q, p, alpha, gamma, weight: loss_vfl(q, p, alpha, gamma, weight or "iou"),
    "focal": lambda q, p, alpha, gamma, weight: loss_focal(q, p, alpha, gamma),
    "boxes": lambda q, p, alpha, gamma, weight: loss_boxes(q, p, weight),
}


def component_sums(samples: DataFrame, queries: DataFrame, gt: DataFrame, matches: DataFrame, losses=("vfl", "boxes"), alpha: float = ALPHA, gamma: float = GAMMA, box_weight: str | None = None) -> DataFrame:
    """The components' sums for each sample (and head), neither weighted nor divided; an unknown loss is a KeyError."""
    if box_weight not in (None, "iou", "giou"):
        raise AttributeError(f"no box weight {box_weight!r}")
    chosen = [LOSSES[name] for name in losses]
    pairs = matched_pairs(queries, gt, matches)
    k = _keys(queries)
    out = samples.select("sample_id").join(queries.select(*k).distinct(), "sample_id")
    for f in chosen:
        out = out.join(f(queries, pairs, alpha, gamma, box_weight), k, "left")
    return out.select(*k, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in out.columns if c.startswith("loss_")])


def _weighted(sums: DataFrame, keys: list[str], weights: dict) -> DataFrame:
    parts = [c for c in sums.columns if c.startswith("loss_") and c in weights]
    out = sums.select(*keys, *[(F.col(c) / F.col("num_boxes") * weights[c]).alias(c) for c in parts])
    return out.withColumn("total", sum((F.col(c) for c in parts), F.lit(0.0)))


def criterion(samples: DataFrame, queries: DataFrame, gt: DataFrame, matches: DataFrame, losses=("vfl", "boxes"), weights=WEIGHTS, groups: int = 1, **options) -> DataFrame:
    """Weighted components and their total for each sample (and head), as of batches of one; options as of component_sums."""
    sums = component_sums(samples, queries, gt, matches, losses, **options)
    return _weighted(sums.join(num_boxes(samples, gt, groups), "sample_id"), _keys(queries), weights)


def batch_criterion(samples: DataFrame, queries: DataFrame, gt: DataFrame, matches: DataFrame, losses=("vfl", "boxes"), weights=WEIGHTS, groups: int = 1, world: int = 1, **options) -> DataFrame:
    """step, worker (, head), weighted components and total, as training on `world` workers sees them.

    samples: sample_id, step, worker. A worker's sums over its batch of a step are divided by the mean number of boxes
    of a worker in that step, at least one; so a batch without boxes still divides by what the others have. Sums and
    counts are added up by step before they meet.
    """
    keys = ["step", "worker", *_keys(queries)[1:]]
    sums = component_sums(samples, queries, gt, matches, losses, **options).join(samples.select("sample_id", "step", "worker"), "sample_id")
    sums = sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums.columns if c.startswith("loss_")])
    return _weighted(sums.join(num_boxes(samples, gt, groups, world, "step"), "step"), keys, weights)


def class_agnostic(gt: DataFrame) -> DataFrame:
    """Ground truth for class-agnostic encoder losses; matching still uses the original classes."""
    return gt.withColumn("cls", F.lit(0))


def head_losses(samples: DataFrame, gt: DataFrame, main: DataFrame, aux=(), dn=(), positives: DataFrame | None = None, groups: int = 1, enc=(), agnostic: bool = False, share_matches: bool = False, matcher: dict | None = None, **options) -> DataFrame:
    """criterion of every head's queries, with a column head: main, aux_i, dn_i, enc_i.

    Auxiliary heads are matched by themselves or share the main head's matches; denoising heads take the positive
    queries of each group in order and `groups` times the boxes; encoder heads are matched by the original classes,
    and under `agnostic` scored against class 0. Samples without ground truth have the unmatched part of vfl alone.
    """
    match = lambda q: assignments(match_costs(q, gt, **(matcher or {})))
    of_main = match(main)
    heads = [("main", main, gt, of_main, 1)]
    heads += [(f"aux_{i}", q, gt, of_main if share_matches else match(q), 1) for i, q in enumerate(aux)]
    heads += [(f"dn_{i}", q, gt, denoising_matches(gt, positives, groups), groups) for i, q in enumerate(dn)]
    heads += [(f"enc_{i}", q, class_agnostic(gt) if agnostic else gt, match(q), 1) for i, q in enumerate(enc)]
    each = [criterion(samples, q.withColumn("head", F.lit(name)), g, m, groups=n, **options) for name, q, g, m, n in heads]
    return reduce(DataFrame.unionByName, each)


def settings(loss: dict | None) -> tuple[dict, dict]:
    """Options of criterion and of match_costs from a project's `loss` map; what it lacks has the defaults above."""
    loss = loss or {}
    number = lambda d, name, other: float(d.get(name, other))
    weights, m = loss.get("weight_dict") or {}, loss.get("matcher") or {}
    options = {"weights": {k: number(weights, k, v) for k, v in WEIGHTS.items()}, "alpha": number(loss, "alpha", ALPHA), "gamma": number(loss, "gamma", GAMMA)}
    costs = number(m, "cost_class", COST_CLASS), number(m, "cost_bbox", COST_BOX), number(m, "cost_giou", COST_GIOU)
    return options, {"alpha": number(m, "alpha", 0.25), "gamma": number(m, "gamma", 2.0), "costs": costs}
