"""Optimal one-to-one assignment of queries to ground truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import cxcywh_to_xyxy, giou, l1
from ..functions.scalars import focal_class_cost, sigmoid, softmax_at

#: Weights of class, box and overlap cost.
COST_CLASS, COST_BOX, COST_GIOU = 2.0, 5.0, 2.0


def match_costs(queries: DataFrame, gt: DataFrame, focal: bool = True, alpha: float = 0.25, gamma: float = 2.0, costs: tuple = (COST_CLASS, COST_BOX, COST_GIOU), check: bool = True) -> DataFrame:
    """(sample_id, gt_idx, query_idx, cost_class, cost_box, cost_giou, cost) of every pair of a sample.

    queries: sample_id, query_idx, logits (array), cx, cy, w, h. Every pair counts, so nothing is pruned. check: boxes
    with a negative side are an error.
    """
    q = queries.select("sample_id", "query_idx", "logits", *[F.col(c).alias("q" + c) for c in ("cx", "cy", "w", "h")])
    both = gt.join(q, "sample_id")
    p = sigmoid(F.get("logits", F.col("cls").cast("int")).cast("double"))
    by_class = focal_class_cost(p, alpha, gamma) if focal else -softmax_at(F.col("logits"), F.col("cls").cast("int"))
    a, b = [F.col("q" + c) for c in ("cx", "cy", "w", "h")], [F.col(c) for c in ("cx", "cy", "w", "h")]
    both = both.select("sample_id", "gt_idx", "query_idx", by_class.alias("cost_class"), l1(a, b).alias("cost_box"), (-giou(cxcywh_to_xyxy(*a), cxcywh_to_xyxy(*b), check)).alias("cost_giou"))
    by_class, by_box, by_giou = costs
    return both.withColumn("cost", by_box * F.col("cost_box") + by_class * F.col("cost_class") + by_giou * F.col("cost_giou"))


def assign(cost: np.ndarray) -> np.ndarray:
    """For each row of a (G, Q) cost matrix, G <= Q, its column in a cheapest one-to-one assignment.

    Shortest augmenting paths with potentials, O(G^2 Q); the inner minimum is vectorised.
    """
    g, q = cost.shape
    u, v = np.zeros(g), np.zeros(q)
    row_of = np.full(q, -1)
    for start in range(g):
        reach, came = np.full(q, np.inf), np.full(q, -1)
        done = np.zeros(q, bool)
        row, col, base = start, -1, 0.0
        while True:
            d = base + cost[row] - u[row] - v
            better = ~done & (d < reach)
            reach[better], came[better] = d[better], col
            col = int(np.where(done, np.inf, reach).argmin())
            base = reach[col]
            done[col] = True
            if row_of[col] < 0:
                break
            row = row_of[col]
        end = base
        u[start] += end
        for c in np.flatnonzero(done):
            if c != col:
                u[row_of[c]] += end - reach[c]
            v[c] -= end - reach[c]
        while col >= 0:
            before = came[col]
            row_of[col] = start if before < 0 else row_of[before]
            col = before
    out = np.full(g, -1)
    for c in np.flatnonzero(row_of >= 0):
        out[row_of[c]] = c
    return out


def assignments(costs: DataFrame) -> DataFrame:
    """(sample_id, gt_idx, query_idx, cost) of the cheapest assignment of each sample.

    Cost matrices travel as arrays, many samples to an Arrow batch; one is at most 400 x 300.
    """

    @F.pandas_udf("array<int>")
    def solve(g: pd.Series, q: pd.Series, c: pd.Series) -> pd.Series:
        def one(gs, qs, cs):
            (gu, gi), (qu, qi) = np.unique(gs, return_inverse=True), np.unique(qs, return_inverse=True)
            m = np.full((len(gu), len(qu)), 1e12)
            m[gi, qi] = np.nan_to_num(np.asarray(cs, float), nan=1e12)
            if len(gu) <= len(qu):
                return [int(qu[x]) for x in assign(m)]
            back = assign(m.T)
            took = {int(r): int(qu[k]) for k, r in enumerate(back)}
            return [took.get(i, -1) for i in range(len(gu))]

        return pd.Series([one(*x) for x in zip(g, q, c, strict=True)])

    arrays = costs.groupBy("sample_id").agg(F.collect_list(F.struct("gt_idx", "query_idx", "cost")).alias("m"))
    solved = arrays.select("sample_id", F.array_sort(F.array_distinct("m.gt_idx")).alias("gts"), solve("m.gt_idx", "m.query_idx", "m.cost").alias("qs"), "m")
    pick = solved.select("sample_id", "m", F.explode(F.arrays_zip("gts", "qs")).alias("z")).where("z.qs >= 0")
    cost = F.filter("m", lambda x: (x["gt_idx"] == F.col("z.gts")) & (x["query_idx"] == F.col("z.qs")))
    return pick.select("sample_id", F.col("z.gts").alias("gt_idx"), F.col("z.qs").alias("query_idx"), F.get(cost, F.lit(0))["cost"].alias("cost"))


def denoising_matches(gt: DataFrame, positives: DataFrame, groups: int) -> DataFrame:
    """(sample_id, query_idx, gt_idx): the positive queries of each group, in order, get the ground truth again and again.

    positives: sample_id, pos (0-based), query_idx.
    """
    n = gt.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"))
    tiled = positives.join(n, "sample_id").where(F.col("pos") < F.col("n") * groups)
    return tiled.select("sample_id", "query_idx", (F.col("pos") % F.col("n")).cast("int").alias("gt_idx"))
