"""Density clustering of boxes within a sample: DBSCAN with distance 1 - IoU, in Arrow batches.

Definition: two boxes of one class are neighbours if 1 - IoU <= eps; a core box has neighbours (itself
included) whose summed score reaches `least`; clusters are cores connected by neighbourhood, with border boxes
going to the cluster of their best-scored core neighbour. A cluster's box is the score-weighted mean.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


EPS, LEAST = 0.15, 0.05
#: Names and types of a cluster, after its sample.
CLUSTER = "label int, cluster int, n int, score double, x1 double, y1 double, x2 double, y2 double"
NAMES, TYPES = [c.split()[0] for c in CLUSTER.split(", ")], [pa.int32()] * 3 + [pa.float64()] * 5
#: Classes of fewer boxes in a sample are clustered without a matrix. Rows that are clustered at once.
FEW, ROWS = 8, 1 << 16


def _linked(core: list, near) -> list:
    """The first core box of the cluster of each of a class's boxes, best first; -1 for none. near(i): the boxes near i, in order."""
    member = [-1] * len(core)
    for i in range(len(core)):
        if core[i] and member[i] < 0:
            member[i], stack = i, [i]
            while stack:
                for j in near(stack.pop()):
                    if core[j] and member[j] < 0:
                        member[j] = i
                        stack.append(j)
    for i in range(len(core)):
        if not core[i]:
            member[i] = next((member[j] for j in near(i) if core[j]), -1)
    return member


def _of_few(label: int, b: list, s: list, eps: float, least: float, min_height: float) -> list[tuple]:
    """Clusters of fewer than FEW boxes of one class, best first. Sums run in order, as numpy's do for so few."""
    k = len(s)
    near = []
    for i in range(k):
        x1, y1, x2, y2 = b[i]
        own = (x2 - x1) * (y2 - y1)
        row = []
        for j in range(k):
            u1, v1, u2, v2 = b[j]
            iw, ih = min(x2, u2) - max(x1, u1), min(y2, v2) - max(y1, v1)
            inter = iw * ih if iw > 0 and ih > 0 else 0.0
            if 1 - inter / max(own + (u2 - u1) * (v2 - v1) - inter, 1e-6) <= eps:
                row.append(j)
        near.append(row)
    member = _linked([sum((s[j] for j in row), 0.0) >= least for row in near], near.__getitem__)
    out = []
    for n, c in enumerate(sorted({m for m in member if m >= 0})):
        of = [i for i in range(k) if member[i] == c]
        weight, box = 0.0, [0.0] * 4
        for i in of:
            weight += s[i]
            box = [x + y * s[i] for x, y in zip(box, b[i], strict=True)]
        box = [x / weight for x in box]
        if box[3] - box[1] >= min_height:
            out.append((label, n, len(of), max(s[i] for i in of), *box))
    return out


def _of_many(label: int, b: np.ndarray, s: np.ndarray, eps: float, least: float, min_height: float) -> list[tuple]:
    """Clusters of one class's boxes, best first."""
    iw = np.clip(np.minimum(b[:, None, 2], b[None, :, 2]) - np.maximum(b[:, None, 0], b[None, :, 0]), 0, None)
    ih = np.clip(np.minimum(b[:, None, 3], b[None, :, 3]) - np.maximum(b[:, None, 1], b[None, :, 1]), 0, None)
    area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    near = 1 - iw * ih / np.maximum(area[:, None] + area[None, :] - iw * ih, 1e-6) <= eps
    member = np.array(_linked(((near * s).sum(1) >= least).tolist(), lambda i: np.flatnonzero(near[i]).tolist()))
    out = []
    for n, c in enumerate(c for c in np.unique(member) if c >= 0):
        m = member == c
        box = (b[m] * s[m, None]).sum(0) / s[m].sum()
        if box[3] - box[1] >= min_height:
            out.append((label, n, int(m.sum()), float(s[m].max()), *box.tolist()))
    return out


def clusters(rows: list, eps: float = EPS, least: float = LEAST, min_height: float = 0.0) -> list[tuple]:
    """CLUSTER's values of one sample's rows (query_idx, label, x1, y1, x2, y2, score)."""
    classes: dict = {}
    for r in sorted([(-r["score"], r["query_idx"], r["label"], float(r["x1"]), float(r["y1"]), float(r["x2"]), float(r["y2"])) for r in rows], key=lambda r: r[:2]):
        classes.setdefault(r[2], []).append(r)
    out = []
    for label, g in sorted(classes.items()):
        b, s = [r[3:] for r in g], [float(-r[0]) for r in g]
        out += _of_few(int(label), b, s, eps, least, min_height) if len(g) < FEW else _of_many(int(label), np.array(b, float), np.array(s, float), eps, least, min_height)
    return out


def clusters_of(sample: np.ndarray, query: np.ndarray, label: np.ndarray, b: np.ndarray, s: np.ndarray, eps: float, least: float, min_height: float) -> tuple:
    """(sample, label, cluster, n, score, box) of many samples' rows at once, as `clusters` gives them one by one.

    Classes of fewer than FEW boxes are clustered together: their pairs are rows of one table, and the first core box of a
    cluster spreads along near pairs. The others go one by one.
    """
    order = np.lexsort((query, -s, label, sample))
    sample, label, b, s = sample[order], label[order], b[order], s[order]
    first = np.flatnonzero(np.r_[True, (sample[1:] != sample[:-1]) | (label[1:] != label[:-1])]) if len(s) else np.zeros(0, int)
    size = np.diff(np.r_[first, len(s)])
    found = []
    for at, k in zip(first[size >= FEW], size[size >= FEW], strict=True):
        own = _of_many(int(label[at]), b[at : at + k], s[at : at + k], eps, least, min_height)
        found += [(sample[at], *c) for c in own]
    few = np.repeat(size < FEW, size)
    start, count = np.repeat(first, size)[few], np.repeat(size, size)[few]
    i = np.repeat(np.flatnonzero(few), count)
    j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
    iw = np.clip(np.minimum(b[i, 2], b[j, 2]) - np.maximum(b[i, 0], b[j, 0]), 0, None)
    ih = np.clip(np.minimum(b[i, 3], b[j, 3]) - np.maximum(b[i, 1], b[j, 1]), 0, None)
    area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
    near = 1 - iw * ih / np.maximum(area[i] + area[j] - iw * ih, 1e-6) <= eps
    i, j = i[near], j[near]
    core = np.bincount(i, s[j], len(s)) >= least
    i, j = i[core[j]], j[core[j]]
    nobody = len(s)
    member = np.where(core, np.arange(len(s)), nobody)
    linked = core[i]
    while True:
        least_near = member.copy()
        np.minimum.at(least_near, i[linked], member[j[linked]])
        if (least_near == member).all():
            break
        member = least_near
    # Boxes stand best first, so a border box's first core neighbour is its best-scored one.
    border, at = np.unique(i[~linked], return_index=True)
    member[border] = member[j[~linked][at]]
    inside = np.flatnonzero(member < nobody)
    heads, of = np.unique(member[inside], return_inverse=True)
    weight, n = np.bincount(of, s[inside], len(heads)), np.bincount(of, minlength=len(heads))
    box = np.stack([np.bincount(of, b[inside, c] * s[inside], len(heads)) for c in range(4)], 1) / weight[:, None]
    score = np.full(len(heads), -np.inf)
    np.maximum.at(score, of, s[inside])
    # Clusters are numbered in each class by their first core boxes.
    group = np.searchsorted(first, heads, "right")
    rank = np.arange(len(heads)) - np.searchsorted(group, group)
    tall = box[:, 3] - box[:, 1] >= min_height
    columns = [x[tall] for x in (sample[heads], label[heads], rank, n, score, *box.T)]
    return tuple(np.concatenate([x, np.array([f[k] for f in found], x.dtype)]) for k, x in enumerate(columns)) if found else tuple(columns)


def cluster_boxes(pred: DataFrame, eps: float = EPS, least: float = LEAST, min_height: float = 0.0) -> DataFrame:
    """pred(sample_id, label, x1..y2, score) -> sample_id, label, cluster, n, score, x1, y1, x2, y2."""
    kind = pred.schema["sample_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            ends = np.asarray(lists.offsets)[1:] - lists.offsets[0].as_py()
            low = 0
            while low < batch.num_rows:
                before = int(ends[low - 1]) if low else 0
                high = max(low + 1, int(np.searchsorted(ends, before + ROWS, "right")))
                rows = lists.slice(low, high - low)
                flat = rows.flatten()
                sample = low + np.repeat(np.arange(len(rows)), np.diff(np.r_[before, ends[low:high]]))
                of = lambda c: flat.field(c).to_numpy(zero_copy_only=False)  # noqa: B023, E731
                at, *columns = clusters_of(sample, of("query_idx"), flat.field("label").to_numpy(), np.stack([of(c).astype(float) for c in ("x1", "y1", "x2", "y2")], 1), of("score").astype(float), eps, least, min_height)
                arrays = [pa.array(c).cast(t) for c, t in zip(columns, TYPES, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *arrays], ["sample_id", *NAMES])
                low = high

    # A sample holds a bounded number of predictions; many samples share an Arrow batch.
    nested = pred.groupBy("sample_id").agg(F.collect_list(F.struct("query_idx", "label", "x1", "y1", "x2", "y2", "score")).alias("rows"))
    return nested.mapInArrow(run, f"sample_id {kind}, {CLUSTER}")
