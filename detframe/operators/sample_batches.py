"""Plug-ins over whole samples in Arrow batches: what the column forms of metrics and profile give, many samples at once.

A row is a sample with a list for each field of its annotations and predictions. Lists are laid end to end, so that
numpy ranks, pairs and sums the boxes of all samples of a batch in a few calls; Spark gathers the rows and spreads them.
Batches are cut so that no more than PAIRS pairs of boxes are held at a time (one sample's at least, which the caps bound).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .gt import MAX_GT, SIZE
from .metrics import IOU_THRESHOLD
from .preds import THRESHOLD, TOP_K
from .samples import CATEGORIES

PAIRS = 1 << 20
#: Fields of each side, and which of them are whole numbers.
FIELDS = {"annotations": ("ann_pos", "category_id", "x", "y", "w", "h"), "predictions": ("query_idx", "label", "x1", "y1", "x2", "y2", "score")}
WHOLE = ("ann_pos", "category_id", "query_idx", "label")
_KINDS, _POLARITIES = ("background", "ground truth", "prediction"), ("Negative", "Positive")
#: Class names in text order, as elements are sorted.
_NAMES = sorted([*(n for _, n, _ in CATEGORIES), "Unknown", "background"])


class Boxes:
    """The boxes of one side, laid end to end in order of the sample's row; of: the row of each box."""

    def __init__(self, rows: int, of: np.ndarray, columns: dict[str, np.ndarray]):
        self.rows, self.of, self.columns = rows, of, columns

    def __getattr__(self, name: str) -> np.ndarray:
        try:
            return self.__dict__["columns"][name]
        except KeyError:
            raise AttributeError(name) from None

    def take(self, which: np.ndarray) -> Boxes:
        return Boxes(self.rows, self.of[which], {n: c[which] for n, c in self.columns.items()})

    @property
    def counts(self) -> np.ndarray:
        return np.bincount(self.of, minlength=self.rows)

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts

    @property
    def places(self) -> np.ndarray:
        """Of each box, from 0 in its sample."""
        return np.arange(len(self.of)) - self.starts[self.of]


def _side(batch: pa.RecordBatch, side: str) -> Boxes:
    lists = {f: batch.column(f"{side}_{f}") for f in FIELDS[side]}
    sizes = pc.fill_null(pc.list_value_length(next(iter(lists.values()))), 0).to_numpy(zero_copy_only=False)
    return Boxes(batch.num_rows, np.repeat(np.arange(batch.num_rows), sizes), {f: c.flatten().to_numpy(zero_copy_only=False) for f, c in lists.items()})


def _valid(batch: pa.RecordBatch, categories) -> Boxes:
    """Annotations of known categories in file order: cls, and cx, cy, nw, nh as coco_to_normalized has them."""
    a = _side(batch, "annotations")
    ids, indexes = (np.array(x, np.int64) for x in zip(*sorted((c, i) for c, _, i in categories), strict=True))
    at = np.minimum(np.searchsorted(ids, a.category_id), len(ids) - 1)
    known = ids[at] == a.category_id
    a.columns["cls"] = indexes[at]
    a = a.take(known)
    a = a.take(np.lexsort((a.ann_pos, a.of)))
    sx, sy = (SIZE / batch.column(c).to_numpy(zero_copy_only=False)[a.of] for c in ("width", "height"))
    a.columns |= {"cx": (a.x + a.w / 2) * sx / SIZE, "cy": (a.y + a.h / 2) * sy / SIZE, "nw": a.w * sx / SIZE, "nh": a.h * sy / SIZE}
    return a


def _top(batch: pa.RecordBatch) -> Boxes:
    p = _side(batch, "predictions")
    p = p.take(p.score.astype(np.float32) >= np.float32(THRESHOLD))
    p = p.take(np.lexsort((p.query_idx, -p.score, p.of)))
    return p.take(p.places < TOP_K)


def _first(keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    return np.flatnonzero(np.diff(keys, prepend=-1))


class Matched:
    """Ground truth, predictions, and their overlapping pairs (g, p, iou) of a batch; best: of each prediction the pair of
    highest IoU, then lowest ground truth."""

    def __init__(self, valid: Boxes, pred: Boxes):
        self.gt, self.pred = gt, pred = valid.take(valid.places < MAX_GT), pred
        near = pred.counts[gt.of]
        g = np.repeat(np.arange(len(gt.of)), near)
        p = np.arange(len(g)) - np.repeat(np.cumsum(near) - near, near) + pred.starts[gt.of][g]
        a = [gt.cx - gt.nw / 2, gt.cy - gt.nh / 2, gt.cx + gt.nw / 2, gt.cy + gt.nh / 2]
        b = [c / SIZE for c in (pred.x1, pred.y1, pred.x2, pred.y2)]
        meet = (a[0][g] < b[2][p]) & (b[0][p] < a[2][g]) & (a[1][g] < b[3][p]) & (b[1][p] < a[3][g])
        self.g, self.p = g, p = g[meet], p[meet]
        a, b = [c[g] for c in a], [c[p] for c in b]
        inter = np.maximum(np.minimum(a[2], b[2]) - np.maximum(a[0], b[0]), 0) * np.maximum(np.minimum(a[3], b[3]) - np.maximum(a[1], b[1]), 0)
        self.iou = inter / np.maximum((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - inter, 1e-6)
        order = np.lexsort((g, -self.iou, p))
        self.best = order[_first(p[order])]


def _sums(of: np.ndarray, values: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(of, weights=values, minlength=rows)


def sample_metrics(m: Matched) -> pa.StructArray:
    """See metrics.sample_metrics."""
    gt, pred, rows = m.gt, m.pred, m.gt.rows
    g, p = gt.counts, pred.counts
    hit = np.unique(m.g[m.best][m.iou[m.best] >= IOU_THRESHOLD])
    tp = np.bincount(gt.of[hit], minlength=rows)
    highest = np.zeros(len(pred.of))
    highest[m.p[m.best]] = m.iou[m.best]
    top = np.flatnonzero(m.iou == highest[m.p])
    top = top[np.lexsort((m.p[top], -m.iou[top], m.g[top]))]
    pick = top[_first(m.g[top])]
    chosen = m.g[pick]
    right = pred.label[m.p[pick]] == gt.cls[chosen]
    # Ground truth that no prediction picked is compared with the first prediction.
    label = np.zeros(rows, np.int64)
    label[p > 0] = pred.label[pred.starts[p > 0]]
    like = (label[gt.of] == gt.cls) & (p > 0)[gt.of]
    like[chosen] = right
    with np.errstate(divide="ignore", invalid="ignore"):
        precision, recall = np.where(p > 0, tp / p, np.nan), np.where(g > 0, tp / g, np.nan)
        f1 = np.where(tp > 0, 2 * precision * recall / (precision + recall), 0.0)
        iou, accuracy = _sums(gt.of[chosen], m.iou[pick], rows) / g, _sums(gt.of, like, rows) / g
    none, either = (g == 0) & (p == 0), (g == 0) | (p == 0)
    iou, accuracy = (np.where(none, 1.0, np.where(either, 0.0, v)) for v in (iou, accuracy))
    fp, tp, fn = (c.astype(np.int32) for c in (p - tp, tp, g - tp))
    return pa.StructArray.from_arrays([pa.array(c) for c in (precision, recall, f1, fp, tp, fn, iou, accuracy)], ["precision", "recall", "f1", "fp", "tp", "fn", "iou", "accuracy"])


def confusion_elements(m: Matched) -> pa.ListArray:
    """See metrics.confusion_elements; the elements of a sample in order."""
    gt, pred, rows = m.gt, m.pred, m.gt.rows
    name = {n: _NAMES.index(n) for n in _NAMES}
    by_class = np.full(1 + max(i for *_, i in CATEGORIES), name["Unknown"])
    by_class[[i for *_, i in CATEGORIES]] = [name[n] for _, n, _ in CATEGORIES]
    named = lambda c: np.where((c >= 0) & (c < len(by_class)), by_class[np.clip(c, 0, len(by_class) - 1)], name["Unknown"])
    near = m.iou > IOU_THRESHOLD
    found = m.best[near[m.best]]
    cls, seen = pred.label.copy(), np.zeros(len(pred.of), np.int64)
    cls[m.p[found]], seen[m.p[found]] = gt.cls[m.g[found]], 1
    g = gt.counts
    own = g[pred.of] > 0
    missed = np.ones(len(gt.of), bool)
    missed[m.g[near]] = False
    empty, alone = np.flatnonzero(g == 0), np.flatnonzero(np.bincount(gt.of[missed], minlength=rows) == g)
    parts = (
        (pred.of[own], 2, named(cls[own]), seen[own], pred.score[own]), (gt.of[missed], 1, named(gt.cls[missed]), 1, 0.0),
        (empty, 1, name["Unknown"], 1, 0.0), (alone, 0, name["background"], 1, 0.0),
    )
    of, kind, called, polarity, confidence = (np.concatenate([np.broadcast_to(part[k], len(part[0])) for part in parts]) for k in range(5))
    order = np.lexsort((confidence, polarity, called, kind, of))
    texts = [pa.array(t, pa.string()).take(pa.array(c[order])) for t, c in ((_KINDS, kind), (_NAMES, called), (_POLARITIES, polarity))]
    elements = pa.StructArray.from_arrays([*texts, pa.array(confidence[order])], ["elem_kind", "class_name", "polarity", "confidence"])
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=rows)))), pa.int32()), elements)


def sample_profile(v: Boxes, rows=CATEGORIES) -> pa.StructArray:
    """See profile.sample_profile; of all valid annotations."""
    n, starts = v.counts, v.starts
    some = n > 0
    nothing = np.full(v.rows, np.nan)

    def of_some(values: np.ndarray) -> np.ndarray:
        out = nothing.copy()
        out[some] = values
        return out

    def stats(values: np.ndarray) -> tuple:
        mean = _sums(v.of, values, v.rows)[some] / n[some]
        mean = of_some(mean)
        ordered = values[np.lexsort((values, v.of))]
        low, high = starts[some] + (n[some] - 1) // 2, starts[some] + n[some] // 2
        median = ordered[low] + (ordered[high] - ordered[low]) / 2
        var = _sums(v.of, (values - mean[v.of]) ** 2, v.rows)[some] / n[some]
        return mean, of_some(median), of_some(ordered[starts[some]]), of_some(ordered[starts[some] + n[some] - 1]), of_some(var)

    area, cx, cy = stats(v.nw * v.nh), stats(v.cx), stats(v.cy)
    classes = [np.bincount(v.of[v.cls == i], minlength=v.rows) for *_, i in rows]
    order = np.lexsort((v.cls, v.of))
    other = (np.diff(v.of[order], prepend=-1) != 0) | (np.diff(v.cls[order], prepend=0) != 0)
    out = {"n_objects": n, "n_classes": np.bincount(v.of[order][other], minlength=v.rows)}
    out |= {f"area_{k}": c for k, c in zip(("mean", "median", "min", "max", "var"), area, strict=True)}
    out |= {"cx_mean": cx[0], "cx_median": cx[1], "cy_mean": cy[0], "cy_median": cy[1], "center_var": cx[4] + cy[4]}
    out |= {f"n_{name}": np.where(c > 0, c, np.nan) for (_, name, _), c in zip(rows, classes, strict=True)}
    return pa.StructArray.from_arrays([pa.array(c) for c in out.values()], list(out))


def _cut(batch: pa.RecordBatch):
    """Slices of whole samples with PAIRS pairs at most; larger samples alone."""
    size = lambda side: pc.fill_null(pc.list_value_length(batch.column(f"{side}_{FIELDS[side][0]}")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(size("annotations") * size("predictions"))
    at, done = 0, 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        yield batch.slice(at, to - at)
        at, done = to, int(ends[to - 1])


def evaluated(batches, wanted: dict[str, str], categories=CATEGORIES):
    """sample_id and a column for each wanted one: its name here by its name there."""
    for whole in batches:
        for batch in _cut(whole):
            valid = _valid(batch, categories)
            matched = Matched(valid, _top(batch)) if set(wanted.values()) & {"sample_metrics", "confusion_elements"} else None
            made = {"sample_metrics": lambda m=matched: sample_metrics(m), "confusion_elements": lambda m=matched: confusion_elements(m), "sample_profile": lambda v=valid: sample_profile(v, CATEGORIES)}
            yield pa.RecordBatch.from_arrays([batch.column("sample_id"), *[made[f]() for f in wanted.values()]], ["sample_id", *wanted])
