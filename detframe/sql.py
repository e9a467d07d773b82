"""The engine from SQL: scalar functions, inlined by the optimiser, and table functions that take a sample at a time.

`register(spark)` makes them temporary functions of the session:

- box forms: `xyxy(box)` of cx, cy, w, h and `cxcywh(box)` of corners; `normalized_box(box, width, height)` of pixels x, y, w, h;
  `clip01(x)`
- overlap of corner boxes: `iou(a, b)` (union at least 1e-6), `iou_exact(a, b)` and `giou(a, b)` (NaN for empty ones),
  `checked_giou(a, b)` (an error for swapped corners), `l1(a, b)`
- `class_name(index)`, `subset_of(path)`
- losses and costs of one number: `sigmoid(x)`, `focal_class_cost(p, alpha, gamma)`, `bce_with_logits(x, target)`
- table functions over `TABLE(...) PARTITION BY sample_id`: `match_boxes` (sample_id, gt_idx, query_idx, cost: a cheapest
  one-to-one assignment), `greedy_pairs` (sample_id, gt_idx, pred_idx, iou: best ground truth of each prediction), and
  `cluster_boxes` (sample_id and a cluster). A sample has at most 400 x 300 pairs. A partition of `match_boxes` is one sample;
  the other two read Arrow batches, and a partition may also be a block of samples in order, which is faster for many small
  samples: `PARTITION BY pmod(xxhash64(sample_id), 4096) ORDER BY sample_id`. A block without that order is an error.

Boxes are arrays of four doubles. The scalar functions are SQL expressions, so filters and projections see through them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.clustering import CLUSTER, EPS, LEAST, NAMES, TYPES, clusters_of
from .operators.matching import assign
from .operators.samples import CATEGORIES

_INTER = "greatest(least(a[2], b[2]) - greatest(a[0], b[0]), 0D) * greatest(least(a[3], b[3]) - greatest(a[1], b[1]), 0D)"
_AREAS = "(a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1])"
_HULL = "(greatest(a[2], b[2]) - least(a[0], b[0])) * (greatest(a[3], b[3]) - least(a[1], b[1]))"
_NAN = "double('NaN')"
_INTER_AREAS = "overlap_area(a, b), summed_area(a, b)"
_GIOU = f"giou_of({_INTER_AREAS}, hull_area(a, b))"
_NAMES = ", ".join(f"'{n}'" for _, n, _ in sorted(CATEGORIES, key=lambda c: c[2]))
_TWO, _BOX = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "box ARRAY<DOUBLE>"
#: Name, parameters, result and body of each scalar function.
SCALARS = (
    ("xyxy", _BOX, "ARRAY<DOUBLE>", "array(box[0] - box[2] / 2, box[1] - box[3] / 2, box[0] + box[2] / 2, box[1] + box[3] / 2)"),
    ("cxcywh", _BOX, "ARRAY<DOUBLE>", "array((box[0] + box[2]) / 2, (box[1] + box[3]) / 2, box[2] - box[0], box[3] - box[1])"),
    ("normalized_box", f"{_BOX}, width DOUBLE, height DOUBLE", "ARRAY<DOUBLE>", "array((box[0] + box[2] / 2) * (640D / width) / 640, (box[1] + box[3] / 2) * (640D / height) / 640, box[2] * (640D / width) / 640, box[3] * (640D / height) / 640)"),
    ("clip01", "x DOUBLE", "DOUBLE", "least(greatest(x, 0D), 1D)"),
    # Parts of the overlaps, functions of their own: the optimiser makes an argument a column below, once a row, where a text
    # in several places is compiled anew in each of them.
    ("overlap_area", _TWO, "DOUBLE", _INTER),
    ("summed_area", _TWO, "DOUBLE", _AREAS),
    ("hull_area", _TWO, "DOUBLE", _HULL),
    ("ratio_of", "inter DOUBLE, both DOUBLE", "DOUBLE", f"CASE WHEN both = 0 THEN {_NAN} ELSE try_divide(inter, both) END"),
    ("enclosed_of", "inter DOUBLE, both DOUBLE, hull DOUBLE", "DOUBLE", f"CASE WHEN hull = 0 THEN {_NAN} ELSE CASE WHEN both = 0 THEN {_NAN} ELSE try_divide(inter, both) END - try_divide(hull - both, hull) END"),
    ("giou_of", "inter DOUBLE, areas DOUBLE, hull DOUBLE", "DOUBLE", "enclosed_of(inter, areas - inter, hull)"),
    ("exact_of", "inter DOUBLE, areas DOUBLE", "DOUBLE", "ratio_of(inter, areas - inter)"),
    ("clamped_of", "inter DOUBLE, areas DOUBLE", "DOUBLE", "inter / greatest(areas - inter, 1e-6D)"),
    ("iou", _TWO, "DOUBLE", f"clamped_of({_INTER_AREAS})"),
    ("iou_exact", _TWO, "DOUBLE", f"exact_of({_INTER_AREAS})"),
    ("giou", _TWO, "DOUBLE", _GIOU),
    ("checked_giou", _TWO, "DOUBLE", f"CASE WHEN a[2] >= a[0] AND a[3] >= a[1] AND b[2] >= b[0] AND b[3] >= b[1] THEN {_GIOU} ELSE double(raise_error('box corners out of order')) END"),
    ("l1", _TWO, "DOUBLE", "abs(a[0] - b[0]) + abs(a[1] - b[1]) + abs(a[2] - b[2]) + abs(a[3] - b[3])"),
    ("class_name", "index INT", "STRING", f"coalesce(CASE WHEN index >= 0 THEN get(array({_NAMES}), index) END, 'Unknown')"),
    ("sigmoid", "x DOUBLE", "DOUBLE", "1 / (1 + exp(-x))"),
    ("focal_class_cost", "p DOUBLE, alpha DOUBLE, gamma DOUBLE", "DOUBLE", "alpha * power(1 - p, gamma) * -ln(p + 1e-8D) - (1 - alpha) * power(p, gamma) * -ln(1 - p + 1e-8D)"),
    ("bce_with_logits", "x DOUBLE, target DOUBLE", "DOUBLE", "greatest(x, 0D) - x * target + ln(1 + exp(-abs(x)))"),
)


class MatchBoxes:
    """Rows (sample_id, gt_idx, query_idx, cost) of one sample -> those of its cheapest assignment."""

    def __init__(self):
        self.rows: list[tuple] = []

    def eval(self, row) -> None:
        self.rows.append((row["sample_id"], row["gt_idx"], row["query_idx"], row["cost"]))

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        gts, queries = sorted({r[1] for r in self.rows}), sorted({r[2] for r in self.rows})
        at_g, at_q = {g: i for i, g in enumerate(gts)}, {q: i for i, q in enumerate(queries)}
        cost = np.full((len(gts), len(queries)), 1e12)
        for _, g, q, c in self.rows:
            cost[at_g[g], at_q[q]] = 1e12 if c is None or c != c else c
        pairs = enumerate(assign(cost)) if len(gts) <= len(queries) else ((g, q) for q, g in enumerate(assign(cost.T)))
        for g, q in sorted((int(g), int(q)) for g, q in pairs):
            yield self.rows[0][0], gts[g], queries[q], float(cost[g, q])


class WholeSamples:
    """Arrow batches of a partition, in order of sample_id, as tables of whole samples; the last sample waits for its end."""

    def __init__(self):
        self.open: pa.Table | None = None

    def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = pa.Table.from_batches([batch])
        rows = rows if self.open is None else pa.concat_tables([self.open, rows])
        ids = self.ids(rows)
        if (ids[1:] < ids[:-1]).any():
            raise ValueError("a partition of several samples must be in order: ORDER BY sample_id")
        last = int(np.searchsorted(ids, ids[-1])) if len(ids) else 0
        self.open = rows.slice(last)
        if last:
            yield self.result(rows.slice(0, last).combine_chunks())

    def terminate(self) -> Iterator[pa.Table]:
        if self.open is not None and self.open.num_rows:
            yield self.result(self.open.combine_chunks())

    @staticmethod
    def ids(rows: pa.Table) -> np.ndarray:
        return pc.fill_null(rows.column("sample_id"), np.iinfo(np.int64).min).to_numpy()

    @staticmethod
    def result(rows: pa.Table) -> pa.Table:
        raise NotImplementedError


def _values(rows: pa.Table, name: str, kind) -> np.ndarray:
    column = rows.column(name)
    if column.null_count:
        raise ValueError(f"{name} is null")
    return column.to_numpy().astype(kind)


class GreedyPairs(WholeSamples):
    """Rows (sample_id, gt_idx, pred_idx, iou) of samples -> the best ground truth of each prediction, the first of equals."""

    @staticmethod
    def result(rows):
        ids, gt, pred, iou = WholeSamples.ids(rows), *(_values(rows, c, np.int32) for c in ("gt_idx", "pred_idx")), _values(rows, "iou", float)
        order = np.lexsort((gt, -iou, pred, ids))
        new = np.ones(len(order), bool)
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (pred[order][1:] != pred[order][:-1])
        at = order[new]
        return pa.table({"sample_id": rows.column("sample_id").take(pa.array(at)), "gt_idx": gt[at], "pred_idx": pred[at], "iou": iou[at]})


class ClusterBoxes(WholeSamples):
    """Rows (sample_id, query_idx, label, x1, y1, x2, y2, score) of samples -> their clusters."""

    @staticmethod
    def result(rows):
        ids = WholeSamples.ids(rows)
        sample = np.cumsum(np.r_[0, ids[1:] != ids[:-1]])
        box = np.stack([_values(rows, c, float) for c in ("x1", "y1", "x2", "y2")], 1)
        at, *columns = clusters_of(sample, _values(rows, "query_idx", np.int64), _values(rows, "label", np.int32), box, _values(rows, "score", float), EPS, LEAST, 0.0)
        first = np.searchsorted(sample, at)
        return pa.table([rows.column("sample_id").take(pa.array(first)), *(pa.array(c).cast(t) for c, t in zip(columns, TYPES, strict=True))], ["sample_id", *NAMES])


TABLES = (
    ("match_boxes", F.udtf, MatchBoxes, "sample_id BIGINT, gt_idx INT, query_idx INT, cost DOUBLE"),
    ("greedy_pairs", F.arrow_udtf, GreedyPairs, "sample_id BIGINT, gt_idx INT, pred_idx INT, iou DOUBLE"),
    ("cluster_boxes", F.arrow_udtf, ClusterBoxes, f"sample_id bigint, {CLUSTER}"),
)


def register(spark: SparkSession) -> None:
    """Temporary functions of this session, replacing those of the same names."""
    for name, parameters, result, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION subset_of(path STRING) RETURNS STRING RETURN coalesce(get(split(ltrim('/', path), '/'), 1), '')")
    for name, function, table, result in TABLES:
        spark.udtf.register(name, function(table, returnType=result))
