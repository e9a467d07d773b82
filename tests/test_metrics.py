"""Metrics against literal loops over random samples, ties and empty sides included."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from detframe.operators import gt as gts
from detframe.operators import losses, matching, metrics, overlay, preds, samples

GT = "sample_id long, gt_idx int, cls int, cx double, cy double, w double, h double"
PRED = "sample_id long, pred_idx int, label int, score double, x1 double, y1 double, x2 double, y2 double"


def iou_loop(g, p):
    ax1, ay1, ax2, ay2 = g[3] - g[5] / 2, g[4] - g[6] / 2, g[3] + g[5] / 2, g[4] + g[6] / 2
    bx1, by1, bx2, by2 = (v / 640 for v in p[4:8])
    inter = max(min(ax2, bx2) - max(ax1, bx1), 0) * max(min(ay2, by2) - max(ay1, by1), 0)
    return inter / max((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter, 1e-6)


def metrics_loop(gs, ps):
    g, p = len(gs), len(ps)
    if not g or not p:
        both = not g and not p
        return (math.nan if not p else 0.0, math.nan if not g else 0.0, 0.0, p, 0, g, float(both), float(both))
    m = np.array([[iou_loop(a, b) for b in ps] for a in gs])
    taken, tp = set(), 0
    for j in range(p):
        i = int(m[:, j].argmax())
        if m[i, j] >= 0.1 and i not in taken:
            taken.add(i)
            tp += 1
    kept = np.where(m == m.max(axis=0), m, 0)
    right = [ps[int(row.argmax())][2] == gs[i][2] for i, row in enumerate(kept)]
    pr, rc = tp / p, tp / g
    return (pr, rc, 2 * pr * rc / (pr + rc) if tp else 0.0, p - tp, tp, g - tp, kept.max(axis=1).mean(), float(np.mean(right)))


def random_case(seed, n=60):
    rng = np.random.default_rng(seed)
    gs, ps = [], []
    for s in range(n):
        for i in range(rng.integers(0, 5)):
            gs.append((s, i, int(rng.integers(0, 6)), *(rng.integers(1, 5, 2) / 8).tolist(), 0.25, 0.25))
        for j in range(rng.integers(0, 6)):
            x, y = (rng.integers(0, 4, 2) * 80).tolist()
            ps.append((s, j, int(rng.integers(0, 6)), 1 - j / 10, float(x), float(y), float(x + 160), float(y + 160)))
    return gs, ps


@pytest.fixture(scope="module")
def case(spark):
    gs, ps = random_case(3)
    return gs, ps, spark.range(60).withColumnRenamed("id", "sample_id"), spark.createDataFrame(gs, GT), spark.createDataFrame(ps, PRED)


def test_sample_metrics(case):
    gs, ps, s, g, p = case
    for r in metrics.sample_metrics(s, g, p).collect():
        want = metrics_loop([x for x in gs if x[0] == r.sample_id], [x for x in ps if x[0] == r.sample_id])
        got = (r.precision, r.recall, r.f1, r.fp, r.tp, r.fn, r.iou, r.accuracy)
        assert all(a == pytest.approx(b, abs=1e-9, nan_ok=True) for a, b in zip(got, want, strict=True)), (r.sample_id, got, want)


def test_confusion_elements(case):
    gs, ps, s, g, p = case
    names = ["small_load_carrier", "forklift", "pallet", "stillage", "pallet_truck"]
    name = lambda c: names[c] if 0 <= c < 5 else "Unknown"
    want = []
    for sid in range(60):
        a, b = [x for x in gs if x[0] == sid], [x for x in ps if x[0] == sid]
        m = np.array([[iou_loop(x, y) for y in b] for x in a]).reshape(len(a), len(b))
        for j, y in enumerate(b if a else []):
            hit = m[:, j].max() > 0.1
            want.append((sid, name(a[int(m[:, j].argmax())][2] if hit else y[2]), "Positive" if hit else "Negative", y[3]))
        seen = [bool(len(b)) and m[i].max() > 0.1 for i in range(len(a))]
        want += [(sid, name(x[2]), "Positive", 0.0) for x, ok in zip(a, seen, strict=True) if not ok]
        want += [(sid, "Unknown", "Positive", 0.0)] if not a else []
        want += [(sid, "background", "Positive", 0.0)] if not any(seen) else []
    got = [(r.sample_id, r.class_name, r.polarity, r.confidence) for r in metrics.confusion_elements(s, g, p).collect()]
    assert sorted(got) == sorted(want)


def test_threshold_is_inclusive_and_drops_nan(spark):
    rows = [(1, 1, 0, 0.0, 0.0, 1.0, 1.0, 0.3), (1, 2, 0, 0.0, 0.0, 1.0, 1.0, float("nan")), (1, 3, 0, 0.0, 0.0, 1.0, 1.0, 0.29), (1, 0, 0, 0.0, 0.0, 1.0, 1.0, 0.3)]
    d = spark.createDataFrame(rows, "sample_id int, query_idx int, label int, x1 double, y1 double, x2 double, y2 double, score double")
    assert [(r.query_idx, r.pred_idx) for r in preds.top_predictions(d).orderBy("pred_idx").collect()] == [(0, 0), (1, 1)]
    assert preds.top_predictions(d, k=1).count() == 1


def test_cap_after_filter_and_padding(spark):
    s = spark.createDataFrame([("a", 100, 100), ("b", 100, 100)], "sample_id string, width int, height int")
    anns = spark.createDataFrame([("a", i, 3 if i % 2 else 99, 10.0, 10.0, 20.0, 20.0) for i in range(1000)], "sample_id string, ann_pos int, category_id int, x double, y double, w double, h double")
    g = gts.ground_truth(s, anns, samples.categories(spark))
    assert g.count() == 400
    dense = {r.sample_id: r for r in gts.padded(s, g).collect()}
    assert len(dense["b"].gt_padded) == 400 and dense["b"].gt_labels[0] == -1 and dense["b"].gt_boxes[0] == [0, 0, 0, 0] and sum(dense["a"].gt_mask) == 400
    assert gts.from_padded(gts.padded(s, g)).count() == 400


def test_assignment_is_optimal(spark):
    rng = np.random.default_rng(5)
    for g, q in [(1, 1), (2, 5), (3, 3), (4, 6)]:
        for _ in range(30):
            c = rng.integers(0, 9, (g, q)).astype(float) - 4
            best = min(sum(c[i, p[i]] for i in range(g)) for p in itertools.permutations(range(q), g))
            a = matching.assign(c)
            assert len(set(a)) == g and sum(c[i, a[i]] for i in range(g)) == best
    costs = spark.createDataFrame([("s", i, j, float((i * 3 + j * 5) % 7)) for i in range(4) for j in range(2)], "sample_id string, gt_idx int, query_idx int, cost double")
    assert matching.assignments(costs).count() == 2  # fewer queries than boxes


def test_losses_without_boxes(spark):
    q = spark.createDataFrame([("s", 0, [0.0, 1.0], 0.5, 0.5, 0.2, 0.2)], "sample_id string, query_idx int, logits array<double>, cx double, cy double, w double, h double")
    g = spark.createDataFrame([], "sample_id string, gt_idx int, cls int, cx double, cy double, w double, h double")
    m = spark.createDataFrame([], "sample_id string, gt_idx int, query_idx int, cost double")
    r = losses.criterion(q.select("sample_id"), q, g, m).first()
    want = sum(0.75 * (1 / (1 + math.exp(-x))) ** 2 * (max(x, 0) + math.log1p(math.exp(-abs(x)))) for x in (0.0, 1.0))
    assert r.loss_vfl == pytest.approx(want) and r.loss_bbox == r.loss_giou == 0 and r.total == pytest.approx(want)
    with pytest.raises(KeyError):
        losses.criterion(q.select("sample_id"), q, g, m, losses=("other",))
    with pytest.raises(AttributeError):
        losses.loss_boxes(q, q, weight="other")


def test_unclamped_iou_of_empty_boxes_is_nan(spark):
    from detframe.functions import boxes

    zero = [F.lit(0.0)] * 4
    r = spark.range(1).select(boxes.iou(zero, zero, None).alias("a"), boxes.iou(zero, zero).alias("b"), boxes.giou(zero, zero).alias("c"), boxes.class_index(F.lit(float("nan"))).alias("d")).first()
    assert math.isnan(r.a) and r.b == 0 and math.isnan(r.c) and r.d == -1
    bad = [F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)]
    with pytest.raises(Exception, match="out of order"):
        spark.range(1).select(boxes.giou(bad, zero, check=True)).collect()


def test_overlay_clips(spark):
    g = spark.createDataFrame([], GT)
    p = spark.createDataFrame([(1, 0, 9, 0.5, -64.0, 0.0, 1280.0, 640.0)], PRED)
    r = overlay.overlay_boxes(g, p).first()
    assert (r.x, r.width, r.label) == (0.5, 1.0, "Unknown")


def test_box_weights(spark):
    q = spark.createDataFrame([(1, 0, [0.5, -1.0], 0.5, 0.5, 0.5, 0.5), (1, 1, [0.0, 2.0], 0.2, 0.2, 0.1, 0.1)], "sample_id long, query_idx int, logits array<double>, cx double, cy double, w double, h double")
    g = spark.createDataFrame([(1, 0, 1, 0.5, 0.5, 0.5, 0.25)], GT)
    m = spark.createDataFrame([(1, 0, 0)], "sample_id long, query_idx int, gt_idx int")
    got = {w: losses.criterion(q.select("sample_id").distinct(), q, g, m, weights={"loss_vfl": 1.0, "loss_giou": 1.0}, box_weight=w).first() for w in (None, "iou", "giou")}
    iou = giou = 0.5  # one box holds the other, so the hull is the union
    assert [got[w].loss_giou for w in (None, "iou", "giou")] == pytest.approx([1 - giou, (1 - giou) * iou, (1 - giou) * giou])
    assert got["iou"].loss_vfl == pytest.approx(got[None].loss_vfl) == pytest.approx(got["giou"].loss_vfl)
    with pytest.raises(AttributeError):
        losses.criterion(q.select("sample_id").distinct(), q, g, m, box_weight="other")


def test_swapped_corners_are_an_error(spark):
    q = spark.createDataFrame([(1, 0, [0.1] * 5, 0.5, 0.5, -0.2, 0.2)], "sample_id long, query_idx int, logits array<double>, cx double, cy double, w double, h double")
    g = spark.createDataFrame([(1, 0, 1, 0.5, 0.5, 0.2, 0.2)], "sample_id long, gt_idx int, cls int, cx double, cy double, w double, h double")
    m = spark.createDataFrame([(1, 0, 0)], "sample_id long, gt_idx int, query_idx int")
    for made in (lambda check: matching.match_costs(q, g, check=check), lambda check: losses.matched_pairs(q, g, m, check)):
        with pytest.raises(Exception, match="corners out of order"):
            made(True).collect()
        assert made(False).count() == 1


def test_batches_divide_by_the_boxes_of_all_workers(spark):
    """Two workers and two steps; a worker without boxes; denoising groups."""
    q = spark.createDataFrame([(i, 0, [0.3, -0.2], 0.5, 0.5, 0.2 + i / 100, 0.2) for i in range(6)], "sample_id long, query_idx int, logits array<double>, cx double, cy double, w double, h double")
    g = spark.createDataFrame([(i, k, 1, 0.5, 0.5, 0.2, 0.2) for i, n in ((0, 3), (1, 2), (4, 1)) for k in range(n)], "sample_id long, gt_idx int, cls int, cx double, cy double, w double, h double")
    m = spark.createDataFrame([(0, 0, 0), (1, 1, 0), (4, 0, 0)], "sample_id long, gt_idx int, query_idx int")
    s = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 0, 1), (3, 1, 0), (4, 1, 1), (5, 1, 1)], "sample_id long, step int, worker int")
    sums = {r.sample_id: r for r in losses.component_sums(s, q, g, m).collect()}
    for groups in (1, 3):
        got = {(r.step, r.worker): r for r in losses.batch_criterion(s, q, g, m, world=2, groups=groups).collect()}
        for (step, worker), boxes in {(0, 0): 2.5, (0, 1): 2.5, (1, 0): 1.0, (1, 1): 1.0}.items():
            own = [sums[r.sample_id] for r in s.collect() if (r.step, r.worker) == (step, worker)]
            assert got[step, worker].loss_bbox == pytest.approx(5 * sum(x.loss_bbox for x in own) / (boxes * groups))
            assert got[step, worker].total == pytest.approx(sum(x.loss_vfl + 5 * x.loss_bbox + 2 * x.loss_giou for x in own) / (boxes * groups))
    assert losses.criterion(s, q, g, m).count() == 6
