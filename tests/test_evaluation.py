"""All plug-ins in one result: equal to each alone, with one exchange a side."""

import math

import pytest
from pyspark.sql import functions as F

from detframe import evaluation, registry
from detframe.operators import losses, matching, metrics, overlay, preds, profile
from detframe.operators.samples import categories
from detframe.plans import binding as b

from .conftest import DATA


@pytest.fixture(scope="module")
def sides(spark):
    queries = b.queries(spark, DATA).withColumn("sample_id", F.col("sample_id") + 1)
    made = evaluation.Sides(b.samples(spark, DATA), b.annotations(spark, DATA), b.predictions(spark, DATA), queries)
    yield made
    made.close()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return sorted((plain(x) for x in v), key=str) if isinstance(v, list) else tuple(map(plain, v)) if isinstance(v, tuple) else v


def test_equals_each_plug_in_alone(spark, sides):
    got = {r.sample_id: r for r in evaluation.evaluate(sides).collect()}
    s, a, cats = sides.samples, sides.annotations, categories(spark)
    gt, top = b.gt(spark, DATA), b.top(spark, DATA)
    assert len(got) == s.count()
    single = metrics.sample_metrics(s, gt, top).collect()
    assert all(plain(got[r.sample_id][c]) == plain(r[c]) for r in single for c in ("precision", "recall", "f1", "fp", "tp", "fn", "iou", "accuracy"))
    of_sample = profile.sample_profile(s, a, cats).collect()
    assert all({k: plain(v) for k, v in got[r.sample_id]["metadata"].asDict().items()} == {k: plain(v) for k, v in r.asDict().items() if k != "sample_id"} for r in of_sample)
    for name, rows in (("Confusion Matrix", metrics.confusion_elements(s, gt, top)), ("boxes", overlay.overlay_boxes(gt, top))):
        by: dict = {}
        for r in rows.collect():
            by.setdefault(r.sample_id, []).append(tuple(r)[1:])
        assert {i: plain(x) for i, x in by.items()} == {i: plain([tuple(e) for e in r[name]]) for i, r in got.items() if r[name]}, name
    q = sides.queries
    of_loss = {r.sample_id: r for r in losses.criterion(s, q, gt, matching.assignments(matching.match_costs(q, gt))).collect()}
    assert of_loss and all(plain(got[i][c]) == plain(r[c]) for i, r in of_loss.items() for c in ("loss_vfl", "loss_bbox", "loss_giou", "total"))
    assert all(r["total"] is None for i, r in got.items() if i not in of_loss)


def test_one_exchange_a_side(spark, sides):
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        counts = {}
        for name, wanted in {"metrics": [("metric", "f1")], "two": [("metric", "f1"), ("metric", "Confusion Matrix")], "all": None}.items():
            df = evaluation.evaluate(sides, wanted)
            df.collect()
            counts[name] = evaluation.exchanges(df)
        # Samples, queries, and one that annotations and predictions share, as they come from one table; results.
        # Of all plug-ins, two losses deal out the few rows of the assignment anew.
        assert counts["metrics"] == counts["two"] == counts["all"] - 2 <= 4, counts
    finally:
        for k in settings:
            spark.conf.unset(k)


def test_wanted_and_missing(spark, sides):
    df = evaluation.evaluate(sides, [("metric", "tp"), ("metadata", "metadata")])
    assert df.columns == ["sample_id", "tp", "metadata"]
    without = evaluation.Sides(sides.samples, sides.annotations, sides.predictions)
    with pytest.raises(KeyError, match="side is missing"):
        evaluation.evaluate(without, [("loss", "total")])
    with pytest.raises(KeyError, match="not run by sample"):
        evaluation.evaluate(without, [("source", "splits")])
    assert "total" not in evaluation.evaluate(without).columns
    registry.register("metric", "n_packed", preds.packed, "Upward")
    assert evaluation.evaluate(without, [("metric", "n_packed")]).columns == ["sample_id", "n_packed"]
    empty = evaluation.Sides(sides.samples, sides.annotations.limit(0), sides.predictions.limit(0))
    r = evaluation.evaluate(empty, [("metric", "tp"), ("metric", "iou")]).first()
    assert (r.tp, r.iou) == (0, 1.0)
