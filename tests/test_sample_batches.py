"""Plug-ins over samples in Arrow batches give what their column forms give, odd samples included."""

import random

import pytest
from pyspark.sql import functions as F

from detframe import evaluation
from detframe.operators import gt as gts
from detframe.operators import metrics, preds, profile, sample_batches
from detframe.operators.samples import categories

from .test_evaluation import plain

WANTED = [*(("metric", n) for n in ("precision", "recall", "f1", "tp", "fp", "fn", "iou", "accuracy", "Confusion Matrix")), ("metadata", "metadata")]
NAN = float("nan")


def made(seed):
    r = random.Random(seed)
    anns, found = [], []
    for s in range(60):
        for k in range(r.choice((0, 1, 3, 8)) if s else 420):  # the first is capped
            anns.append([s, k, r.choice((3, 5, 7, 10, 11, 4)), *(float(r.randrange(0, 300, 20)) for _ in "xy"), *(float(r.randrange(0, 200, 20)) for _ in "wh")])
        for k in range(r.choice((0, 1, 3, 8)) if s else 320):
            x, y = (float(r.randrange(0, 300, 20)) for _ in "xy")
            found.append([s, k, r.randrange(7), x, y, x + r.randrange(100), y + r.randrange(100), r.choice((0.3, 0.299999, 0.5, 0.9, 1.0))])
    for rows, at in ((anns, 3), (anns, 2), (found, 3), (found, 7)):
        for odd in (NAN, None) if at != 2 else (None,):
            r.choice([x for x in rows if x[0] > 40])[at] = odd
    return anns, found


@pytest.mark.parametrize("seed,pairs", [(1, 1 << 20), (2, 10)])
def test_equals_the_column_forms(spark, seed, pairs, monkeypatch):
    monkeypatch.setattr(sample_batches, "PAIRS", pairs)
    anns, found = made(seed)
    samples = spark.range(62).select(F.col("id").alias("sample_id"), F.lit(960).alias("width"), F.when(F.col("id") != 50, 544).otherwise(F.lit(None)).alias("height"))
    anns = spark.createDataFrame(anns, "sample_id long, ann_pos int, category_id int, x double, y double, w double, h double")
    found = spark.createDataFrame(found, "sample_id long, query_idx int, label int, x1 double, y1 double, x2 double, y2 double, score double")
    sides = evaluation.Sides(samples, anns, found)
    df = evaluation.evaluate(sides, WANTED)
    assert "MapInArrow" in df._jdf.queryExecution().executedPlan().toString()
    got = {r.sample_id: r for r in df.collect()}
    odd = {r.sample_id for r in sides._whole.where("__odd").select("sample_id").collect()}
    assert 50 in odd and 3 < len(odd) < 12 and len(got) == 62
    cats = categories(spark)
    gt, top = gts.ground_truth(samples, anns, cats), preds.top_predictions(found)
    for r in metrics.sample_metrics(samples, gt, top).collect():
        assert [plain(got[r.sample_id][c]) for c in r.__fields__[1:]] == [plain(c) for c in r[1:]], r
    for r in profile.sample_profile(samples, anns, cats).collect():
        assert [plain(c) for c in got[r.sample_id]["metadata"]] == [plain(c) for c in r[1:]], r
    by = {i: [] for i in got}
    for r in metrics.confusion_elements(samples, gt, top).collect():
        by[r.sample_id].append(tuple(r)[1:])
    assert {i: plain(x) for i, x in by.items()} == {i: plain([tuple(e) for e in r["Confusion Matrix"]]) for i, r in got.items()}
    sides.close()
