"""SQL functions and table functions against the column functions and plain loops."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from detframe import sql
from detframe.functions import boxes, scalars
from detframe.operators import clustering
from detframe.operators.samples import class_name


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark)
    return spark


def boxes_frame(spark):
    r = random.Random(2)
    box = lambda: [r.uniform(0, 0.6), r.uniform(0, 0.6), r.uniform(0.4, 1), r.uniform(0.4, 1)]
    rows = [(box(), box()) for _ in range(60)] + [([0.1, 0.1, 0.1, 0.1], [0.1, 0.1, 0.1, 0.1]), ([0.0, 0.0, 1.0, 1.0], [2.0, 2.0, 3.0, 3.0])]
    return spark.createDataFrame(rows, "a array<double>, b array<double>")


def test_scalars_equal_the_column_functions(session):
    d = boxes_frame(session)
    a, b = ([F.col(c)[i] for i in range(4)] for c in "ab")
    x, p = F.col("a")[0], F.col("a")[1] * 0.9 + 0.05
    pairs = {
        "iou(a, b)": boxes.iou(a, b), "iou_exact(a, b)": boxes.iou(a, b, None), "giou(a, b)": boxes.giou(a, b), "l1(a, b)": boxes.l1(a, b), "clip01(a[0] * 3 - 1)": boxes.clip01(x * 3 - 1), "sigmoid(a[0])": scalars.sigmoid(x),
        "focal_class_cost(a[1] * 0.9 + 0.05, 0.25, 2)": scalars.focal_class_cost(p), "bce_with_logits(a[0], a[1])": scalars.bce_with_logits(x, F.col("a")[1]), "checked_giou(xyxy(a), xyxy(b))": boxes.giou(boxes.cxcywh_to_xyxy(*a), boxes.cxcywh_to_xyxy(*b)),
    }
    pairs |= {f"xyxy(a)[{i}]": c for i, c in enumerate(boxes.cxcywh_to_xyxy(*a))} | {f"cxcywh(a)[{i}]": c for i, c in enumerate(boxes.xyxy_to_cxcywh(*a))}
    pairs |= {f"normalized_box(a, 960, 544)[{i}]": c for i, c in enumerate(boxes.coco_to_normalized(*a, F.lit(960.0), F.lit(544.0)))}
    for text, column in pairs.items():
        for r in d.select(F.expr(text).alias("s"), column.alias("c")).collect():
            assert (math.isnan(r.s) and math.isnan(r.c)) or r.s == pytest.approx(r.c, abs=1e-12), text
    names = session.range(-2, 8).selectExpr("class_name(CAST(id AS INT)) AS s", "CAST(id AS INT) AS i").withColumn("c", class_name(F.col("i"))).collect()
    assert all(r.s == r.c for r in names)
    paths = session.createDataFrame([("///dataset/subset-1/a.jpg",), ("b.jpg",), ("",), ("/a//b",)], "path string")
    assert all(r.s == r.c for r in paths.select(F.expr("subset_of(path)").alias("s"), scalars.subset_of(F.col("path")).alias("c")).collect())


def test_they_are_inlined_and_checked(session):
    d = boxes_frame(session)
    plan = d.selectExpr("iou(a, b) AS v").where("v > 0.5")._jdf.queryExecution().optimizedPlan().toString()
    assert "iou" not in plan and "greatest" in plan
    with pytest.raises(Exception, match="corners out of order"):
        session.sql("SELECT checked_giou(array(1D, 0D, 0D, 1D), array(0D, 0D, 1D, 1D))").collect()


def test_match_boxes_is_a_cheapest_assignment(session):
    r = random.Random(4)
    shapes = {1: (3, 5), 2: (5, 3), 3: (1, 1), 4: (4, 4)}
    rows = [(s, g * 10, q, r.choice([0.5, 1.0, r.uniform(-1, 3)])) for s, (m, n) in shapes.items() for g in range(m) for q in range(n)]
    session.createDataFrame(rows, "sample_id long, gt_idx int, query_idx int, cost double").repartition(3).createOrReplaceTempView("costs")
    got = session.sql("SELECT * FROM match_boxes(TABLE(costs) PARTITION BY sample_id)").collect()
    cost = {(s, g, q): c for s, g, q, c in rows}
    for s, (m, n) in shapes.items():
        own = [x for x in got if x.sample_id == s]
        assert len(own) == min(m, n) == len({x.gt_idx for x in own}) == len({x.query_idx for x in own}) and all(cost[s, x.gt_idx, x.query_idx] == x.cost for x in own)
        if m <= n:
            best = min(sum(cost[s, g * 10, q] for g, q in enumerate(p)) for p in itertools.permutations(range(n), m))
        else:
            best = min(sum(cost[s, g * 10, q] for q, g in enumerate(p)) for p in itertools.permutations(range(m), n))
        assert sum(x.cost for x in own) == pytest.approx(best)
    assert session.sql("SELECT * FROM match_boxes(TABLE(SELECT * FROM costs WHERE false) PARTITION BY sample_id)").count() == 0


def test_greedy_pairs_and_clusters(session):
    rows = [(1, 0, 0, 0.5), (1, 1, 0, 0.5), (1, 1, 1, 0.9), (2, 3, 0, 0.1)]
    session.createDataFrame(rows, "sample_id long, gt_idx int, pred_idx int, iou double").createOrReplaceTempView("pairs")
    got = session.sql("SELECT * FROM greedy_pairs(TABLE(pairs) PARTITION BY sample_id)").collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.5), (1, 1, 1, 0.9), (2, 3, 0, 0.1)]
    r = random.Random(6)
    top = [(s, q, q % 2, x, x, x + 50.0, x + 50.0, r.random()) for s in range(5) for q in range(12) for x in [float(r.randrange(4) * 3 + 100 * (q % 3))]]
    d = session.createDataFrame(top, "sample_id long, query_idx int, label int, x1 double, y1 double, x2 double, y2 double, score double")
    d.createOrReplaceTempView("boxes")
    got = session.sql("SELECT * FROM cluster_boxes(TABLE(boxes) PARTITION BY sample_id)").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, clustering.cluster_boxes(d).collect())) and len(got) > 10


def test_table_functions_by_blocks_equal_those_by_sample(spark):
    """Blocks of several samples, one of them longer than an Arrow batch; a block out of order is an error."""
    sql.register(spark)
    d = spark.range(40).selectExpr("id % 7 AS sample_id", "id").unionByName(spark.range(12_000).selectExpr("100L AS sample_id", "id"))
    pairs = d.selectExpr("sample_id", "int(id % 5) AS gt_idx", "int(id % 11) AS pred_idx", "pmod(hash(id), 10) / 10D AS iou")
    boxes = d.where("sample_id < 100 OR id < 300").selectExpr("sample_id", "int(id) AS query_idx", "int(id % 2) AS label", "id % 9 / 1D AS x1", "0D AS y1", "id % 9 + 30D AS x2", "20D AS y2", "pmod(hash(id), 10) / 20D AS score")
    pairs.createOrReplaceTempView("block_pairs")
    boxes.createOrReplaceTempView("block_boxes")
    for function, view in (("greedy_pairs", "block_pairs"), ("cluster_boxes", "block_boxes")):
        own, block = (sorted(spark.sql(f"SELECT * FROM {function}(TABLE({view}) PARTITION BY {by})").collect()) for by in ("sample_id", "sample_id % 3 ORDER BY sample_id"))
        assert own == block and len({r.sample_id for r in own}) == 8
    best = {}
    for r in pairs.collect():
        key = (r.sample_id, r.pred_idx)
        best[key] = min(best.get(key, (1.0, 0)), (-r.iou, r.gt_idx))
    got = spark.sql("SELECT * FROM greedy_pairs(TABLE(block_pairs) PARTITION BY sample_id % 3 ORDER BY sample_id)").collect()
    assert {(r.sample_id, r.pred_idx): (-r.iou, r.gt_idx) for r in got} == best
    with pytest.raises(Exception, match="ORDER BY sample_id"):
        spark.sql("SELECT * FROM greedy_pairs(TABLE(block_pairs) PARTITION BY 1 ORDER BY sample_id DESC)").collect()


def test_overlaps_are_computed_once_a_row(session):
    d = boxes_frame(session)
    plan = d.selectExpr("iou_exact(a, b) AS i", "giou(a, b) AS g")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("greatest") == 10  # four for each function's overlap, two for the hull
