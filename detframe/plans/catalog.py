"""Registered queries and their SQL oracles, by name.

Results are keyed by sample; doubles are rounded to eight digits and NaN becomes null, as SQL has it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import evaluation, sql
from ..functions import boxes, scalars
from ..operators import augment, configs, images, losses, matching, metrics, overlay, pairs, preds, profile, randomize, samples
from ..operators import gt as gts
from ..sources import coco, kitti, records
from ..sources.trials import read_trials
from ..storage import scratch, written
from ..streaming import assembly, frames
from . import binding as b

QUERIES: dict = {}
ORACLES: dict = {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return register


def tidy(d: DataFrame, digits: int = 8) -> DataFrame:
    def one(name, kind):
        if kind not in ("double", "float"):
            return F.col(name)
        c = F.col(name).cast("double")
        return F.when(F.isnan(c), None).otherwise(F.round(c, digits)).alias(name)

    return d.select(*[one(n, k) for n, k in d.dtypes])


# ---- the derived tables in SQL -----------------------------------------------------------------------------

_CAT = "cat AS (SELECT * FROM (VALUES (3, 'small_load_carrier', 0), (5, 'forklift', 1), (7, 'pallet', 2), (10, 'stillage', 3), (11, 'pallet_truck', 4)) v(category_id, name, idx))"
_SAMPLES = "smp AS (SELECT o_orderkey AS sample_id, '//dataset/subset-' || CAST(o_orderkey % 6 AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) || '.jpg' AS path, 'subset-' || CAST(o_orderkey % 6 AS VARCHAR) AS subset, CASE WHEN o_orderkey % 6 IN (2, 3, 5) THEN 'training' WHEN o_orderkey % 6 IN (1, 4) THEN 'validation' END AS state FROM orders)"
_ANN = """ann AS (SELECT l_orderkey AS sample_id, CAST(ann_pos AS INTEGER) AS ann_pos, CAST(l_partkey % 12 AS INTEGER) AS category_id, CAST(l_partkey % 37 * 16 AS DOUBLE) AS x, CAST(l_suppkey % 23 * 20 AS DOUBLE) AS y,
  l_quantity + 16.0::DOUBLE AS w, l_quantity + 24.0::DOUBLE AS h, CAST(l_suppkey % 5 AS INTEGER) AS label, l_discount * 100.0::DOUBLE AS dx, l_tax * 100.0::DOUBLE AS dy,
  (l_partkey * 7919 + ann_pos * 104729) % 1000 / 1000.0::DOUBLE AS score
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS ann_pos FROM lineitem))"""
_VALID = "valid AS (SELECT a.*, c.idx AS cls, (x + w / 2) * (640.0::DOUBLE / 960) / 640 AS cx, (y + h / 2) * (640.0::DOUBLE / 544) / 640 AS cy, w * (640.0::DOUBLE / 960) / 640 AS nw, h * (640.0::DOUBLE / 544) / 640 AS nh FROM ann a JOIN cat c USING (category_id) JOIN smp USING (sample_id))"
_GT = "gt AS (SELECT sample_id, CAST(gt_idx AS INTEGER) AS gt_idx, cls, cx, cy, nw AS w, nh AS h FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY ann_pos) - 1 AS gt_idx FROM valid) WHERE gt_idx < 400)"
_PRED = """pred AS (SELECT sample_id, ann_pos AS query_idx, label, (x + dx) * (640.0::DOUBLE / 960) AS x1, (y + dy) * (640.0::DOUBLE / 544) AS y1,
  (x + dx) * (640.0::DOUBLE / 960) + w * (640.0::DOUBLE / 960) AS x2, (y + dy) * (640.0::DOUBLE / 544) + h * (640.0::DOUBLE / 544) AS y2, score FROM ann),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sample_id ORDER BY score DESC, query_idx) - 1 AS INTEGER) AS pred_idx FROM pred WHERE CAST(score AS FLOAT) >= CAST(0.3 AS FLOAT)) WHERE pred_idx < 300)"""
_PAIRS = """raw AS (SELECT g.sample_id, gt_idx, pred_idx, cls AS gt_cls, label AS pred_label, score,
  cx - w / 2 AS gx1, cy - h / 2 AS gy1, cx + w / 2 AS gx2, cy + h / 2 AS gy2, x1 / 640 AS px1, y1 / 640 AS py1, x2 / 640 AS px2, y2 / 640 AS py2 FROM gt g JOIN top p ON g.sample_id = p.sample_id),
over AS (SELECT *, greatest(least(gx2, px2) - greatest(gx1, px1), 0) * greatest(least(gy2, py2) - greatest(gy1, py1), 0) AS inter FROM raw),
uni AS (SELECT *, (gx2 - gx1) * (gy2 - gy1) + (px2 - px1) * (py2 - py1) - inter AS un, (greatest(gx2, px2) - least(gx1, px1)) * (greatest(gy2, py2) - least(gy1, py1)) AS hull FROM over),
pairs AS (SELECT *, inter / greatest(un, 1e-6) AS iou FROM uni)"""
_BASE = f"WITH {_CAT}, {_SAMPLES}, {_ANN}, {_VALID}, {_GT}, {_PRED}"
_SCORED = f"""{_BASE}, {_PAIRS},
scored AS (SELECT *, row_number() OVER (PARTITION BY sample_id, pred_idx ORDER BY iou DESC, gt_idx) AS rn, iou = max(iou) OVER (PARTITION BY sample_id, pred_idx) AS top FROM pairs),
ng AS (SELECT sample_id, count(*) AS g FROM gt GROUP BY 1), np AS (SELECT sample_id, count(*) AS p FROM top GROUP BY 1)"""
_METRICS = f"""{_SCORED},
tp AS (SELECT sample_id, count(DISTINCT gt_idx) AS tp FROM scored WHERE rn = 1 AND iou >= 0.1 GROUP BY 1),
pick AS (SELECT sample_id, gt_idx, iou, pred_label, row_number() OVER (PARTITION BY sample_id, gt_idx ORDER BY iou DESC, pred_idx) AS r FROM scored WHERE top AND iou > 0),
pg AS (SELECT gt.sample_id, avg(coalesce(k.iou, 0)) AS iou, avg(CASE WHEN coalesce(k.pred_label, f.label) = gt.cls THEN 1.0::DOUBLE ELSE 0 END) AS accuracy
       FROM gt LEFT JOIN (SELECT * FROM pick WHERE r = 1) k USING (sample_id, gt_idx) LEFT JOIN (SELECT sample_id, label FROM top WHERE pred_idx = 0) f ON f.sample_id = gt.sample_id GROUP BY 1),
m AS (SELECT s.sample_id, coalesce(g, 0) AS g, coalesce(p, 0) AS p, coalesce(tp, 0) AS tp, pg.iou, pg.accuracy FROM smp s LEFT JOIN ng USING (sample_id) LEFT JOIN np USING (sample_id) LEFT JOIN tp USING (sample_id) LEFT JOIN pg USING (sample_id)),
met AS (SELECT sample_id, tp / nullif(p, 0)::DOUBLE AS precision, tp / nullif(g, 0)::DOUBLE AS recall,
  CASE WHEN tp > 0 THEN 2 * (tp / p::DOUBLE) * (tp / g::DOUBLE) / (tp / p::DOUBLE + tp / g::DOUBLE) ELSE 0 END AS f1,
  CAST(p - tp AS INTEGER) AS fp, CAST(tp AS INTEGER) AS tp, CAST(g - tp AS INTEGER) AS fn,
  CASE WHEN g = 0 AND p = 0 THEN 1 WHEN g = 0 OR p = 0 THEN 0 ELSE iou END AS iou, CASE WHEN g = 0 AND p = 0 THEN 1 WHEN g = 0 OR p = 0 THEN 0 ELSE accuracy END AS accuracy FROM m)"""
_CLASS = "(CASE {0} WHEN 0 THEN 'small_load_carrier' WHEN 1 THEN 'forklift' WHEN 2 THEN 'pallet' WHEN 3 THEN 'stillage' WHEN 4 THEN 'pallet_truck' ELSE 'Unknown' END)"

# ---- matching and metrics -------------------------------------------------------------------------------------


@query(f"{_METRICS} SELECT sample_id, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, fp, tp, fn, round(iou, 8) AS iou FROM met")
def det_prf_iou(spark, d):
    return tidy(metrics.sample_metrics(b.samples(spark, d), b.gt(spark, d), b.top(spark, d)).drop("accuracy"))


@query(f"{_METRICS} SELECT sample_id, round(accuracy, 8) AS accuracy FROM met")
def det_accuracy(spark, d):
    return tidy(metrics.sample_metrics(b.samples(spark, d), b.gt(spark, d), b.top(spark, d)).select("sample_id", "accuracy"))


_CONFUSION = f"""{_SCORED},
el AS (
 SELECT t.sample_id, 'prediction' AS elem_kind, {_CLASS.format('CASE WHEN s.iou > 0.1 THEN s.gt_cls ELSE t.label END')} AS class_name, CASE WHEN s.iou > 0.1 THEN 'Positive' ELSE 'Negative' END AS polarity, t.score AS confidence
 FROM top t JOIN ng USING (sample_id) LEFT JOIN (SELECT * FROM scored WHERE rn = 1) s ON s.sample_id = t.sample_id AND s.pred_idx = t.pred_idx
 UNION ALL SELECT gt.sample_id, 'ground truth', {_CLASS.format('cls')}, 'Positive', 0 FROM gt LEFT JOIN (SELECT sample_id, gt_idx, max(iou) AS m FROM pairs GROUP BY 1, 2) n USING (sample_id, gt_idx) WHERE coalesce(m, 0) <= 0.1
 UNION ALL SELECT s.sample_id, 'ground truth', 'Unknown', 'Positive', 0 FROM smp s LEFT JOIN ng USING (sample_id) WHERE g IS NULL
 UNION ALL SELECT s.sample_id, 'background', 'background', 'Positive', 0 FROM smp s LEFT JOIN (SELECT DISTINCT sample_id FROM pairs WHERE iou > 0.1) n USING (sample_id) WHERE n.sample_id IS NULL)"""


@query(f"{_CONFUSION} SELECT sample_id, elem_kind, class_name, polarity, round(confidence, 8) AS confidence FROM el")
def confusion_elements(spark, d):
    return tidy(metrics.confusion_elements(b.samples(spark, d), b.gt(spark, d), b.top(spark, d)))


@query(f"{_CONFUSION} SELECT class_name, polarity, count(*) AS n, round(avg(confidence), 8) AS mean_confidence FROM el GROUP BY 1, 2")
def confusion_matrix_agg(spark, d):
    return tidy(metrics.confusion_matrix(metrics.confusion_elements(b.samples(spark, d), b.gt(spark, d), b.top(spark, d))))


@query(f"{_BASE}, {_PAIRS} SELECT sample_id, gt_idx, pred_idx, gt_cls, pred_label, round(iou, 8) AS iou FROM pairs WHERE gx1 < px2 AND px1 < gx2 AND gy1 < py2 AND py1 < gy2")
def iou_pairs(spark, d):
    return tidy(pairs.pairs(b.gt(spark, d), b.top(spark, d)).drop("score"))


@query(f"{_BASE}, {_PAIRS} SELECT sample_id, gt_idx, pred_idx, round(inter / nullif(un, 0), 10) AS iou, round(inter / nullif(un, 0) - (hull - un) / nullif(hull, 0), 10) AS giou FROM pairs")
def giou_pairs(spark, d):
    return tidy(pairs.pairs(b.gt(spark, d), b.top(spark, d), prune=False, clamp=None, with_giou=True).select("sample_id", "gt_idx", "pred_idx", "iou", "giou"), 10)


@query(f"{_METRICS} SELECT state, subset, CAST(grouping(state, subset) AS INTEGER) AS level, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, round(avg(f1), 8) AS mean_f1 FROM met JOIN smp USING (sample_id) WHERE state IS NOT NULL GROUP BY ROLLUP (state, subset)")
def metrics_rollup(spark, d):
    s = b.samples(spark, d)
    return tidy(metrics.metrics_rollup(metrics.sample_metrics(s, b.gt(spark, d), b.top(spark, d)), samples.routed(s)))


@query(f"""{_SCORED},
mm AS (SELECT *, row_number() OVER (PARTITION BY sample_id, pred_idx ORDER BY iou DESC, gt_idx) AS r1 FROM pairs WHERE gt_cls = pred_label AND iou >= 0.5),
m2 AS (SELECT sample_id, pred_idx FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, gt_idx ORDER BY pred_idx) AS r2 FROM mm WHERE r1 = 1) WHERE r2 = 1),
pt AS (SELECT label, score, sum(CASE WHEN m2.sample_id IS NULL THEN 0 ELSE 1 END) AS tp, count(*) AS n FROM top LEFT JOIN m2 USING (sample_id, pred_idx) GROUP BY 1, 2),
cv AS (SELECT label, tp, sum(tp) OVER w AS ctp, sum(n) OVER w AS cn FROM pt WINDOW w AS (PARTITION BY label ORDER BY score DESC))
SELECT {_CLASS.format('x.cls')} AS class_name, x.n_gt, round(coalesce(sum(tp * ctp / cn::DOUBLE) / x.n_gt, 0), 8) AS ap FROM (SELECT cls, count(*) AS n_gt FROM gt GROUP BY 1) x LEFT JOIN cv ON cv.label = x.cls GROUP BY x.cls, x.n_gt""")
def average_precision(spark, d):
    return tidy(metrics.average_precision(b.gt(spark, d), b.top(spark, d)))


# ---- samples, ground truth, predictions --------------------------------------------------------------------------


@query(f"WITH {_SAMPLES} SELECT CAST(sample_id AS VARCHAR) AS sample_id, subset, state FROM smp WHERE state IS NOT NULL")
def sample_split(spark, d):
    s = samples.routed(b.samples(spark, d))
    return s.select(samples.sample_id(F.col("sample_id")).alias("sample_id"), "subset", "state")


@query(f"WITH {_SAMPLES} SELECT state, count(*) AS n FROM smp WHERE state IS NOT NULL GROUP BY 1")
def split_counts(spark, d):
    return samples.split_counts(samples.routed(b.samples(spark, d)))


@query(f"WITH {_SAMPLES} SELECT sample_id, state FROM (SELECT *, row_number() OVER (PARTITION BY state ORDER BY sample_id) AS r FROM smp WHERE state IS NOT NULL) WHERE r <= 100")
def sample_caps(spark, d):
    return samples.capped(samples.routed(b.samples(spark, d)), 100, ["sample_id"]).select("sample_id", "state")


@query(f"{_BASE} SELECT sample_id, gt_idx, cls, round(cx, 8) AS cx, round(cy, 8) AS cy, round(w, 8) AS w, round(h, 8) AS h FROM gt")
def gt_normalized(spark, d):
    return tidy(b.gt(spark, d))


@query(f"{_BASE} SELECT s.sample_id, coalesce(n, 0) AS n_real, 400 AS n_rows, coalesce(label_sum, 0) - (400 - coalesce(n, 0)) AS label_sum FROM smp s LEFT JOIN (SELECT sample_id, count(*) AS n, CAST(sum(cls) AS BIGINT) AS label_sum FROM gt GROUP BY 1) USING (sample_id)")
def gt_padded_counts(spark, d):
    p = gts.padded(b.samples(spark, d), b.gt(spark, d))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return p.select("sample_id", F.aggregate("gt_mask", F.lit(0.0), lambda a, x: a + x).cast("long").alias("n_real"), F.size("gt_padded").alias("n_rows"), total("gt_labels").alias("label_sum"))


@query(f"{_BASE} SELECT sample_id, gt_idx, cls FROM gt")
def gt_from_padded(spark, d):
    return gts.from_padded(gts.padded(b.samples(spark, d), b.gt(spark, d))).select("sample_id", "gt_idx", "cls")


@query(f"{_BASE} SELECT sample_id, gt_idx, CAST(cls AS BIGINT) AS cls, round(CAST(CAST(cx AS FLOAT) AS DOUBLE), 8) AS cx, round(CAST(CAST(h AS FLOAT) AS DOUBLE), 8) AS h FROM gt")
def gt_valid_targets(spark, d):
    v = gts.valid_targets(gts.padded(b.samples(spark, d), b.gt(spark, d)))
    return tidy(v.select("sample_id", "gt_idx", "cls", "cx", "h"))


@query(f"WITH {_CAT}, {_ANN} SELECT name AS class_name, count(*) AS n FROM ann JOIN cat USING (category_id) GROUP BY 1")
def category_join(spark, d):
    v = samples.with_valid_class(b.annotations(spark, d), samples.categories(spark))
    return v.groupBy(samples.class_name(F.col("cls")).alias("class_name")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_SAMPLES}, {_ANN} SELECT s.sample_id, coalesce(n, 0) AS n_anns, first_cat FROM smp s LEFT JOIN (SELECT sample_id, CAST(count(*) AS INTEGER) AS n, arg_min(category_id, ann_pos) AS first_cat FROM ann GROUP BY 1) USING (sample_id)")
def images_with_annotations(spark, d):
    a = b.annotations(spark, d).select(F.col("sample_id").alias("image_id"), "ann_pos", "category_id", F.array("x", "y", "w", "h").alias("bbox"))
    i = samples.images_with_annotations(b.samples(spark, d).withColumnRenamed("sample_id", "image_id"), a)
    return i.select(F.col("image_id").alias("sample_id"), F.size("anns").alias("n_anns"), F.get("anns", F.lit(0))["category_id"].alias("first_cat"))


@query(f"WITH {_ANN}, {_PRED} SELECT sample_id, pred_idx, query_idx, label, round(score, 8) AS score, round(x1, 8) AS x1, round(y2, 8) AS y2 FROM top")
def pred_topk(spark, d):
    return tidy(b.top(spark, d).select("sample_id", "pred_idx", "query_idx", "label", "score", "x1", "y2"))


@query(f"WITH {_SAMPLES}, {_ANN}, {_PRED} SELECT t.sample_id, pred_idx, label, round(CAST(score AS DOUBLE), 4) AS score FROM top t JOIN smp USING (sample_id)")
def pred_unpacked(spark, d):
    p = preds.packed(b.samples(spark, d), b.top(spark, d))
    batches = p.groupBy((F.col("sample_id") % 1024).alias("batch"), F.floor(F.col("sample_id") / 16_384).alias("part")).agg(F.collect_list(F.struct("sample_id", "packed")).alias("items"))
    rows = preds.unpacked(batches.select(F.col("items.sample_id").alias("sample_ids"), F.col("items.packed").alias("packed")))
    return tidy(rows.select("sample_id", "pred_idx", "label", "score"), 4)


@query(f"WITH {_SAMPLES}, {_ANN}, {_PRED} SELECT s.sample_id, coalesce(n, 0) AS n, best FROM smp s LEFT JOIN (SELECT sample_id, CAST(count(*) AS INTEGER) AS n, round(max(score), 4) AS best FROM top GROUP BY 1) USING (sample_id)")
def pred_packed(spark, d):
    p = preds.packed(b.samples(spark, d), b.top(spark, d))
    return tidy(p.select("sample_id", F.size("packed").alias("n"), F.get(F.get("packed", F.lit(0)), F.lit(4)).alias("best")), 4)


#: Means of pixel fractions end in a 5 at fewer digits, where engines round differently.
_STAT = "round({0}, 11) AS {1}"


@query(f"""{_BASE}, v AS (SELECT *, nw * nh AS area FROM valid),
p AS (SELECT sample_id, count(*) AS n_objects, count(DISTINCT cls) AS n_classes, avg(area) AS area_mean, median(area) AS area_median, min(area) AS area_min, max(area) AS area_max, var_pop(area) AS area_var,
  avg(cx) AS cx_mean, median(cx) AS cx_median, avg(cy) AS cy_mean, median(cy) AS cy_median, var_pop(cx) + var_pop(cy) AS center_var FROM v GROUP BY 1)
SELECT s.sample_id, coalesce(n_objects, 0) AS n_objects, coalesce(n_classes, 0) AS n_classes, {', '.join(_STAT.format(c, c) for c in ('area_mean', 'area_median', 'area_min', 'area_max', 'area_var', 'cx_mean', 'cx_median', 'cy_mean', 'cy_median', 'center_var'))}
FROM smp s LEFT JOIN p USING (sample_id)""")
def sample_profile(spark, d):
    p = profile.sample_profile(b.samples(spark, d), b.annotations(spark, d), samples.categories(spark))
    return tidy(p.drop(*[f"n_{n}" for _, n, _ in samples.CATEGORIES]), 11)


@query(f"{_BASE} SELECT s.sample_id, " + ", ".join(f"CAST(nullif(sum(CASE WHEN cls = {i} THEN 1 ELSE 0 END), 0) AS DOUBLE) AS n_{n}" for _, n, i in samples.CATEGORIES) + " FROM smp s LEFT JOIN valid v ON v.sample_id = s.sample_id GROUP BY 1")
def class_counts(spark, d):
    p = profile.sample_profile(b.samples(spark, d), b.annotations(spark, d), samples.categories(spark))
    return tidy(p.select("sample_id", *[f"n_{n}" for _, n, _ in samples.CATEGORIES]))


@query(f"""{_BASE} SELECT sample_id, '_GT' AS kind, round(cx, 8) AS x, round(cy, 8) AS y, round(w, 8) AS width, round(h, 8) AS height, 1.0::DOUBLE AS confidence, {_CLASS.format('cls')} AS label FROM gt
UNION ALL SELECT sample_id, '_PRED', round((a + c) / 2, 8), round((b + e) / 2, 8), round(c - a, 8), round(e - b, 8), round(score, 8), {_CLASS.format('label')}
FROM (SELECT *, least(greatest(x1 / 640, 0), 1) AS a, least(greatest(y1 / 640, 0), 1) AS b, least(greatest(x2 / 640, 0), 1) AS c, least(greatest(y2 / 640, 0), 1) AS e FROM top)""")
def overlay_boxes(spark, d):
    return tidy(overlay.overlay_boxes(b.gt(spark, d), b.top(spark, d)))


# ---- assignment and losses -----------------------------------------------------------------------------------

_VEC = """q AS (SELECT vec_id AS sample_id, CAST(qi AS INTEGER) AS query_idx, [CAST(embedding[qi * 9 + 1 + k] AS DOUBLE) FOR k IN range(5)] AS logits,
  1 / (1 + exp(-CAST(embedding[qi * 9 + 6] AS DOUBLE))) AS cx, 1 / (1 + exp(-CAST(embedding[qi * 9 + 7] AS DOUBLE))) AS cy, 1 / (1 + exp(-CAST(embedding[qi * 9 + 8] AS DOUBLE))) AS w, 1 / (1 + exp(-CAST(embedding[qi * 9 + 9] AS DOUBLE))) AS h
  FROM embeddings, (SELECT unnest(range(7)) AS qi)),
g AS (SELECT vec_id AS sample_id, j AS gt_idx, CAST((label + j) % 5 AS INTEGER) AS cls, (label + 1 + 3 * j) / 14.0::DOUBLE AS cx, (label * 3 % 10 + 1) / 12.0::DOUBLE AS cy, label * 0.02::DOUBLE + 0.1::DOUBLE AS w, label * 0.01::DOUBLE + j * 0.05::DOUBLE + 0.15::DOUBLE AS h
  FROM embeddings, (SELECT unnest([0, 1]) AS j) WHERE j <= label % 2),
pr AS (SELECT g.sample_id, gt_idx, query_idx, cls, logits, logits[cls + 1] AS x, abs(q.cx - g.cx) + abs(q.cy - g.cy) + abs(q.w - g.w) + abs(q.h - g.h) AS l1,
  q.cx - q.w / 2 AS ax1, q.cy - q.h / 2 AS ay1, q.cx + q.w / 2 AS ax2, q.cy + q.h / 2 AS ay2, g.cx - g.w / 2 AS bx1, g.cy - g.h / 2 AS by1, g.cx + g.w / 2 AS bx2, g.cy + g.h / 2 AS by2 FROM g JOIN q ON q.sample_id = g.sample_id),
pi AS (SELECT *, greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) AS inter, 1 / (1 + exp(-x)) AS p FROM pr),
pu AS (SELECT *, (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter AS un, (greatest(ax2, bx2) - least(ax1, bx1)) * (greatest(ay2, by2) - least(ay1, by1)) AS hull FROM pi),
pg AS (SELECT *, inter / un AS iou, inter / un - (hull - un) / hull AS giou, 0.25::DOUBLE * pow(1 - p, 2) * -ln(p + 1e-8) - 0.75::DOUBLE * pow(p, 2) * -ln(1 - p + 1e-8) AS cc FROM pu),
cost AS (SELECT *, 5 * l1 + 2 * cc - 2 * giou AS cost FROM pg),
two AS (SELECT a.sample_id, a.query_idx AS q0, c.query_idx AS q1, a.cost + coalesce(c.cost, 0) AS total FROM cost a LEFT JOIN cost c ON c.sample_id = a.sample_id AND c.gt_idx = 1 AND c.query_idx <> a.query_idx WHERE a.gt_idx = 0),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY total) AS r FROM two) WHERE r = 1),
mt AS (SELECT c.* FROM cost c JOIN best k ON k.sample_id = c.sample_id AND c.query_idx = CASE c.gt_idx WHEN 0 THEN k.q0 ELSE k.q1 END),
nb AS (SELECT sample_id, greatest(count(*), 1) AS nb FROM g GROUP BY 1),
cells AS (SELECT q.sample_id, q.query_idx, k, q.logits[k + 1] AS x, CASE WHEN mt.cls = k THEN 1.0::DOUBLE ELSE 0 END AS t, CASE WHEN mt.cls = k THEN mt.iou ELSE 0 END AS tq
  FROM q CROSS JOIN (SELECT unnest(range(5)) AS k) LEFT JOIN mt ON mt.sample_id = q.sample_id AND mt.query_idx = q.query_idx),
ls AS (SELECT sample_id, sum((0.75::DOUBLE * pow(1 / (1 + exp(-x)), 2) * (1 - t) + tq) * (greatest(x, 0) - x * tq + ln(1 + exp(-abs(x))))) AS vfl,
  sum((0.75::DOUBLE * t + 0.25::DOUBLE * (1 - t)) * pow(1 - ((1 / (1 + exp(-x))) * t + (1 - 1 / (1 + exp(-x))) * (1 - t)), 2) * (greatest(x, 0) - x * t + ln(1 + exp(-abs(x))))) AS focal FROM cells GROUP BY 1),
bx AS (SELECT sample_id, sum(l1) AS bbox, sum(1 - giou) AS giou FROM mt GROUP BY 1)"""


def _vectors(spark, d):
    q, g = b.queries(spark, d), b.vector_gt(spark, d)
    return q.select("sample_id").distinct(), q, g, matching.assignments(matching.match_costs(q, g))


@query(f"WITH {_VEC} SELECT sample_id, gt_idx, query_idx, round(cc, 8) AS cost_class, round(l1, 8) AS cost_box, round(-giou, 8) AS cost_giou, round(cost, 8) AS cost FROM cost")
def match_cost(spark, d):
    return tidy(matching.match_costs(b.queries(spark, d), b.vector_gt(spark, d)))


@query(f"WITH {_VEC} SELECT sample_id, gt_idx, query_idx, round(-exp(x - list_max(logits)) / list_sum([exp(l - list_max(logits)) FOR l IN logits]), 8) AS cost_class FROM cost")
def loss_softmax_cost(spark, d):
    return tidy(matching.match_costs(b.queries(spark, d), b.vector_gt(spark, d), focal=False).select("sample_id", "gt_idx", "query_idx", "cost_class"))


@query(f"WITH {_VEC} SELECT sample_id, count(*) AS n, round(sum(cost), 8) AS total_cost FROM mt GROUP BY 1")
def match_assign(spark, d):
    return tidy(_vectors(spark, d)[3].groupBy("sample_id").agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("total_cost")))


@query(f"WITH {_VEC} SELECT sample_id, round(vfl / nb, 8) AS loss_vfl FROM ls JOIN nb USING (sample_id)")
def loss_vfl(spark, d):
    return tidy(losses.criterion(*_vectors(spark, d), losses=("vfl",)).select("sample_id", "loss_vfl"))


@query(f"WITH {_VEC} SELECT sample_id, round(focal / nb, 8) AS loss_focal FROM ls JOIN nb USING (sample_id)")
def loss_focal(spark, d):
    return tidy(losses.criterion(*_vectors(spark, d), losses=("focal",), weights={"loss_focal": 1.0}).select("sample_id", "loss_focal"))


@query(f"WITH {_VEC} SELECT sample_id, round(5 * bbox / nb, 8) AS loss_bbox, round(2 * giou / nb, 8) AS loss_giou FROM bx JOIN nb USING (sample_id)")
def loss_boxes(spark, d):
    return tidy(losses.criterion(*_vectors(spark, d), losses=("boxes",)).select("sample_id", "loss_bbox", "loss_giou"))


@query(f"WITH {_VEC} SELECT sample_id, round(vfl / nb, 8) AS loss_vfl, round(5 * bbox / nb, 8) AS loss_bbox, round(2 * giou / nb, 8) AS loss_giou, round(vfl / nb + 5 * bbox / nb + 2 * giou / nb, 8) AS total FROM ls JOIN nb USING (sample_id) JOIN bx USING (sample_id)")
def loss_total(spark, d):
    return tidy(losses.criterion(*_vectors(spark, d)))


@query(f"""WITH {_VEC}, st AS (SELECT vec_id AS sample_id, vec_id // 8 AS step, CAST(vec_id % 2 AS INTEGER) AS worker FROM embeddings), bn AS (SELECT step, greatest(count(*) / 2.0::DOUBLE, 1) AS bn FROM g JOIN st USING (sample_id) GROUP BY 1)
SELECT step, worker, round(sum(vfl) / bn, 8) AS loss_vfl, round(5 * sum(bbox) / bn, 8) AS loss_bbox, round(2 * sum(giou) / bn, 8) AS loss_giou, round((sum(vfl) + 5 * sum(bbox) + 2 * sum(giou)) / bn, 8) AS total
FROM ls JOIN bx USING (sample_id) JOIN st USING (sample_id) JOIN bn USING (step) GROUP BY step, worker, bn""")
def loss_batches(spark, d):
    """Batches of four samples on two workers a step."""
    s, q, g, m = _vectors(spark, d)
    s = s.withColumns({"step": F.floor(F.col("sample_id") / 8), "worker": (F.col("sample_id") % 2).cast("int")})
    return tidy(losses.batch_criterion(s, q, g, m, world=2))


@query(f"WITH {_VEC} SELECT nb.sample_id, CAST(qi AS INTEGER) AS query_idx, CAST(qi % n AS INTEGER) AS gt_idx FROM (SELECT sample_id, count(*) AS n FROM g GROUP BY 1) nb, (SELECT unnest(range(7)) AS qi) WHERE qi < n * 3")
def dn_match(spark, d):
    g = b.vector_gt(spark, d)
    positives = b.queries(spark, d).select("sample_id", F.col("query_idx").alias("pos"), "query_idx")
    return matching.denoising_matches(g, positives, 3)


@query(f"WITH {_VEC} SELECT sample_id, 'main' AS head, round(vfl / nb, 8) AS loss_vfl FROM ls JOIN nb USING (sample_id) UNION ALL SELECT sample_id, 'aux_0', round(vfl / nb, 8) FROM ls JOIN nb USING (sample_id)")
def loss_heads(spark, d):
    s, q, g, m = _vectors(spark, d)
    both = q.withColumn("head", F.explode(F.array(F.lit("main"), F.lit("aux_0"))))
    return tidy(losses.criterion(s, both, g, m, losses=("vfl",)).select("sample_id", "head", "loss_vfl"))


_HEADS = f"""WITH {_VEC},
hq AS (SELECT 'main' AS head, * FROM q UNION ALL SELECT 'aux_0', sample_id, query_idx, list_reverse(logits), cy, cx, h, w FROM q UNION ALL SELECT 'dn_0', * FROM q UNION ALL SELECT 'enc_0', * FROM q),
hm AS (SELECT 'main' AS head, sample_id, query_idx, gt_idx, cls, 1 AS groups FROM mt UNION ALL SELECT 'aux_0', sample_id, query_idx, gt_idx, cls, 1 FROM mt UNION ALL SELECT 'enc_0', sample_id, query_idx, gt_idx, 0, 1 FROM mt
  UNION ALL SELECT 'dn_0', q.sample_id, query_idx, g.gt_idx, g.cls, 3 FROM q JOIN nb USING (sample_id) JOIN g ON g.sample_id = q.sample_id AND g.gt_idx = query_idx % nb WHERE query_idx < nb * 3),
h1 AS (SELECT hm.*, abs(hq.cx - g.cx) + abs(hq.cy - g.cy) + abs(hq.w - g.w) + abs(hq.h - g.h) AS l1, hq.cx - hq.w / 2 AS ax1, hq.cy - hq.h / 2 AS ay1, hq.cx + hq.w / 2 AS ax2, hq.cy + hq.h / 2 AS ay2, g.cx - g.w / 2 AS bx1, g.cy - g.h / 2 AS by1, g.cx + g.w / 2 AS bx2, g.cy + g.h / 2 AS by2
  FROM hm JOIN hq ON hq.head = hm.head AND hq.sample_id = hm.sample_id AND hq.query_idx = hm.query_idx JOIN g ON g.sample_id = hm.sample_id AND g.gt_idx = hm.gt_idx),
h2 AS (SELECT *, greatest(least(ax2, bx2) - greatest(ax1, bx1), 0) * greatest(least(ay2, by2) - greatest(ay1, by1), 0) AS inter, (greatest(ax2, bx2) - least(ax1, bx1)) * (greatest(ay2, by2) - least(ay1, by1)) AS hull FROM h1),
h3 AS (SELECT *, (ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - inter AS un FROM h2),
hc AS (SELECT hq.head, hq.sample_id, hq.logits[k + 1] AS x, CASE WHEN h3.cls = k THEN 1.0::DOUBLE ELSE 0 END AS t, CASE WHEN h3.cls = k THEN inter / un ELSE 0 END AS tq
  FROM hq CROSS JOIN (SELECT unnest(range(5)) AS k) LEFT JOIN h3 ON h3.head = hq.head AND h3.sample_id = hq.sample_id AND h3.query_idx = hq.query_idx),
hl AS (SELECT head, sample_id, sum((0.75::DOUBLE * pow(1 / (1 + exp(-x)), 2) * (1 - t) + tq) * (greatest(x, 0) - x * tq + ln(1 + exp(-abs(x))))) AS vfl FROM hc GROUP BY 1, 2),
hb AS (SELECT head, sample_id, max(groups) AS groups, sum(l1) AS bbox, sum(1 - (inter / un - (hull - un) / hull)) AS giou FROM h3 GROUP BY 1, 2)"""


@query(f"{_HEADS} SELECT sample_id, head, round(vfl / (nb * groups), 8) AS loss_vfl, round(5 * bbox / (nb * groups), 8) AS loss_bbox, round(2 * giou / (nb * groups), 8) AS loss_giou, round((vfl + 5 * bbox + 2 * giou) / (nb * groups), 8) AS total FROM hl JOIN hb USING (head, sample_id) JOIN nb USING (sample_id)")
def loss_all_heads(spark, d):
    """Main, auxiliary (other logits and boxes, the main head's matches), denoising (three groups), encoder (class-agnostic)."""
    q, g = b.queries(spark, d), b.vector_gt(spark, d)
    other = q.select("sample_id", "query_idx", F.reverse("logits").alias("logits"), F.col("cy").alias("cx"), F.col("cx").alias("cy"), F.col("h").alias("w"), F.col("w").alias("h"))
    positives = q.select("sample_id", F.col("query_idx").alias("pos"), "query_idx")
    return tidy(losses.head_losses(q.select("sample_id").distinct(), g, q, aux=[other], dn=[q], positives=positives, groups=3, enc=[q], agnostic=True, share_matches=True))


# ---- configurations -------------------------------------------------------------------------------------------

_BASE_SQL = b.BASE_CONFIG
_OVER = f"""ov AS (SELECT event_id, CAST(user_id % 5 AS INTEGER) AS run_number, event_type AS experiment,
  json_merge_patch('{_BASE_SQL}'::JSON, ('{{"run": {{"num_frames": ' || (event_id % 4) || '}}, "camera": {{"fov_min": ' || (event_id % 50 + 40) || '}}, "k": ' || json_extract_string(props, '$.k') || '}}')::JSON) AS c FROM events)"""


@query(f"WITH {_OVER} SELECT event_id, CAST(c->>'$.run.num_frames' AS INTEGER) AS num_frames, c->>'$.run.distractors' AS distractors, CAST(c->>'$.camera.fov_min' AS DOUBLE) AS fov_min, CAST(c->>'$.camera.fov_max' AS DOUBLE) AS fov_max, CAST(c->>'$.k' AS BIGINT) AS k FROM ov")
def config_merge(spark, d):
    base, over = F.parse_json(F.lit(b.BASE_CONFIG)), F.parse_json("override")
    at = lambda path, kind: F.try_variant_get(configs.merged_path(base, over, path), "$", kind)
    return b.overrides(spark, d).select("event_id", at("$.run.num_frames", "int").alias("num_frames"), at("$.run.distractors", "string").alias("distractors"), at("$.camera.fov_min", "double").alias("fov_min"), at("$.camera.fov_max", "double").alias("fov_max"), at("$.k", "long").alias("k"))


@query(f"WITH {_OVER} SELECT event_id, CAST(c->>'$.run.num_frames' AS INTEGER) AS num_frames, CAST(c->>'$.camera.fov_max' AS DOUBLE) AS fov_max, CAST(c->>'$.k' AS BIGINT) AS k FROM ov")
def config_merge_open(spark, d):
    m = b.overrides(spark, d).select("event_id", F.parse_json(configs.deep_merge(F.lit(b.BASE_CONFIG), F.col("override"))).alias("m"))
    return m.select("event_id", F.try_variant_get("m", "$.run.num_frames", "int").alias("num_frames"), F.try_variant_get("m", "$.camera.fov_max", "double").alias("fov_max"), F.try_variant_get("m", "$.k", "long").alias("k"))


@query("SELECT 'exp/' || event_type || '/' || CAST(event_id AS VARCHAR) || '.yaml' AS path, 'exp/base_' || CAST(user_id % 3 AS VARCHAR) || '.yaml' AS parent_path, CAST(user_id % 3 AS BIGINT) AS parent, event_id AS own FROM events UNION ALL SELECT 'exp/base_' || CAST(i AS VARCHAR) || '.yaml', NULL, i, NULL FROM range(3) t(i)")
def config_extends(spark, d):
    e = b.read(spark, d, "events")
    child = e.select(F.concat(F.lit("exp/"), "event_type", F.lit("/"), F.col("event_id").cast("string"), F.lit(".yaml")).alias("path"), F.concat(F.lit("../base_"), (F.col("user_id") % 3).cast("string"), F.lit(".yaml")).alias("extends"), F.concat(F.lit('{"a": {"own": '), F.col("event_id").cast("string"), F.lit("}}")).alias("config"))
    i = F.col("id").cast("string")
    base = spark.range(3).select(F.concat(F.lit("exp/base_"), i, F.lit(".yaml")).alias("path"), F.lit(None).cast("string").alias("extends"), F.concat(F.lit('{"a": {"base": '), i, F.lit(', "own": null}}')).alias("config"))
    r = configs.resolve_extends(child.unionByName(base)).withColumn("v", F.parse_json("config"))
    return r.select("path", "parent_path", F.try_variant_get("v", "$.a.base", "long").alias("parent"), F.try_variant_get("v", "$.a.own", "long").alias("own"))


_TRIALS = """SELECT 'dist_' || CAST(p_partkey AS VARCHAR) AS distribution_id, CAST(p_size % 9 + 1 AS INTEGER) AS num_frames, CASE p_size % 3 WHEN 0 THEN 'None' WHEN 1 THEN 'warehouse' ELSE 'additional' END AS distractors,
  round(p_retailprice % 7 / 3, 4) AS height_min, CAST(p_size + 60 AS INTEGER) AS fov_max, round(p_retailprice % 2, 4) AS blur_max, 0.1235::DOUBLE AS roughness_min, CAST(p_size * 3000 AS DOUBLE) AS intensity_std"""


@query(f"{_TRIALS} FROM part")
def trial_configs(spark, d):
    c = configs.trial_configs(b.trials(spark, d), "../sdg_config.yaml")
    return c.select("distribution_id", "config.run.num_frames", "config.run.distractors", F.col("config.camera.camera_height_min").alias("height_min"), "config.camera.fov_max", F.col("config.camera.motion_blur_strength_max").alias("blur_max"), "config.materials.roughness_min", "config.lighting.intensity_std")


@query("SELECT 'dist_' || CAST(p_partkey AS VARCHAR) AS distribution_id, array_to_string(['/Isaac/Materials/Textures/Patterns/' || x FOR x IN CASE WHEN len(w) > 1 AND w[1] = w[2] THEN w[1:1] ELSE w END], ',') AS textures FROM (SELECT *, string_split(p_name, ' ')[1:3] AS w FROM part)")
def texture_distinct(spark, d):
    c = configs.trial_configs(b.trials(spark, d), "../sdg_config.yaml")
    return c.select("distribution_id", F.array_join("config.materials.textures", ",").alias("textures"))


@query("SELECT p_partkey, round(20.955 / (2 * tan(radians(p_size + 40) / 2)), 8) AS focal_max, round(20.955 / (2 * tan(radians(p_size + 60) / 2)), 8) AS focal_min FROM part")
def fov_focal(spark, d):
    p = b.read(spark, d, "part")
    return tidy(p.select("p_partkey", scalars.focal_length((F.col("p_size") + 40).cast("double")).alias("focal_max"), scalars.focal_length((F.col("p_size") + 60).cast("double")).alias("focal_min")))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'synth' ELSE 'real' END AS data_type FROM events")
def data_type(spark, d):
    e = b.overrides(spark, d)
    return e.select("event_id", samples.data_type(F.when(F.col("event_id") % 2 == 0, F.parse_json("override"))).alias("data_type"))


@query(f"""WITH {_OVER} SELECT event_id AS sample_id, CASE WHEN on_ THEN CAST(run_number AS DOUBLE) END AS synth_run_number, CASE WHEN on_ THEN experiment ELSE '' END AS synth_experiment, CASE WHEN on_ THEN 'None' ELSE '' END AS synth_distractors,
  CASE WHEN on_ THEN CAST(c->>'$.camera.fov_min' AS DOUBLE) END AS synth_fov_min, CASE WHEN on_ THEN 960.0::DOUBLE END AS synth_render_width, CASE WHEN on_ THEN 0.0::DOUBLE END AS synth_jpeg_quality_min, CAST(NULL AS DOUBLE) AS synth_materials_roughness_min,
  CASE WHEN on_ THEN 'b.jpg' ELSE '' END AS synth_texture_2, '' AS synth_texture_25, CASE WHEN on_ THEN 1.0::DOUBLE END AS synth_palletjack_color_randomized, CASE WHEN on_ THEN 3.0::DOUBLE END AS synth_num_warehouse_distractors FROM (SELECT *, event_id % 3 > 0 AS on_ FROM ov)""")
def synth_metadata_flat(spark, d):
    extra = '{"materials": {"textures": ["/t/a.jpg", "/t/b.jpg"]}, "palletjacks": {"color_max": [0, 0.5, 0]}, "distractors_warehouse": {"assets": ["x", "y", "y"]}}'
    o = b.overrides(spark, d)
    on, late = F.col("event_id") % 3 > 0, F.col("event_id") % 3 == 2
    base, extra, over = (F.when(on, F.parse_json(c)) for c in (F.lit(b.BASE_CONFIG), F.lit(extra), F.col("override")))
    layers = base.alias("base"), F.when(late, over).otherwise(extra).alias("middle"), F.when(late, extra).otherwise(over).alias("top")
    s = o.select(F.col("event_id").alias("sample_id"), *layers, "run_number", "experiment", F.lit(1).alias("n_annotations"))
    m = configs.synth_metadata(s, ("base", "middle", "top"))
    return tidy(m.select("sample_id", "synth_run_number", "synth_experiment", "synth_distractors", "synth_fov_min", "synth_render_width", "synth_jpeg_quality_min", "synth_materials_roughness_min", "synth_texture_2", "synth_texture_25", "synth_palletjack_color_randomized", "synth_num_warehouse_distractors"))


# ---- through SQL text -------------------------------------------------------------------------------------------


def _views(spark, d) -> None:
    sql.register(spark)
    gt, top = b.gt(spark, d), b.top(spark, d)
    gt.select("sample_id", "gt_idx", "cls", F.array("cx", "cy", "w", "h").alias("box")).createOrReplaceTempView("detframe_gt")
    top.withColumn("box", F.array(*[F.col(c) / 640 for c in ("x1", "y1", "x2", "y2")])).createOrReplaceTempView("detframe_top")
    b.queries(spark, d).withColumn("box", F.array("cx", "cy", "w", "h")).createOrReplaceTempView("detframe_queries")
    b.vector_gt(spark, d).withColumn("box", F.array("cx", "cy", "w", "h")).createOrReplaceTempView("detframe_vector_gt")


@query(ORACLES["giou_pairs"])
def sql_giou_pairs(spark, d):
    _views(spark, d)
    return tidy(spark.sql("SELECT sample_id, gt_idx, pred_idx, iou_exact(xyxy(g.box), p.box) AS iou, giou(xyxy(g.box), p.box) AS giou FROM detframe_gt g JOIN detframe_top p USING (sample_id)"), 10)


_SQL_COSTS = """SELECT sample_id, gt_idx, query_idx,
  5 * l1(q.box, g.box) + 2 * focal_class_cost(sigmoid(get(logits, cls)), 0.25D, 2D) - 2 * giou(xyxy(q.box), xyxy(g.box)) AS cost
FROM detframe_vector_gt g JOIN detframe_queries q USING (sample_id)"""


@query(ORACLES["match_assign"])
def sql_match_assign(spark, d):
    _views(spark, d)
    return tidy(spark.sql(f"WITH costs AS ({_SQL_COSTS}) SELECT sample_id, count(*) AS n, sum(cost) AS total_cost FROM match_boxes(TABLE(costs) PARTITION BY sample_id) GROUP BY sample_id"))


#: Many samples to a partition of a table function, in order.
_BLOCKS = "PARTITION BY pmod(xxhash64(sample_id), 4096) ORDER BY sample_id"


@query(f"{_SCORED} SELECT sample_id, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT CASE WHEN iou >= 0.1 THEN gt_idx END) AS BIGINT) AS tp, round(sum(iou), 8) AS iou FROM scored WHERE rn = 1 GROUP BY 1")
def sql_greedy_pairs(spark, d):
    """The best ground truth of each prediction, from a table function; the true positives as of det_prf_iou."""
    _views(spark, d)
    return tidy(spark.sql(f"""
        WITH pairs AS (SELECT sample_id, gt_idx, pred_idx, iou(xyxy(g.box), p.box) AS iou FROM detframe_gt g JOIN detframe_top p USING (sample_id))
        SELECT sample_id, count(*) AS n, count(DISTINCT CASE WHEN iou >= 0.1 THEN gt_idx END) AS tp, sum(iou) AS iou FROM greedy_pairs(TABLE(pairs) {_BLOCKS}) GROUP BY sample_id"""))


@query()
def sql_box_clusters(spark, d):
    _views(spark, d)
    return spark.sql(f"SELECT * FROM cluster_boxes(TABLE(SELECT sample_id, query_idx, label, x1, y1, x2, y2, score FROM detframe_top) {_BLOCKS})")


# ---- augmentation ------------------------------------------------------------------------------------------------


@query(f"""WITH {_ANN}, dr AS (SELECT *, o_orderkey * 7919 % 1000 / 1000.0::DOUBLE AS u FROM orders, range(2) t(e)),
p AS (SELECT o_orderkey AS sample_id, CAST(e AS INTEGER) AS epoch, (o_orderkey + e) % 2 = 0 AS mirrored, 0.5 + u AS zoom, 8 * u - 4 AS dx, 4 - 8 * u AS dy FROM dr),
m AS (SELECT sample_id, epoch, ann_pos, zoom, w, h, mirrored, zoom * (x - 480) + 480 + p.dx AS l, zoom * (x + w - 480) + 480 + p.dx AS r, zoom * (y - 272) + 272 + p.dy AS t, zoom * (y + h - 272) + 272 + p.dy AS b FROM ann JOIN p USING (sample_id)),
c AS (SELECT *, least(greatest(CASE WHEN mirrored THEN 960 - r ELSE l END, 0), 960) AS x1, least(greatest(CASE WHEN mirrored THEN 960 - l ELSE r END, 0), 960) AS x2, least(greatest(t, 0), 544) AS y1, least(greatest(b, 0), 544) AS y2 FROM m)
SELECT sample_id, epoch, ann_pos, round(x1, 6) AS x, round(y1, 6) AS y, round(x2 - x1, 6) AS w, round(y2 - y1, 6) AS h, round((x2 - x1) * (y2 - y1) / (zoom * zoom * w * h), 6) AS share FROM c
WHERE x2 - x1 >= 20 AND y2 - y1 >= 20 AND (x2 - x1) * (y2 - y1) / (zoom * zoom * w * h) > 0.25""")
def augmented_boxes(spark, d):
    """Two epochs of maps by arithmetic of the key, where SQL can follow; augment.draws has the hashed ones."""
    o = b.read(spark, d, "orders").select(F.col("o_orderkey").alias("sample_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch"))
    u = F.col("sample_id") * 7919 % 1000 / 1000.0
    drawn = o.select("sample_id", "epoch", ((F.col("sample_id") + F.col("epoch")) % 2 == 0).alias("mirrored"), (0.5 + u).alias("zoom"), (8 * u - 4).alias("dx"), (4 - 8 * u).alias("dy"))
    return tidy(augment.augment_boxes(b.annotations(spark, d).select("sample_id", "ann_pos", "x", "y", "w", "h"), drawn, 960, 544, min_share=0.25), 6)


@query()
def augmented_images(spark, d):
    """The colours of one epoch drawn by hash, over all images."""
    i = _vector_images(spark, d)
    a = augment.augment_images(i, augment.draws(i.select("sample_id"), 1))
    return a.select("sample_id", "epoch", F.sha2("data", 256).alias("sha256"))


# ---- all plug-ins in one plan -------------------------------------------------------------------------------------


@query(f"""{_METRICS}{_CONFUSION.removeprefix(_SCORED)},
ne AS (SELECT sample_id, CAST(count(*) AS INTEGER) AS n_elements, round(sum(confidence), 8) AS confidence FROM el GROUP BY 1),
no AS (SELECT sample_id, count(*) AS n_objects FROM valid GROUP BY 1)
SELECT sample_id, round(precision, 8) AS precision, round(recall, 8) AS recall, round(f1, 8) AS f1, tp, fp, fn, round(met.iou, 8) AS iou, round(met.accuracy, 8) AS accuracy, n_elements, confidence, coalesce(n_objects, 0) AS n_objects
FROM met LEFT JOIN ne USING (sample_id) LEFT JOIN no USING (sample_id)""")
def evaluate_plugins(spark, d):
    """Metrics, confusion elements and metadata of each sample from one evaluation of the registry."""
    sides = evaluation.Sides(b.samples(spark, d), b.annotations(spark, d), b.predictions(spark, d))
    names = ("precision", "recall", "f1", "tp", "fp", "fn", "iou", "accuracy")
    found = evaluation.evaluate(sides, [*(("metric", n) for n in names), ("metric", "Confusion Matrix"), ("metadata", "metadata")])
    confidence = F.aggregate("Confusion Matrix", F.lit(0.0), lambda acc, e: acc + e["confidence"])
    out = written(found.select("sample_id", *names, F.size("Confusion Matrix").alias("n_elements"), confidence.alias("confidence"), F.col("metadata.n_objects").alias("n_objects")), "evaluation")
    sides.close()
    return tidy(out)


# ---- frames from a stream -----------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT 'palletjack_run_' || CAST(user_id % 12 AS VARCHAR) AS run_dir, event_type AS experiment, event_id, CAST(row_number() OVER (PARTITION BY user_id % 12, event_type ORDER BY event_id) - 1 AS INTEGER) AS frame FROM events)
SELECT run_dir, experiment, frame, CAST(event_id % 3 AS INTEGER) AS n, CAST(CASE event_id % 3 WHEN 0 THEN 0 ELSE (event_id % 3) * (event_id % 600) + (event_id % 3) * (event_id % 3 - 1) / 2 END AS DOUBLE) AS x_sum FROM e""")
def stream_frames(spark, d):
    """Labels before and after their configurations, as a stream; frames come out whole."""
    e = b.read(spark, d, "events").select("event_id", "event_type", (F.col("user_id") % 12).alias("run"))
    e = e.select(F.concat(F.lit("palletjack_run_"), F.col("run").cast("string")).alias("run_dir"), F.col("event_type").alias("experiment"), "event_id", (F.row_number().over(Window.partitionBy("run", "event_type").orderBy("event_id")) - 1).alias("frame"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("event_id") % 1000)
    config = F.concat(F.lit('{"run": {"num_frames": '), F.count(F.lit(1)).cast("string"), F.lit("}}"))
    configs_ = e.groupBy("run_dir", "experiment").agg(config.alias("config")).withColumn("event_time", F.timestamp_seconds(F.lit(1_700_000_500)))
    # Few rows, of many frames each: by a given number, or all would go to one task.
    configs_ = configs_.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "run_dir", "experiment")
    few = F.when(F.col("event_id") % 3 > 0, F.sequence(F.lit(0), (F.col("event_id") % 3 - 1).cast("int")))
    labels = e.withColumn("ann_pos", F.explode(few)).select("run_dir", "experiment", "frame", "ann_pos", F.lit(11).alias("category_id"), (F.col("event_id") % 600 + F.col("ann_pos")).cast("double").alias("x"), *[F.lit(1.0).alias(c) for c in "ywh"], at.alias("event_time"))
    folder, target = scratch(spark, "arrivals"), scratch(spark, "assembled")
    end = spark.range(1).select(F.lit("end").alias("run_dir"), F.lit("").alias("experiment"), F.lit(0).alias("frame"), F.timestamp_seconds(F.lit(1_800_000_000)).alias("event_time"), *[F.lit(0).alias(c) for c in assembly.LABEL])
    early = F.col("frame") % 2 == 0
    nothing = configs_.limit(0)
    for part in (assembly.events(nothing, labels.where(early)), assembly.events(configs_, labels.where(~early)), assembly.events(nothing, end)):
        part.write.mode("append").parquet(folder)
    frames.run_available(assembly.assembled(frames.stream_events(spark, folder, assembly.EVENT)), target, scratch(spark, "assembly"))
    x = F.aggregate("annotations", F.lit(0.0), lambda acc, a: acc + a["x"])
    return spark.read.parquet(target).select("run_dir", "experiment", "frame", F.size("annotations").alias("n"), x.alias("x_sum"))


# ---- from files --------------------------------------------------------------------------------------------------

#: Bytes of a range and rows of a document: small, so that documents are split on small tables, too.
_RANGE, _DOCUMENT_ROWS = 1 << 20, 200_000


@query(ORACLES["gt_normalized"])
def gt_from_documents(spark, d):
    """Annotation documents are written, split by byte ranges and read back to ground truth."""
    s, a = b.samples(spark, d), b.annotations(spark, d)
    folder = scratch(spark, "documents")
    images = s.select(F.col("sample_id").alias("image_id"), "path", "width", "height")
    coco.write_coco(images, a.select(F.col("sample_id").alias("image_id"), "ann_pos", "category_id", F.array("x", "y", "w", "h").alias("bbox")), folder, 1 + a.count() // _DOCUMENT_ROWS)
    i, n = coco.read_coco_ranges(spark, f"{folder}/*.json", _RANGE)
    n = coco.box_columns(n.withColumnRenamed("image_id", "sample_id"))
    return tidy(gts.ground_truth(i.withColumnRenamed("image_id", "sample_id"), n, samples.categories(spark)))


@query(f"WITH {_ANN} SELECT sample_id, CAST(i - 1 AS INTEGER) AS pos, n, cls[i] AS category_id, round(x[i], 4) AS x, round(y[i], 4) AS y FROM (SELECT sample_id, count(*) AS n, list(category_id ORDER BY ann_pos) AS cls, list(x ORDER BY ann_pos) AS x, list(y ORDER BY ann_pos) AS y, unnest(range(1, count(*) + 1)) AS i FROM ann GROUP BY 1)")
def record_shards(spark, d):
    """A record for each sample, in shards of two folds, read back with their checksums."""
    a, folder = b.annotations(spark, d), scratch(spark, "shards")
    rows = a.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("ann_pos", "category_id", "x", "y"))).alias("a"), F.count(F.lit(1)).alias("n"))
    rows = rows.select("sample_id", "n", F.col("a.category_id").alias("category_id"), F.col("a.x").alias("x"), F.col("a.y").alias("y"))
    records.write_shards(randomize.hash_split(rows, "sample_id"), folder, ["sample_id"], 10)
    back = records.read_shards(spark, folder, "sample_id long, n long, category_id array<int>, x array<float>, y array<float>")
    z = back.select("sample_id", "n", F.posexplode(F.arrays_zip("category_id", "x", "y")).alias("pos", "z"))
    return tidy(z.select("sample_id", "pos", "n", "z.category_id", "z.x", "z.y"), 4)


@query(ORACLES["trial_configs"])
def trial_configs_from_csv(spark, d):
    """The trial table goes through a CSV file, and a header that isn't in the order of its use."""
    folder = scratch(spark, "trials")
    t = b.trials(spark, d)
    t.select(*[f"`{c}`" for c in reversed(t.columns)]).write.option("header", True).option("emptyValue", "").csv(folder)
    c = configs.trial_configs(read_trials(spark, folder), "../sdg_config.yaml")
    return c.select("distribution_id", "config.run.num_frames", "config.run.distractors", F.col("config.camera.camera_height_min").alias("height_min"), "config.camera.fov_max", F.col("config.camera.motion_blur_strength_max").alias("blur_max"), "config.materials.roughness_min", "config.lighting.intensity_std")


# ---- labels, runs, generation ----------------------------------------------------------------------------------


@query(f"WITH {_ANN} SELECT sample_id, ann_pos, 11 AS category_id, x, y, w, h FROM ann WHERE ann_pos % 5 <> 0 AND category_id % 3 <> 2")
def kitti_parse(spark, d):
    return tidy(kitti.parse_labels(b.label_lines(spark, d)))


@query(f"WITH {_ANN} SELECT sample_id, ann_pos, 'palletjack 0.00 0 0.00 ' || printf('%.2f', x) || ' ' || printf('%.2f', y) || ' ' || printf('%.2f', x + w) || ' ' || printf('%.2f', y + h) || repeat(' 0.00', 7) AS line FROM ann")
def kitti_write(spark, d):
    a = b.annotations(spark, d)
    return a.select("sample_id", "ann_pos", kitti.label_line(F.lit("palletjack"), F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("line"))


@query("SELECT DISTINCT 'palletjack_run_' || CAST(user_id % 12 AS VARCHAR) AS run_dir, event_type AS experiment, CAST(user_id % 12 AS INTEGER) AS run_number FROM events")
def run_discovery(spark, d):
    e = b.read(spark, d, "events")
    paths = e.select(F.concat(F.lit("/data/palletjack_run_"), (F.col("user_id") % 12).cast("string"), F.lit("/"), "event_type", F.lit("/run_config.yaml")).alias("path"))
    return kitti.run_dirs(paths)


@query("SELECT i AS run_number FROM range(20) t(i) WHERE i NOT IN (SELECT user_id % 12 FROM events)")
def run_missing(spark, d):
    have = b.read(spark, d, "events").select((F.col("user_id") % 12).alias("run_number"))
    return samples.missing_runs(spark.range(20).withColumnRenamed("id", "run_number"), have)


@query(f"WITH {_OVER} SELECT event_id, CAST(unnest(range(CAST(c->>'$.run.num_frames' AS BIGINT))) AS INTEGER) AS frame, run_number FROM ov")
def run_frames(spark, d):
    return kitti.frames(b.overrides(spark, d).select("event_id", "run_number", F.col("override").alias("config"))).select("event_id", "frame", "run_number")


def _synth_frames(spark, d) -> DataFrame:
    e = b.read(spark, d, "events")
    return e.select(F.col("event_id").cast("string").alias("sample_id"), F.lit("additional").alias("state"), F.concat(F.lit("palletjack_run_"), (F.col("user_id") % 12).cast("string")).alias("run_dir"), F.col("event_type").alias("experiment"), F.col("event_id").alias("frame"), (F.col("user_id") % 12).alias("run_number"))


@query("SELECT sample_id, position FROM (SELECT sample_id, row_number() OVER (ORDER BY run_number, run_dir, event_type, event_id) - 1 AS position FROM (SELECT *, row_number() OVER (ORDER BY run_dir, event_type, event_id) AS r FROM (SELECT CAST(event_id AS VARCHAR) AS sample_id, event_id, event_type, user_id % 12 AS run_number, 'palletjack_run_' || CAST(user_id % 12 AS VARCHAR) AS run_dir FROM events)) WHERE r <= 500)")
def synth_order(spark, d):
    return samples.ordered_synth(_synth_frames(spark, d), num_samples=500).select("sample_id", F.col("position").cast("long").alias("position"))


@query("SELECT CAST(event_id AS VARCHAR) AS sample_id, row_number() OVER (ORDER BY user_id % 12, 'palletjack_run_' || CAST(user_id % 12 AS VARCHAR), event_type, event_id) - 1 AS position FROM events")
def synth_order_all(spark, d):
    """Every frame of every experiment; synth_order shows the cap on one of them."""
    return samples.ordered_synth(_synth_frames(spark, d)).select("sample_id", F.col("position").cast("long").alias("position"))


@query("SELECT DISTINCT user_id AS sample_id, max(event_id) AS event_id FROM events GROUP BY 1")
def latest_duplicate(spark, d):
    return samples.latest_by_id(b.read(spark, d, "events").select(F.col("user_id").alias("sample_id"), "event_id"), "event_id")


@query()
def frame_randomize(spark, d):
    f = b.read(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("run"), F.col("o_orderkey").alias("frame"))
    return randomize.frame_draws(f)


@query()
def material_randomize(spark, d):
    f = b.read(spark, d, "orders").select((F.col("o_orderkey") % 5).alias("run"), F.col("o_orderkey").alias("frame"))
    return randomize.material_draws(f, ["/a.jpg", "/b.jpg", "/c.jpg"])


_FOCAL = "20.955 / (2 * tan(radians({}::DOUBLE) / 2))"


@query(f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'tilt' ELSE 'look_at' END AS aim,
  round(CASE event_id % 4 WHEN 0 THEN 18.0 WHEN 3 THEN NULL ELSE {_FOCAL.format(90)} END, 8) AS focal_min, round(CASE event_id % 4 WHEN 0 THEN 50.0 WHEN 3 THEN NULL ELSE {_FOCAL.format('(event_id % 50 + 40)')} END, 8) AS focal_max,
  CASE event_type WHEN 'click' THEN '/root/a,/root/b' WHEN 'view' THEN '/root/c' ELSE '' END AS pool FROM events""")
def generation_modes(spark, d):
    text = F.when(F.col("event_type") == "click", "warehouse").when(F.col("event_type") == "view", "additional").otherwise("None")
    e = b.read(spark, d, "events").withColumn("distractors", text)
    number = lambda c, k: F.when(c, F.lit(k).cast("double"))
    lens, view = F.col("event_id") % 4 == 0, F.col("event_id") % 4 < 3
    camera = F.struct(
        number(F.col("event_id") % 3 == 0, -80).alias("camera_tilt_min"), number(lens, 18).alias("focal_length_min"), number(lens, 50).alias("focal_length_max"),
        F.when(view, (F.col("event_id") % 50 + 40).cast("double")).alias("fov_min"), number(view, 90).alias("fov_max"),
    )
    pools = F.struct(F.array(F.lit("/a"), F.lit("/b")).alias("assets")).alias("distractors_warehouse"), F.struct(F.array(F.lit("/c")).alias("assets")).alias("distractors_additional")
    config = F.parse_json(F.to_json(F.struct(F.struct("distractors").alias("run"), camera.alias("camera"), *pools)))
    m = randomize.generation_modes(e.select("event_id", config.alias("config")), "/root")
    return tidy(m.select("event_id", "aim", "focal_min", "focal_max", F.array_join("distractor_pool", ",").alias("pool")))


@query()
def hash_split(spark, d):
    return randomize.hash_split(b.samples(spark, d), "sample_id").select("sample_id", "fold", "shard")


def _vector_images(spark, d) -> DataFrame:
    """A small BGR image of each vector: 8 x 8 pixels, three times the vector's values as bytes."""
    byte = F.transform("embedding", lambda x: F.lpad(F.hex(F.pmod(F.round(x.cast("double") * 100).cast("long"), F.lit(256))), 2, "0"))
    e = b.read(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"), byte.alias("v"))
    data = F.unhex(F.array_join(F.transform("v", lambda x: F.concat(x, x, x)), ""))
    return e.select("sample_id", data.alias("data"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("channels"))


@query()
def image_sharpness(spark, d):
    return images.sharpness(_vector_images(spark, d), size=64)


@query()
def image_tensor(spark, d):
    return images.image_tensors(_vector_images(spark, d), size=64).select("sample_id", F.length("tensor").alias("n_bytes"), F.sha2("tensor", 256).alias("sha256"))


@query()
def box_clusters(spark, d):
    from ..operators.clustering import cluster_boxes

    return cluster_boxes(b.top(spark, d))
