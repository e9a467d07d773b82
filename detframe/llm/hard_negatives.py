"""Hard-negative mining by blocked matrix products.

The rows are written once, as integers. Anchors are dealt to blocks of about `block` rows by a hash of their row; one
block at a time is broadcast (its size is bounded, whatever the input), and every task multiplies it with its own
batches of candidates, tile by tile, in float64: exact while products stay below 2 ** 53, else the tile is multiplied
as 64-bit integers. A task keeps the best rows of each anchor and merges those of each batch into them, so it returns
at most `positives` rows an anchor; the same merge over all tasks, a ranked window, gives the block's positives. They
are broadcast with the block for the second pass, which keeps for each of them the best rows of other labels whose
score lies in its window.

Scores are integers and ranked from high to low, equal ones by ascending vec_id.

Defined results: rows take no part if vec_id, label or vector is null, a component is null, NaN or infinite, or the
vector's length isn't the most frequent one (of equals the longer); components beyond `vectors.limit` are set to it.
A row is never its own partner, but another row with its vec_id may be; repeated anchors are mined each. A positive
without any negative gives no rows; no anchors, or an empty table, give none; further columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, table
from .vectors import finite, integers, matrix, usual_length

POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
#: Anchors of a block (4 MB of float64 at 64 components), and rows of a tile's two sides.
BLOCK, TILE_ANCHORS, TILE_ROWS = 8192, 512, 4096
SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_NONE = np.iinfo(np.int64).min


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of a and b, exact; float64 where that is enough."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return a.astype(np.float64) @ b.astype(np.float64).T if most < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


class _Best:
    """The k best (score, id, row) of each of n slots, ranked; scores of free places are the least integer."""

    def __init__(self, n: int, k: int):
        self.score, self.id, self.row = np.full((n, k), _NONE), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

    def offer(self, at: np.ndarray, scores: np.ndarray, open_: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """scores and open_ (may it enter?): a matrix with a row for each slot of `at` and a column for each of ids, which ascend."""
        k = self.score.shape[1]
        low = np.finfo(np.float64).min if scores.dtype == np.float64 else _NONE
        left = np.where(open_, scores, low)
        # Only slots that the tile can change; of equal scores a smaller id may enter.
        use = np.flatnonzero(open_.any(axis=1) & (left.max(axis=1) >= self.score[at, -1]))
        if not len(use):
            return
        left, own = left[use], at[use]
        score, ident, row = [self.score[own]], [self.id[own]], [self.row[own]]
        lines = np.arange(len(use))
        for _ in range(min(k, left.shape[1])):
            best = left.argmax(axis=1)  # the first of equals has the smallest id
            top = left[lines, best]
            free = top == low
            score.append(np.where(free, _NONE, np.where(free, 0, top).astype(np.int64))[:, None])
            ident.append(ids[best][:, None])
            row.append(rows[best][:, None])
            left[lines, best] = low
        score, ident, row = np.hstack(score), np.hstack(ident), np.hstack(row)
        order = np.lexsort((row, ident, -np.maximum(score, _NONE + 1)), axis=1)[:, :k]
        self.score[own], self.id[own], self.row[own] = (np.take_along_axis(m, order, axis=1) for m in (score, ident, row))


def _tiles(batches, length: int):
    """(vec_id, label, row, v) of pieces of the batches, ascending by vec_id."""
    for batch in batches:
        for start in range(0, batch.num_rows, TILE_ROWS):
            piece = batch.slice(start, TILE_ROWS)
            ids, labels, rows = (piece.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            order = np.lexsort((rows, ids))
            yield ids[order], labels[order], rows[order], matrix(piece.column(3), length)[order]


def _positives(block, k: int, length: int):
    def run(batches):
        own = block.value
        best = _Best(len(own["row"]), k)
        for ids, labels, rows, v in _tiles(batches, length):
            for start in range(0, len(own["row"]), TILE_ANCHORS):
                at = np.arange(start, min(start + TILE_ANCHORS, len(own["row"])))
                fits = (own["label"][at][:, None] == labels) & (own["row"][at][:, None] != rows)
                best.offer(at, products(own["v"][at], v), fits, ids, rows)
        at, place = np.nonzero(best.score != _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at, best.score[at, place], best.id[at, place], best.row[at, place])], ["at", "score", "id", "row"])

    return run


def _negatives(block, slots, k: int, low: int, high: int, length: int):
    """slots: anchor (its place in the block), id and score of each positive, ascending by anchor."""

    def run(batches):
        own, pos = block.value, slots.value
        best = _Best(len(pos["at"]), k)
        # low * score <= 100 * other <= high * score, in whole numbers
        least, most = -((-low * pos["score"]) // 100), (high * pos["score"]) // 100
        for ids, labels, rows, v in _tiles(batches, length):
            for start in range(0, len(own["row"]), TILE_ANCHORS):
                stop = min(start + TILE_ANCHORS, len(own["row"]))
                first, last = np.searchsorted(pos["at"], [start, stop])
                if first == last:
                    continue
                scores, other = products(own["v"][start:stop], v), own["label"][start:stop][:, None] != labels
                rank = pos["rank"][first:last]
                for r in np.unique(rank):  # one positive of each anchor at a time
                    at = first + np.flatnonzero(rank == r)
                    line = pos["at"][at] - start
                    s = scores[line]
                    best.offer(at, s, other[line] & (s >= least[at][:, None]) & (s <= most[at][:, None]), ids, rows)
        at, place = np.nonzero(best.score != _NONE)
        out = (pos["at"][at], pos["rank"][at], own["id"][pos["at"][at]], pos["id"][at], pos["score"][at], best.score[at, place], best.id[at, place])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["at", "slot", "anchor_id", "positive_id", "positive_score", "score", "id"])

    return run


def hard_negatives(rows: DataFrame, anchor: str, vec_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK) -> DataFrame:
    """SCHEMA's columns for the rows (vec_id, label: integers; vectors) that the SQL condition `anchor` names.

    A negative's score is at least low and at most high percent of its positive's.
    """
    spark = rows.sparkSession
    length = usual_length(rows, vec_col)
    v = F.col(vec_col)
    kept = rows.where(finite(v) & (F.size(v) == length) & F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    kept = kept.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.monotonically_increasing_id().alias("row"), integers(v, length).alias("v"), F.coalesce(F.expr(anchor), F.lit(False)).alias("anchor"))
    kept = materialize(kept, "negatives-rows")
    anchors = kept.where("anchor").drop("anchor")
    blocks = -(-anchors.count() // block)
    anchors = materialize(anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(max(1, blocks)))), "negatives-anchors")
    candidates, done = kept.drop("anchor"), []
    for b in range(blocks):
        own = anchors.where(F.col("block") == b).toArrow()
        if not own.num_rows:
            continue
        sent = spark.sparkContext.broadcast({"id": own["vec_id"].to_numpy(), "label": own["label"].to_numpy(), "row": own["row"].to_numpy(), "v": matrix(own["v"].combine_chunks(), length)})
        tops = candidates.mapInArrow(_positives(sent, positives, length), "at long, score long, id long, row long")
        rank = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("score"), "id", "row"))
        found = tops.withColumn("rank", rank).where(F.col("rank") <= positives).toArrow().sort_by([("at", "ascending"), ("rank", "ascending")])
        slots = spark.sparkContext.broadcast({c: found[c].to_numpy() for c in ("at", "rank", "id", "score")})
        lows = candidates.mapInArrow(_negatives(sent, slots, negatives, low, high, length), "at long, slot int, anchor_id long, positive_id long, positive_score long, score long, id long")
        rank = F.row_number().over(Window.partitionBy("at", "slot").orderBy(F.desc("score"), "id"))
        best = lows.withColumn("rank", rank).where(F.col("rank") <= negatives)
        done.append(materialize(best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives-block"))
        sent.unpersist()
        slots.unpersist()
    out = spark.createDataFrame([], SCHEMA)
    for part in done:
        out = part if part is done[0] else out.union(part)
    return out


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, "vec_id % 50 = 0")


OP13_SQL = """
WITH kept AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT coalesce(list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding]), false)),
scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positive AS (SELECT * FROM scored WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.other_id ORDER BY n.score DESC, n.other_id) AS rank
  FROM positive p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 3
"""
