"""Product quantisation: vectors become one byte a part, through codebooks that exponion search assigns exactly.

A vector of integers is cut into equal parts; each part position has a codebook of at most 256 entries. Rounds of
assignment and floored means move the entries. The search for a part's nearest entry starts at the entry a it had in
the round before (entry 0 in the first), at squared distance f. An entry j that is as near as the best so far, at
squared distance b, lies at sqrt(f) + sqrt(b) from a at most, so its squared distance from a is at most 2 (f + b):
the list of all entries sorted by their distance from a is scanned up to that radius, which shrinks with b. All is
integer arithmetic, ties go to the lower index, so the result is that of comparing all entries.

Each round writes one table (vectors and codes) and adds up sums and counts by part, entry and component inside the
tasks; the driver sees one row of each of these only (parts * entries * components of a part).

Defined results: rows whose vector is null, or has a null, NaN or infinite component, go, and so do vectors of
another length than the most frequent one that can be cut (of equals the longer); components whose scaled value is
beyond `vectors.limit` (2 ** 26 for 64 of them) are set to it; of equal ids the lesser vector comes first, null ids
come last; fewer rows than entries make as many entries; repeated rows count each and get one code; null labels are
one label; an empty table gives no rows; further columns are dropped.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, with_totals
from .vectors import integers, finite, matrix, usual_length

PARTS, ENTRIES, ROUNDS = 16, 64, 2


def nearest(x: np.ndarray, start: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and its squared distance, of each row of x; start: an entry to begin at."""
    gap = ((book[:, None] - book[None]) ** 2).sum(axis=2)
    order = np.argsort(gap, axis=1, kind="stable")
    gap = np.take_along_axis(gap, order, axis=1)
    first = ((x - book[start]) ** 2).sum(axis=1)
    best, dist = start.copy(), first.copy()
    rows = np.arange(len(x))
    for rank in range(len(book)):
        # Along the list gaps grow and distances fall: a row that is done stays done.
        rows = rows[gap[start[rows], rank] <= 2 * (first[rows] + dist[rows])]
        if not len(rows):
            break
        entry = order[start[rows], rank]
        d = ((x[rows] - book[entry]) ** 2).sum(axis=1)
        better = (d < dist[rows]) | ((d == dist[rows]) & (entry < best[rows]))
        best[rows[better]], dist[rows[better]] = entry[better], d[better]
    return best, dist


def _codes(column, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), parts).astype(np.int64)


def _assign(books: np.ndarray, length: int):
    """Rows (row, v, code) with codes and errors anew. books: parts x entries x components."""
    parts, _, width = books.shape

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), length).astype(np.int64)
            before, after, error = _codes(batch.column(2), parts), np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                after[:, p], d = nearest(x[:, p * width : (p + 1) * width], before[:, p], books[p])
                error += d
            code = pa.array([r.tobytes() for r in after], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), code, pa.array(error)], ["row", "v", "code", "error"])

    return run


def _sums(shape: tuple[int, int, int], length: int):
    """Rows (part, entry, at, total, n) of a task."""
    parts, entries, width = shape

    def run(batches):
        total, n = np.zeros(shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x, code = matrix(batch.column(0), length), _codes(batch.column(1), parts)
            for p in range(parts):
                n[p] += np.bincount(code[:, p], minlength=entries)
                for i in range(width):  # below 2 ** 53 in a batch
                    total[p, :, i] += np.bincount(code[:, p], weights=x[:, p * width + i], minlength=entries).astype(np.int64)
        p, e, i = np.nonzero(np.broadcast_to(n[:, :, None] > 0, shape))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(i), pa.array(total[p, e, i]), pa.array(n[p, e])], ["part", "entry", "at", "total", "n"])

    return run


def _moved(books: np.ndarray, coded: DataFrame, length: int) -> np.ndarray:
    """Each entry with parts is their componentwise floored mean."""
    sums = coded.select("v", "code").mapInArrow(_sums(books.shape, length), "part long, entry long, at long, total long, n long")
    books = books.copy()
    for r in sums.groupBy("part", "entry", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
        books[r["part"], r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return books


def vector_codes(rows: DataFrame, vec_col: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code (binary, a byte a part), error of each kept row of rows (vec_id, label, vectors); the codebooks."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has one byte a part: 1 to 256 entries")
    length = usual_length(rows, vec_col, parts)
    v = F.col(vec_col)
    kept = rows.where(finite(v) & (F.size(v) == length)).select(F.struct("vec_id", "label").alias("row"), integers(v, length).alias("v"), F.lit(bytes(parts)).alias("code"))
    kept = materialize(kept, "vector-codes")
    seeds = kept.orderBy(F.col("row.vec_id").asc_nulls_last(), "v").limit(entries).collect()
    out = "row struct<vec_id:{}, label:{}>, v array<int>, code binary, error long".format(*(rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")))
    if not seeds:
        return rows.sparkSession.createDataFrame([], out).select("row.*", "code", "error"), np.zeros((parts, 0, 0), np.int64)
    books = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), parts, length // parts).swapaxes(0, 1)
    for turn in range(rounds + 1):
        kept = materialize(kept.select("row", "v", "code").mapInArrow(_assign(books, length), out), "vector-codes")
        if turn < rounds:
            books = _moved(books, kept, length)
    return kept.select("row.*", "code", "error"), books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def op11_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = vector_codes(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    summed = with_totals(coded, "label", "error", "label_error")
    return summed.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _sql_round(k: int) -> str:
    """Assignment a{k} to book b{k}; the moved book b{k+1}."""
    return f"""
a{k} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, d * 64 + e) AS e, min(d) AS d
  FROM (SELECT vec_id, p, e, list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])::BIGINT AS d FROM cut JOIN b{k} USING (p)) GROUP BY ALL),
m{k} AS (
  SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c
  FROM (SELECT p, e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM cut JOIN a{k} USING (vec_id, p), range(1, len(x) + 1) t(i) GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN m{k} USING (p, e))"""


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v
  FROM embeddings WHERE embedding IS NOT NULL AND NOT coalesce(list_bool_or([x IS NULL OR NOT isfinite(x) FOR x IN embedding]), false)),
cut AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] AS x FROM kept, range(16) t(p)),
b0 AS MATERIALIZED (SELECT p, e, x AS c FROM cut JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept) USING (vec_id) WHERE e < 64),
{_sql_round(0)},
{_sql_round(1)},
a2 AS MATERIALIZED (
  SELECT vec_id, p, arg_min(e, d * 64 + e) AS e, min(d) AS d
  FROM (SELECT vec_id, p, e, list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, len(x) + 1)])::BIGINT AS d FROM cut JOIN b2 USING (p)) GROUP BY ALL),
coded AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY vec_id),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b2)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), book
"""
