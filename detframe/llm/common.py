"""Shared folder, materialised tables and connected components for the training-data operators."""

from __future__ import annotations

import contextlib
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder, as in local tests.
FALLBACK_SHARED = "/tmp/checkpoints"
#: ASCII letters for lower-casing A-Z and nothing else.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local one if all run here."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or f"file://{FALLBACK_SHARED}").rstrip("/")


#: Paths of the open workspaces, the innermost last.
_OWNED: list[list[str]] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; it goes with the workspace that is open, else when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OWNED:
        _OWNED[-1].append(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


@contextlib.contextmanager
def workspace(spark: SparkSession):
    """All that is written through scratch and materialize inside goes at the end; what is returned must not read it."""
    _OWNED.append([])
    try:
        yield
    finally:
        for path in _OWNED.pop():
            remove(spark, path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of one file of a table whose number of rows is known beforehand.
FILE_ROWS = 500_000


def materialize(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Cut the lineage through a table in the shared folder; it outlives any executor.

    rows, a bound of the number of (small) rows, keeps little tables from being written as many tiny files.
    """
    path = scratch(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(1 + rows // FILE_ROWS)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most `rows` rows (counted), else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key with a HEAVY-th of all rows is heavy; so there are at most 1 / HEAVY heavy ones.
HEAVY, MANY_KEYS = 1e-3, 100_000


def with_totals(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """df with the sum of value over the rows of equal key, nulls together. df is read three times at most.

    Heavy keys (a bounded number) are broadcast; only the rows of the others are shuffled, and only if these are many.
    """
    totals = df.groupBy(F.col(key).alias("__key")).agg(F.sum(value).alias(name), F.count(F.lit(1)).alias("__n"))
    totals = materialize(totals, "totals")
    least = HEAVY * (totals.agg(F.sum("__n")).first()[0] or 0)
    heavy = F.broadcast(totals.where(F.col("__n") >= least).drop("__n"))
    light = totals.where(F.col("__n") < least).drop("__n")
    same = F.col(key).eqNullSafe(F.col("__key"))
    out = df.join(heavy, same)
    return out.drop("__key") if light.isEmpty() else out.unionByName(df.join(heavy, same, "left_anti").join(small(light, MANY_KEYS), same)).drop("__key")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most, from now on in this session.

    Spark's default of 64 MB is held about four times by each task (vectors grow by doubling, and there is a
    batch on the way in and one on the way out), outside the heap; texts and packed lists fill such batches.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c):
    """Lower-case A-Z only; texts without other letters take the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


#: A node is hot beyond HOT_ROWS links and a HOT_NODES-th of all; so there are at most HOT_NODES hot ones.
HOT_ROWS, HOT_NODES = 200, 1000


def _with_least(e: DataFrame, hot: DataFrame | None) -> DataFrame:
    """Rows (u, v) of e with m, the least v of their u. Rows of a hot u meet a broadcast table where they are."""
    least = lambda d: d.groupBy("u").agg(F.min("v").alias("m"))
    if hot is None:
        return e.join(least(e), "u")
    cold = e.join(hot, "u", "left_anti")
    return e.join(F.broadcast(least(e.join(hot, "u", "left_semi"))), "u").unionByName(cold.join(least(cold), "u"))


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node that links reach.

    Alternating large-star and small-star rounds: O(log n) rounds in practice, every round is joins and
    minimums with map-side combining, and neither a component nor a node's links are ever gathered in one task.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e, before = materialize(e, name), None
    count = e.count()
    while count:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A node has no more links after the large star than before it, so that one table serves both stars.
        hot = both.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > max(HOT_ROWS, 2 * count // HOT_NODES)).select("u")
        hot = None if hot.isEmpty() else F.broadcast(materialize(hot, name, HOT_NODES))
        # Large star: every larger neighbour of u, and u, is linked to the smallest of u and its neighbourhood.
        near = _with_least(both, hot).withColumn("m", F.least("u", "m"))
        large = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        large = materialize(large, name, 2 * count) if hot is not None else large
        # Small star: every node and its smaller neighbours are linked to the smallest of those.
        near = _with_least(large, hot)
        star = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = materialize(star, name, 2 * count)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, count = now, now[0]
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def text_pieces(batch, column: int, max_bytes: int = 1 << 20):
    """Slices of an Arrow batch with at most max_bytes of text each, but at least one row."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    col = batch.column(column)
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, done + max_bytes, side="right")))
        # A copy, so that buffers start at the slice.
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(at, to - at)]) for c in batch.columns], names=batch.schema.names)
        at = to


def utf8(column):
    """Bytes (uint8 array) and row offsets of a string column; null is empty."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    col = pc.fill_null(column.cast(pa.large_string()), "")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] and off[-1] > off[0] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def release_memory() -> None:
    """Give freed memory back to the system: workers live on, and their next task may need other sizes."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
