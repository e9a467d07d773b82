"""Exact deduplication in three content-comparing stages that no hot digest can overload.

1. Local: rows of one task with equal (digest, text) are combined before anything is shuffled.
2. Salted: a digest with a large share of all rows is spread over `salts` groups by the task its rows came
   from; each group keeps one winner. Other digests need one group only.
3. Global: the at most `salts` winners of each hot digest and text are combined.

Every stage groups by the digest AND the full text, so two texts with one digest never merge. The digest
only decides placement and the way back from documents to groups; where one digest stands for several
texts (never seen with SHA-256, forced in tests) documents find their group by the text itself.

Defined results: a null text counts as empty; a null id never wins while its group has another; a repeated
(id, text) row gets the same answer each time; further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 64, hot_rows: int = 1000, max_hot: int = 1000, digest=lambda c: F.sha2(c, 256)) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_digest of every row; the largest id of equal texts stays.

    A digest is hot beyond max(hot_rows, rows / max_hot) rows, so at most `max_hot` digests are broadcast.
    """
    text: Column = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest(text).alias("digest"))
    light = materialize(keyed.select("doc_id", "digest"), "exact-light")
    counts = light.groupBy("digest").agg(F.count(F.lit(1)).alias("n_rows"))
    bound = max(hot_rows, light.count() // max_hot)
    hot = F.broadcast(materialize(counts.where(F.col("n_rows") > bound).select("digest"), "exact-hot"))

    best = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    cold = keyed.join(hot, "digest", "left_anti").groupBy("digest", "text").agg(*best)
    salted = keyed.join(hot, "digest", "left_semi").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = salted.groupBy("digest", "salt", "text").agg(*best)
    merged = salted.groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    winners = materialize(cold.unionByName(merged).select("digest", "keep_id", "group_size"), "exact-winners")

    shared = winners.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest")
    clash = not shared.isEmpty()
    plain = winners.join(shared, "digest", "left_anti") if clash else winners
    hot_winners = F.broadcast(plain.join(hot, "digest", "left_semi"))
    out = light.join(hot, "digest", "left_anti").join(plain, "digest").unionByName(light.join(hot_winners, "digest"))
    if clash:
        unclear = keyed.join(shared, "digest", "left_semi")
        out = out.unionByName(unclear.join(unclear.groupBy("digest", "text").agg(*best), ["digest", "text"]).drop("text"))
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("doc_id").isNull() & F.col("keep_id").isNull())
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "digest")


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).withColumnRenamed("digest", "text_sha256")


OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
