"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Slot i of the schedule has the golden-ratio point frac((i + 1) * phi); the source whose stretch of the
cumulative target weights holds the point gets the slot. Within a source, slots are ranked, and slot number r
takes words [r * block, (r + 1) * block) of the source's stream: its documents in a fixed pseudo-random order
(MD5 of seed and id), laid end to end, once more when the stream is used up. The last slot of a source stops
at its target; sources for which the points gave too few slots get the missing ones at the schedule's end.

Nothing runs through one task per source: documents are summed in (source, hash range) buckets, slots in
(source, chunk) pieces, and only the small tables of bucket and chunk sums are scanned in order. `repeat` is
2: targets stop at twice the size of their source, and what they can't take is shared again by weight.

Defined results: a null or wordless text has size 0 and takes nothing; a null source is one source, last in
order; repeated rows are documents of their own; without words all targets are 0; an empty table gives none.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small, table

GOLDEN = (math.sqrt(5) - 1) / 2
WEIGHTS, SHARE, REPEAT = (3, 1, 2), 1.5, 2
#: Words of a block: such that the mix has about MIN_SLOTS slots, MAX_BLOCK at most.
MIN_SLOTS, MAX_BLOCK, CHUNK = 65_536, 4_096, 8_192
#: Sources up to which their table is broadcast.
MANY_SOURCES = 100_000


#: A word.
WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, seed: str = "mix", keep: tuple = ()) -> DataFrame:
    """doc_id, source, size, order, bucket and the columns `keep`: size in words; order shuffles a source's documents."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    order = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select(*keep, "doc_id", "source", size.alias("size"), order.alias("order")).withColumn("bucket", F.substring("order", 1, 3))


def targets(docs: DataFrame) -> DataFrame:
    """One row a source: source, no, weight, source_size, target (water-filling under the limits), quota, cumulative weights.

    The windows below run over the table of sources, never over documents.
    """
    s = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("no", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("no") % len(WEIGHTS) + 1).cast("int"))
    s = s.withColumn("weight", weight).withColumn("limit", F.col("source_size") * float(REPEAT)).withColumn("ratio", F.col("limit") / F.col("weight"))
    # In the order of limit / weight: the first k sources reach their limits, the level shared by the rest is
    # (wanted - their limits) / (weights of the rest); the right k is the first whose level is not above ratio.
    up = Window.orderBy("ratio", "no")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    after = up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    s = s.withColumn("wanted", F.sum("source_size").over(everything) * SHARE)
    s = s.withColumn("level", (F.col("wanted") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    s = s.withColumn("shared", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "no", "level"))).over(everything)["level"])
    s = s.withColumn("target", F.least(F.col("limit"), F.coalesce(F.col("shared") * F.col("weight"), F.col("limit"))))
    total = F.sum("target").over(everything)
    s = s.withColumn("quota", F.least(F.round("target").cast("long"), F.col("source_size") * REPEAT)).withColumn("total", total)
    running = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("high", F.coalesce(F.try_divide(F.sum("target").over(running), F.col("total")), F.lit(0.0))).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("no")), F.lit(0.0)))
    return s.select("source", "no", "weight", "source_size", "target", "quota", "low", "high", "total")


def schedule(sources: DataFrame, block: int, slots: int) -> DataFrame:
    """slot, no, rank, first, last: each slot takes words [first, last) of source number `no`'s repeated stream."""
    spark = sources.sparkSession
    asked = sources.where("quota > 0").select("no", "quota", "low", "high")
    ask = small(asked, MANY_SOURCES)
    points = spark.range(slots).select(F.col("id").alias("slot"), (((F.col("id") + 1) * GOLDEN) % 1.0).alias("x"), F.floor(F.col("id") / CHUNK).alias("chunk"))
    # Points and stretches meet in equal parts of [0, 1), a few for each source.
    places = max(1024, 4 * asked.count())
    place = lambda c: F.least(F.floor(c * places), F.lit(places - 1))
    covered = small(asked.withColumn("place", F.explode(F.sequence(place(F.col("low")), place(F.col("high"))))), MANY_SOURCES)
    mapped = points.withColumn("place", place(F.col("x"))).join(covered, "place").where((F.col("x") >= F.col("low")) & (F.col("x") < F.col("high"))).drop("place")
    counts = mapped.groupBy("no", "chunk").agg(F.count(F.lit(1)).alias("n"))
    so_far = Window.partitionBy("no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.withColumn("base", F.coalesce(F.sum("n").over(so_far), F.lit(0))).select("no", "chunk", "base")
    ranked = mapped.withColumn("r", F.row_number().over(Window.partitionBy("no", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(base, ["no", "chunk"]).select("slot", "no", "quota", (F.col("base") + F.col("r")).alias("rank"))
    have = counts.groupBy("no").agg(F.sum("n").alias("n"))
    late = ask.join(have, "no", "left").select("no", "quota", F.coalesce("n", F.lit(0)).alias("n"), F.ceil(F.col("quota") / block).alias("need")).where("n < need")
    late = late.select((F.lit(slots) + F.col("no")).alias("slot"), "no", "quota", F.explode(F.sequence("n", F.col("need") - 1)).alias("rank"))
    out = ranked.unionByName(late).withColumn("first", F.col("rank") * block).where("first < quota")
    return out.select("slot", "no", "rank", "first", F.least(F.col("first") + block, "quota").alias("last"))


def _laid(docs: DataFrame, seed: str, keep: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """The documents in their streams, and the parts of them that the scheduled slots take."""
    spark = docs.sparkSession
    d = materialize(sized(docs, seed, keep), "mix-sized")
    sources = materialize(targets(d), "mix-sources")
    total = sources.agg(F.max("total")).first()[0] or 0.0
    block = min(MAX_BLOCK, max(1, math.ceil(total / MIN_SLOTS)))
    slots = schedule(sources, block, math.ceil(total / block * 1.01) + 16)
    d = d.join(small(sources.select(F.col("source").alias("s"), "no", "source_size", "target"), MANY_SOURCES), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    parts = d.groupBy("no", "bucket").agg(F.sum("size").alias("n"))
    base = parts.select("no", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("no", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = d.withColumn("end", F.sum("size").over(inside)).withColumn("row", F.row_number().over(inside)).join(base, ["no", "bucket"])
    placed = materialize(placed.withColumn("start", F.col("base") + F.col("end") - F.col("size")), "mix-placed")
    rounds = F.explode(F.sequence(F.lit(0), F.lit(REPEAT - 1)))
    laps = placed.where("size > 0").select(*keep, "no", "bucket", "row", "doc_id", "source", "size", "start", "source_size", rounds.alias("lap"))
    laps = laps.withColumn("from", F.col("start") + F.col("lap") * F.col("source_size")).withColumn("to", F.col("from") + F.col("size")).drop("size", "start", "source_size")
    laps = laps.select("*", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))).alias("rank"))
    used = laps.join(slots.select("slot", "no", "rank", F.col("first").alias("low"), F.col("last").alias("high")), ["no", "rank"])
    first, last = F.greatest("from", "low") - F.col("from"), F.least("to", "high") - F.col("from")
    return placed, used.select(*keep, "slot", "no", "bucket", "row", "doc_id", "source", "lap", first.alias("first"), last.alias("last")).where("first < last")


def blocks(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The mix itself: slot, source, doc_id, lap, first, last. In the order of slot, then lap, bucket and row, each
    row takes words [first, last) of its document; bucket and row are the document's place in its source's stream."""
    return _laid(docs, seed)[1].drop("no")


def passes(docs: DataFrame, key: tuple, seed: str = "mix") -> DataFrame:
    """The columns `key`, then slot, lap, words: one row for each pass through a document; it takes the document's
    first `words` words, from that slot on. Only the last document of a source's mix is cut.

    Rows with one key (which may be equal rows) have their passes each.
    """
    names = tuple(f"__{c}" for c in key)
    used = _laid(docs.select("*", *[F.col(c).alias(n) for c, n in zip(key, names, strict=True)]), seed, names)[1]
    return used.groupBy("no", "bucket", "row", "lap", *names).agg(F.min("slot").alias("slot"), F.max("last").alias("words")).select(*[F.col(n).alias(c) for c, n in zip(key, names, strict=True)], "slot", "lap", "words")


def first_words(text, n):
    """The first n words of a text, parted by blanks."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), n), " ")


def mix(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken of every row, its source and first_slot; taken is what its parts in
    blocks add up to, first_slot the slot of its first word (null: none is taken)."""
    placed, used = _laid(docs, seed)
    used = used.groupBy("no", "bucket", "row").agg(F.sum(F.col("last") - F.col("first")).alias("taken"), F.min("slot").alias("first_slot"))
    out = placed.join(used, ["no", "bucket", "row"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", "first_slot")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: The same mix by its closed form: the slots of a source cover [0, quota) of its repeated stream without a gap.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM documents),
s0 AS (SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM d GROUP BY source),
s1 AS (SELECT *, CASE no % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS lim FROM s0),
s2 AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(lim) OVER (ORDER BY lim / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                 / sum(weight) OVER (ORDER BY lim / weight, no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s1),
s3 AS (SELECT *, (SELECT level FROM s2 WHERE level <= lim / weight ORDER BY lim / weight, no LIMIT 1) AS shared FROM s2),
s4 AS (SELECT source, no, source_size, least(lim, coalesce(shared * weight, lim)) AS target FROM s3),
s5 AS (SELECT *, sum(target) OVER (ORDER BY no ROWS UNBOUNDED PRECEDING) / nullif(sum(target) OVER (), 0) AS high FROM s4),
s AS (SELECT *, coalesce(lag(high) OVER (ORDER BY no), 0) AS low FROM s5),
k AS (SELECT CAST(least(4096, greatest(1, ceil(sum(target) / 65536))) AS BIGINT) AS block, sum(target) AS total FROM s),
pts AS (SELECT i AS slot, ((i + 1) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS x FROM (SELECT unnest(range(CAST(ceil(total / block * 1.01::DOUBLE) AS BIGINT) + 16)) AS i FROM k)),
sl AS (SELECT slot, no, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS rank FROM pts JOIN s ON x >= low AND x < high),
p AS (SELECT d.*, s.no, s.source_size, s.target, least(CAST(round(s.target) AS BIGINT), 2 * s.source_size) AS quota,
             sum(size) OVER (PARTITION BY d.source ORDER BY o, doc_id, size ROWS UNBOUNDED PRECEDING) - size AS a
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
t AS (SELECT *, CAST(greatest(0, least(a + size, quota) - a) + greatest(0, least(a + size + source_size, quota) - (a + source_size)) AS BIGINT) AS taken FROM p)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, source, taken,
       CASE WHEN taken > 0 THEN coalesce(sl.slot, CAST(ceil(total / block * 1.01::DOUBLE) AS BIGINT) + 16 + t.no) END AS first_slot
FROM t CROSS JOIN k LEFT JOIN sl ON sl.no = t.no AND sl.rank = t.a // k.block
"""
