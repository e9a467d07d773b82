
import pytest

from detframe.llm import mixing
from detframe.llm.mixing import OP10_SQL, mix, op10_mixing

from ..conftest import DATA
from ..helpers import assert_same


def targets_loop(sizes):
    """Shares by weight; what is above twice the size is shared again until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, out, open_ = 1.5 * sum(sizes.values()), {}, set(names)
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full


def test_targets_and_takes(spark, docs_of):
    import random

    r = random.Random(2)
    rows, d = [], None
    for s, n in (("b", 40), ("a", 2), (None, 9), ("é", 1), ("z", 300)):
        part = [(len(rows) + i, "w " * r.choice([0, 1, 3, 10, 400])) for i in range(n)]
        rows += [(i, t, s) for i, t in part]
        one = docs_of(part, source=s)
        d = one if d is None else d.unionByName(one)
    d = d.unionByName(docs_of([(7000, None)], source="z")).repartition(4)
    got = mix(d).collect()
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in {x for _, _, x in rows}}
    want = targets_loop(sizes)
    for s, t in want.items():
        own = [x for x in got if x.source == s]
        assert all(x.target == pytest.approx(t) and x.source_size == sizes[s] for x in own)
        assert abs(sum(x.taken for x in own) - t) <= 1
    assert all(0 <= x.taken <= 2 * x.size for x in got) and len(got) == len(rows) + 1
    assert sorted(map(str, got)) == sorted(map(str, mix(d.repartition(3)).collect()))


def test_schedule_is_low_discrepancy(spark, docs_of):
    d = docs_of([(i, "w " * 50) for i in range(100)], source="a").unionByName(docs_of([(i, "w " * 50) for i in range(100, 400)], source="b"))
    sources = mixing.targets(mixing.sized(d))
    slots = mixing.schedule(sources, 100, 300)
    quota = {r.no: r.quota for r in sources.collect()}
    rows = sorted((r.slot, r.no) for r in slots.collect())
    share = {n: quota[n] / sum(quota.values()) for n in quota}
    for upto in (50, 150, 225):
        for n in quota:
            assert abs(sum(x == n for _, x in rows[:upto]) - share[n] * upto) <= 4
    covered = {n: sorted((r["first"], r["last"]) for r in slots.where(slots.no == n).collect()) for n in quota}
    assert all(c[0][0] == 0 and c[-1][1] == quota[n] and all(a[1] == b[0] for a, b in zip(c, c[1:])) for n, c in covered.items())


def test_empty_and_wordless(docs_of):
    assert mix(docs_of([])).count() == 0
    assert [(r.size, r.target, r.taken) for r in mix(docs_of([(1, " "), (2, None)])).collect()] == [(0, 0.0, 0)] * 2


def test_sql(spark):
    assert_same(op10_mixing(spark, DATA), OP10_SQL, DATA)


def test_blocks_follow_the_schedule(docs_of):
    d = docs_of([(i, "w " * (1 + i % 7)) for i in range(60)], source="a").unionByName(docs_of([(i, "w " * 5) for i in range(100, 160)], source="b"))
    parts = sorted(mixing.blocks(d).collect(), key=lambda r: (r.slot, r.lap, r.bucket, r.row))
    total = {}
    for r in parts:
        total[r.doc_id] = total.get(r.doc_id, 0) + r["last"] - r["first"]
    assert total == {r.doc_id: r.taken for r in mix(d).collect() if r.taken}
    # One source a slot, and every prefix of the sequence holds the sources in their shares.
    sources = {r.slot: r.source for r in parts}
    assert all(sources[r.slot] == r.source for r in parts)
    words = [r.source for r in parts for _ in range(r["last"] - r["first"])]
    share = words.count("a") / len(words)
    assert all(abs(words[:n].count("a") - share * n) <= 6 for n in range(0, len(words), 20))
    # Within a source, the sequence runs through whole documents: each part goes on where the last one stopped.
    for doc in total:
        for lap in (0, 1):
            own = [(r["first"], r["last"]) for r in parts if r.doc_id == doc and r.lap == lap]
            assert not own or own[0][0] == 0 and all(x[1] == y[0] for x, y in zip(own, own[1:]))


def test_many_sources(spark):
    from pyspark.sql import functions as F

    n = 200_000
    sources = spark.range(n).select(F.col("id").alias("no"), F.lit(3).cast("long").alias("quota"), (F.col("id") / n).alias("low"), ((F.col("id") + 1) / n).alias("high"))
    slots = mixing.schedule(sources, 1, 3 * n)
    assert "NestedLoop" not in slots._jdf.queryExecution().toString() and "Cartesian" not in slots._jdf.queryExecution().toString()
    got = slots.groupBy("no").agg(F.count(F.lit(1)).alias("c"), F.max("last").alias("l")).groupBy("c", "l").count().collect()
    assert [tuple(r) for r in got] == [(3, 3, n)]


def test_passes_add_up(docs_of):
    from pyspark.sql import functions as F

    d = docs_of([(i, "w " * (1 + i % 7)) for i in range(60)], source="a").unionByName(docs_of([(i, "w " * 5) for i in range(40, 160)], source="b"))
    d = d.withColumn("row", F.concat_ws(":", "source", F.col("doc_id").cast("string")))
    words = {r.row: 0 for r in d.collect()}
    for r in mixing.passes(d, ("row",)).collect():
        words[r.row] += r.words
    taken = {f"{r.source}:{r.doc_id}": r.taken for r in mix(d).collect()}
    assert words == taken and sum(taken.values()) > 0
