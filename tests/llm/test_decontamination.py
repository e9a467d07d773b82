import hashlib
import re

from detframe.llm.decontamination import OP9_SQL, decontaminate, op9_decontamination

from ..conftest import DATA
from ..helpers import assert_same


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, window=10):
    out = []
    wins = {(i, tuple(w[k : k + min(window, len(w))])) for i, t in items for w in [words(t)] if w for k in range(len(w) - min(window, len(w)) + 1)}
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(str(i))
        names = sorted(found)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "The quick brown fox jumps over the lazy dog and then it rests a while"), (2, "Alpha beta"), (3, "solo"), (10, "Über ÉCOLE three"), (4, None), (5, " .. "), (6, "x y x y x y x y x y x y x y"), (1, "another item of number one")]


def bench(spark, items=ITEMS):
    return spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark, docs_of):
    long = ITEMS[0][1]
    docs = [(1, "say: " + long.upper() + "!"), (2, long.replace("fox", "cat")), (3, "alpha-BETA gamma alpha beta"), (4, None), (5, ""), (6, "Über École three; über école"), (7, "ÜBER école three solo"), (8, "x y " * 30), (9, "y x y x y x y x y"), (9, "solo"), (9, "solo"), (None, "alpha beta"), (11, "... !!"), (12, "word " * 5000 + long), (13, " ".join(long.split()[2:13])), (14, " ".join(long.split()[:9]))]
    assert sorted(map(tuple, decontaminate(docs_of(docs), bench(spark)).collect()), key=str) == brute(docs, ITEMS)
    assert sorted(map(tuple, decontaminate(docs_of(docs), bench(spark, ITEMS[:1])).collect()), key=str) == brute(docs, ITEMS[:1])


def test_empty(spark, docs_of):
    assert decontaminate(docs_of([]), bench(spark)).count() == 0
    assert [r.n_words for r in decontaminate(docs_of([(1, "a b")]), bench(spark, [])).collect()] == [2]


def test_sql(spark):
    assert_same(op9_decontamination(spark, DATA), OP9_SQL, DATA)


def test_sql_without_broadcasts(spark, monkeypatch):
    from detframe.llm import decontamination

    monkeypatch.setattr(decontamination, "BROADCAST_TOKENS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert_same(decontamination.op9_decontamination(spark, DATA), decontamination.OP9_SQL, DATA)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
