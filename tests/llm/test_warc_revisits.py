import pytest
from pyspark.sql import functions as F

from detframe.llm.warc_revisits import OP1_SQL, _reached, as_of_points, canonical_url, op1_warc_revisits, resolve_revisits

from ..conftest import DATA
from ..helpers import assert_same

CAPTURES = "record_id long, url string, ts long, type string, status int, headers map<string,string>, digest string, key string, value string"


def test_canonical(spark):
    cases = {"http://WWW.A.org:80/x/?b=1&utm_q=2&a=3#f": "a.org/x?a=3&b=1", "https://a.org/x": "a.org/x", "a.org": "a.org", "": "", None: None, "http://a.org/?utm_source=x": "a.org"}
    d = spark.createDataFrame([(k,) for k in cases], "u string")
    assert {r.u: r.c for r in d.select("u", canonical_url(F.col("u")).alias("c")).collect()} == cases


@pytest.mark.parametrize("chunk,heavy,many", [(1, 1e-3, 1000), (7, 0.3, 1), (2, 0.3, 1), (3, 2.0, 1), (100_000, 1e-3, 1000)])
def test_as_of_equals_brute_force(spark, monkeypatch, chunk, heavy, many):
    """Also with hot keys that are broadcast, and with more of the others than may be."""
    import random

    from detframe.llm import warc_revisits

    monkeypatch.setattr(warc_revisits, "HEAVY", heavy)

    r = random.Random(1)
    bases = [(r.choice("hhhhhab"), r.randrange(60), i) for i in range(150)]
    asked = [(r.choice("hhhhhabc"), r.randrange(70)) for _ in range(150)]
    got = as_of_points(spark.createDataFrame(bases, "key string, ts long, value long"), spark.createDataFrame(asked, "key string, ts long"), chunk, many)
    want = {(k, t): max(((bt, v) for bk, bt, v in bases if bk == k and bt < t), default=(None, None))[1] for k, t in asked}
    assert {(x.key, x.ts): x.value for x in got.collect()} == want


@pytest.mark.parametrize("size", [0, 1, 2, 7, 8, 9])
def test_bisection_equals_a_count(spark, size):
    cuts = sorted(i * 3 % 10 for i in range(size))
    d = spark.createDataFrame([(t, cuts) for t in range(-1, 12)] + [(None, cuts), (3, None)], "ts long, cuts array<long>")
    got = {(r.ts, r.cuts is None): r.n for r in d.select("ts", "cuts", _reached("cuts", "ts", size + 1).alias("n")).collect()}
    assert got == {(t, False): sum(c <= t for c in cuts) for t in range(-1, 12)} | {(None, False): 0, (3, True): 0}


def test_long_urls_and_many_revisits_of_one_second(spark):
    path = "p" * 200_000
    rows = [(1, f"http://a.org/{path}", 5, "response", 200, {"etag": "1"}, "x", "k", "v")]
    rows += [(i, f"https://www.a.org/{path}/", 9, "revisit", 304, {"etag": "1"}, None, "k", "v") for i in range(10, 310)]
    got = resolve_revisits(spark.createDataFrame(rows, CAPTURES), chunk=1).collect()
    assert sorted(r.revisit_id for r in got) == list(range(10, 310)) and {(r.response_id, r.outcome, r.canonical_url) for r in got} == {(1, "resolved", f"a.org/{path}")}


def test_outcomes(spark):
    h = {"etag": '"1"', "content-type": "text/html", "last-modified": "m", "date": "d0"}
    rows = [
        (1, "http://a.org/p", 10, "response", 200, h, "x"), (2, "http://a.org/p", 20, "response", 404, h, "x"), (3, "http://a.org/p", 15, "response", 200, None, "y"),
        (10, "https://www.a.org/p#q", 12, "revisit", 304, {"etag": 'W/"1"', "date": "d1", "content-type": "bad", "vary": "v"}, None), (11, "http://a.org/p", 10, "revisit", 304, {"etag": '"1"'}, None),
        (12, "http://a.org/p", 13, "revisit", 304, {"etag": '"2"'}, "x"), (13, "http://a.org/p", 14, "revisit", 304, {"last-modified": "m"}, None), (14, "http://a.org/p", 30, "revisit", 304, None, "y"), (15, "http://a.org/p", 30, "revisit", 304, {}, None),
        (16, None, 30, "revisit", 304, h, None), (17, "http://a.org/p", None, "revisit", 304, h, None), (14, "http://a.org/p", 30, "revisit", 304, None, "y"),
    ]
    got = resolve_revisits(spark.createDataFrame([(*r, "k", "v") for r in rows], CAPTURES)).collect()
    by = {r.revisit_id: r for r in got}
    assert len(got) == 9
    assert (by[10].response_id, by[10].outcome, by[10].headers) == (1, "resolved", h | {"etag": 'W/"1"', "date": "d1", "vary": "v"})
    assert {k: by[k].outcome for k in (11, 12, 13, 14, 15, 16, 17)} == {11: "no_response", 12: "validator_mismatch", 13: "resolved", 14: "resolved", 15: "no_validator", 16: "no_response", 17: "no_response"}
    assert by[14].response_id == 3 and by[14].headers == {} and by[12].headers is None
    assert resolve_revisits(spark.createDataFrame([], CAPTURES)).count() == 0


def test_sql(spark):
    assert_same(op1_warc_revisits(spark, DATA), OP1_SQL, DATA)
