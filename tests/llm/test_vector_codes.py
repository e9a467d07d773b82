import hashlib

import numpy as np
import pytest

from detframe.llm.vector_codes import OP11_SQL, nearest, op11_vector_codes, vector_codes
from detframe.llm.vectors import limit

from ..conftest import DATA
from ..helpers import assert_same

ROWS = "vec_id long, label int, embedding array<float>, code string, row int, error string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(i, label, v, "x", 1, "y", 2) for i, label, v in rows], ROWS)


def loop(vectors, parts, entries, rounds):
    """Codes, errors and books by comparing all entries in Python integers."""
    w = len(vectors[0]) // parts
    cut = [[v[p * w : p * w + w] for p in range(parts)] for v in vectors]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]
    dist = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y, strict=True))
    assign = lambda: [[min(range(len(b)), key=lambda e: (dist(c[p], b[e]), e)) for p, b in enumerate(books)] for c in cut]
    for _ in range(rounds):
        codes = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, k in zip(cut, codes, strict=True) if k[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    codes = assign()
    return codes, [sum(dist(c[p], books[p][k[p]]) for p in range(parts)) for c, k in zip(cut, codes, strict=True)], books


def test_query_equals_sql(spark):
    assert_same(op11_vector_codes(spark, DATA), OP11_SQL, DATA)


@pytest.mark.parametrize("spread", [2, 30, 10**6])
def test_search_equals_all_distances_with_ties(spread):
    r = np.random.default_rng(spread)
    book = r.integers(-spread, spread + 1, (64, 4))
    book[40:50] = book[:10]  # equal entries: the lower index wins
    x = np.vstack([r.integers(-spread, spread + 1, (500, 4)), book])
    for start in (np.zeros(len(x), np.int64), r.integers(0, 64, len(x))):
        best, dist = nearest(x, start, book)
        every = ((x[:, None] - book) ** 2).sum(axis=2)
        assert (best == every.argmin(axis=1)).all() and (dist == every.min(axis=1)).all()


def test_search_scans_few_entries_from_a_good_start():
    r = np.random.default_rng(0)
    book = r.integers(-1000, 1000, (64, 4))
    x = book + r.integers(-5, 6, book.shape)
    compared = lambda start: sum(int((((book[a] - book) ** 2).sum(axis=1) <= 4 * ((v - book[a]) ** 2).sum()).sum()) for v, a in zip(x, start, strict=True))
    assert compared(np.arange(64)) < 2 * 64 < compared(np.zeros(64, np.int64))


def test_equals_a_loop_with_ties_and_repeated_rows(spark):
    r = np.random.default_rng(3)
    vectors = r.integers(-3, 4, (150, 8)).astype(float) / 256 * 3
    vectors[20:60] = vectors[19]
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(vectors)]
    got, books = vector_codes(frame(spark, rows).repartition(5), parts=4, entries=16, rounds=3)
    codes, errors, expected = loop(np.floor(vectors.astype(np.float32).astype(float) * 256).astype(int).tolist(), 4, 16, 3)
    assert books.tolist() == expected
    assert {x.vec_id: (list(x.code), x.error) for x in got.collect()} == {i: (c, e) for i, (c, e) in enumerate(zip(codes, errors, strict=True))}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(90, 1, None), (91, 1, [1.0, None, 0.0, 0.0]), (92, 1, [nan] * 4), (93, 1, [inf, 0.0, 0.0, 0.0]), (94, 1, [1.0, 2.0]), (95, 1, [])]
    good = [(None, None, [-0.001, 0.5, 0.5, 0.5]), (7, None, [0.001, 0.5, 0.5, 0.5]), (7, 2, [0.001, 0.5, 0.5, 0.5]), (1, 2, [3e38, 0.0, 0.0, -3e38])]
    got, books = vector_codes(frame(spark, bad + good), parts=2, entries=64)
    rows = got.collect()
    assert sorted((r.vec_id is None, r.vec_id or 0, r.label or 0) for r in rows) == [(False, 1, 2), (False, 7, 0), (False, 7, 2), (True, 0, 0)]
    assert books.shape == (2, 4, 2) and books.max() == limit(4) and all(r.error == 0 for r in rows)
    assert {r.code for r in rows if r.vec_id == 7} == {rows[[x.vec_id for x in rows].index(7)].code}
    assert vector_codes(frame(spark, []))[0].count() == vector_codes(frame(spark, bad[:4]))[0].count() == 0
    with pytest.raises(ValueError):
        vector_codes(frame(spark, good), entries=257)


def test_label_sums_take_the_same_value_by_any_join(spark, monkeypatch):
    from detframe.llm import common

    rows = [(i, None if i % 3 else i, i) for i in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, label int, error long")
    expected = {i: (sum(e for _, y, e in rows if y == x)) for i, x, _ in rows}
    for heavy, many in ((1e-3, 100), (0.1, 100), (0.1, 1)):
        monkeypatch.setattr(common, "HEAVY", heavy)
        monkeypatch.setattr(common, "MANY_KEYS", many)
        out = common.with_totals(df, "label", "error", "label_error").collect()
        assert len(out) == 90 and {r.vec_id: r.label_error for r in out} == expected


def test_digest_is_of_the_decimal_components():
    from detframe.llm.vector_codes import books_digest

    assert books_digest(np.array([[[1, -2]], [[3, 4]]])) == hashlib.sha256(b"1,-2,3,4").hexdigest()
