import numpy as np
import pytest

from detframe.llm import hard_negatives as module
from detframe.llm.hard_negatives import OP13_SQL, hard_negatives, op13_hard_negatives, products

from ..conftest import DATA
from ..helpers import assert_same

ROWS = "vec_id long, label int, embedding array<double>, row string, at int, anchor string, block int, v string"
ANCHOR = "vec_id % 5 = 0"


def frame(spark, rows):
    return spark.createDataFrame([(i, label, v, "x", 1, "y", 2, "z") for i, label, v in rows], ROWS)


def loop(rows, positives=5, negatives=3, low=50, high=95):
    """By plain loops over all pairs of rows, of which each is one by its place."""
    ints = [(i, y, [int(np.floor(x * 256)) for x in v]) for i, y, v in rows]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for k, (i, y, v) in enumerate(ints):
        if i % 5:
            continue
        others = sorted((-dot(v, w), j, z) for m, (j, z, w) in enumerate(ints) if m != k)
        for p, j, _ in [o for o in others if o[2] == y][:positives]:
            fits = [o for o in others if o[2] != y and low * -p <= 100 * -o[0] <= high * -p][:negatives]
            out += [(i, j, r + 1, n, -p, -s) for r, (s, n, _) in enumerate(fits)]
    return sorted(out)


def mined(df, **more):
    return sorted(map(tuple, hard_negatives(df, ANCHOR, **more).collect()))


def test_query_equals_sql(spark):
    assert_same(op13_hard_negatives(spark, DATA), OP13_SQL, DATA)


@pytest.mark.parametrize("block,tile,parts", [(8192, 4096, 1), (7, 5, 6), (1, 1, 2)])
def test_equals_a_loop_with_ties_in_any_blocks(spark, monkeypatch, block, tile, parts):
    monkeypatch.setattr(module, "TILE_ROWS", tile)
    monkeypatch.setattr(module, "TILE_ANCHORS", tile)
    r = np.random.default_rng(5)
    rows = [(i, int(r.integers(0, 3)), (r.integers(-1, 3, 4) / 256).tolist()) for i in range(40 if block == 1 else 120)]
    assert mined(frame(spark, rows).repartition(parts), block=block) == loop(rows)
    assert mined(frame(spark, rows).repartition(parts), block=block, positives=2, negatives=9, low=0, high=100) == loop(rows, 2, 9, 0, 100)


def test_repeated_rows_and_ids_are_rows_of_their_own(spark):
    rows = [(0, 1, [0.5, 0.5])] * 3 + [(0, 2, [0.4, 0.4])] * 2 + [(5, 2, [0.25, 0.5]), (6, 1, [0.3, 0.3]), (7, 2, [0.31, 0.3])]
    assert mined(frame(spark, rows)) == loop(rows) and len(loop(rows)) > 5


def test_hot_label_and_more_tasks_than_rows(spark):
    rows = [(i, 0 if i % 3 else i % 7, [i % 11 / 256, 3 / 256, -(i % 5) / 256]) for i in range(150)]
    assert mined(frame(spark, rows).repartition(13), block=9) == loop(rows)


def test_products_are_exact_beyond_float64():
    a, b = np.array([[2**26 - 1, 2**26 - 1, 1]]), np.array([[2**26 - 1, 2**26 - 3, 1]])
    assert products(a, b)[0, 0] == (2**26 - 1) ** 2 + (2**26 - 1) * (2**26 - 3) + 1
    assert products(a >> 10, b).dtype == np.float64
    big = np.array([[2**28 - 1, 1]])
    assert products(big, big)[0, 0] == (2**28 - 1) ** 2 + 1


def test_large_components_give_whole_scores(spark):
    rows = [(0, 1, [2.0**19, 1 / 256]), (1, 1, [2.0**19 - 1 / 256, 0.0]), (2, 2, [2.0**18 + 1 / 256, 1 / 256]), (3, 2, [2.0**18 + 1 / 256, 0.0])]
    assert mined(frame(spark, rows)) == loop(rows) and len(loop(rows)) == 2


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, 1, [0.5, 0.5]), (1, 1, [0.5, 0.4]), (2, 2, [0.3, 0.3])]
    bad = [(None, 1, [0.5, 0.5]), (5, None, [0.5, 0.5]), (10, 1, None), (15, 1, [nan, 0.5]), (20, 1, [0.5, inf]), (25, 2, [0.3, None]), (30, 2, [0.3]), (35, 1, [])]
    assert mined(frame(spark, rows + bad)) == loop(rows) == [(0, 1, 1, 2, 128 * 128 + 128 * 102, 2 * 128 * 76)]
    assert mined(frame(spark, [])) == mined(frame(spark, bad)) == mined(frame(spark, rows[1:])) == []
    # No other label, or no other row of the label: no rows. Negative scores leave an empty window.
    assert mined(frame(spark, [rows[0], rows[1]])) == mined(frame(spark, [rows[0], rows[2]])) == []
    assert mined(frame(spark, [(0, 1, [0.5]), (1, 1, [-0.5]), (2, 2, [-0.3])])) == []
