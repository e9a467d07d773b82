from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from detframe.llm.jaccard_join import Hasher, Region, _split_large, jaccard_components, pack, unpack


def shingles(t, k=4):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, percent=85):
    s = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                up[top(i)] = top(j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[top(i)].append(d)
    return sorted(((d, len(s[i]), min((x for x in low[top(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows)), key=str)


def got(d, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(d, **kw).collect()), key=str)


def test_equals_brute_force(docs_of, texts):
    rows = [*texts, (None, texts[0][1]), (None, "lonely null"), (7, texts[7][1])]
    assert got(docs_of(rows).repartition(5)) == brute(rows)


def groups(kind, n, r):
    """Texts in one region: copies with changes, unrelated texts on common boilerplate, texts of a few common words."""
    base = [f"w{i}" for i in range(120)]
    if kind == "copies":
        out = [list(base) for _ in range(n)]
        for w in out:
            for _ in range(r.choice([0, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    elif kind == "boilerplate":
        out = [base[:40] + [f"x{r.randrange(10**6)}" for _ in range(r.choice([0, 1, 3, 4, 5, 60]))] for _ in range(n)]
    elif kind == "clusters":
        centres = [base[:30] + [f"c{c}_{i}" for i in range(60)] for c in range(n // 12)]
        out = [list(r.choice(centres)) for _ in range(n)]
        for w in out:
            for _ in range(r.choice([0, 1, 2, 9])):
                w[r.randrange(len(w))] = r.choice(base)
    else:
        out = [[r.choice("ab") for _ in range(r.choice([6, 7, 8, 30]))] for _ in range(n)]
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("kind", ["copies", "boilerplate", "clusters", "few words"])
def test_large_regions_are_split_exactly(docs_of, kind):
    import random

    rows = groups(kind, 150, random.Random(6))
    want = brute(rows)
    assert 1 < len({c for _, _, c in want}) < 150
    assert got(docs_of(rows), region_sets=16) == want


@pytest.mark.parametrize("kind", ["unrelated", "cluster", "boilerplate"])
def test_split_rows_grow_in_proportion(spark, kind):
    rng = np.random.default_rng(5)
    common = list(range(1, 81))

    def rows(n):
        out = []
        for i in range(n):
            own = [10**6 + 200 * i + j for j in range(20)]
            if kind == "unrelated":
                tokens, size = [*own[:15], 1], 16
            elif kind == "cluster":
                lost = set(rng.choice(80, int(rng.integers(0, 5)), replace=False).tolist())
                tokens = [t for j, t in enumerate(common) if j not in lost]
                size = len(tokens) + int(rng.integers(0, 4))
            else:
                tokens, size = common, 90
            take = size + 85 * size // -100 + 1 - (size - len(tokens))
            out.append(("r", i, size, tokens, max(1, take)))
        return spark.createDataFrame(out, "region string, sid long, n long, tokens array<long>, take int")

    few, many = (_split_large(rows(n), 85, 32, 10**6)[0].count() for n in (512, 1024))
    assert many <= 2.5 * max(few, 512)


def test_long_words_do_not_collide(docs_of):
    rows = []
    for k in (10, 11, 13):
        w = "a"
        for _ in range(k):
            w += w.translate(str.maketrans("ab", "ba"))
        rows += [(len(rows), w), (len(rows) + 1, w.translate(str.maketrans("ab", "ba"))), (len(rows) + 2, w + "a"), (len(rows) + 3, w[:-1])]
    rows += [(50, "x" * 8), (51, "x" * 8 + chr(0)), (52, "x" * 16), (53, "x" * 17), (54, "X" * 17), (55, "x" * 64), (56, "x" * 65), (57, "x" * 64 + "y")]
    assert [(d, c) for d, _, c in got(docs_of(rows))] == [(d, 53 if d == 54 else d) for d, _ in sorted(rows, key=lambda x: str((x[0], 1, x[0])))]


def test_region_join_equals_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.choice(10**6, 60, replace=False)
    sets = []
    for i in range(400):
        s = set(base if i % 4 else rng.choice(base, 40, replace=False))
        for _ in range(rng.integers(0, 9)):
            s.discard(rng.choice(base))
            s.add(int(rng.integers(10**6, 10**7)))
        sets.append(s)
    region = Region(np.array([len(s) for s in sets]), [np.array(sorted(s)) for s in sets], 85)
    region.join(np.arange(len(sets)))
    up = list(range(len(sets)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    assert [top(i) for i in range(len(sets))] == region.label.tolist()


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    names, sizes = rng.integers(0, 2**64, (5, 2), dtype=np.uint64), np.arange(5)
    index, tokens, freq = rng.integers(0, 5, 99), rng.integers(0, 2**64, 99, dtype=np.uint64), rng.integers(0, 2**32, 99, dtype=np.uint32)
    n, s, i, t, f = unpack(pack(names, sizes, index, tokens, freq))
    assert np.array_equal(n, names) and s.tolist() == sizes.tolist()
    assert sorted(zip(t.tolist(), i.tolist(), f.tolist())) == sorted(zip(tokens.tolist(), index.tolist(), freq.tolist()))


def test_hashes_depend_on_words_only():
    a, b, c, d = Hasher().sets(pa.array(["A b  c\nd e", "x a B c d E", "a b", None]), 4)
    assert len(a) == 2 and len(b) == 3 and set(a) < set(b) and len(c) == 1 and len(d) == 0


def test_empty(docs_of):
    assert got(docs_of([])) == [] and got(docs_of([(1, ""), (2, None)])) == [(1, 0, 1), (2, 0, 2)]
