import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from detframe.llm.exact_dedup import OP4_SQL, exact_dedup, op4_exact_dedup

from ..conftest import DATA
from ..helpers import assert_same


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    return sorted(((i, best[t or ""], len(groups[t or ""]), i == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)


@pytest.mark.parametrize("hot_rows", [1, 3, 1000])
def test_equals_brute_force(spark, docs_of, texts, hot_rows):
    rows = [*texts, (None, "only null id"), (None, texts[0][1]), (5, texts[5][1]), *[(1000 + i, "hot") for i in range(300)]]
    got = exact_dedup(docs_of(rows).repartition(5), hot_rows=hot_rows, salts=3).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_colliding_digests_compare_texts(spark, docs_of, texts):
    rows = [*texts, (900, texts[3][1])]
    got = exact_dedup(docs_of(rows), hot_rows=40, digest=lambda c: (F.crc32(c) % 3).cast("string")).drop("digest").collect()
    assert sorted(map(tuple, got), key=str) == sorted((r[:4] for r in brute(rows)), key=str)


def test_empty(docs_of):
    assert exact_dedup(docs_of([])).count() == 0


def test_sql(spark):
    assert_same(op4_exact_dedup(spark, DATA), OP4_SQL, DATA)
