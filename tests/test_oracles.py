import pytest

from detframe.plans import catalog

from .conftest import DATA
from .helpers import assert_same


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, name):
    assert_same(catalog.QUERIES[name](spark, DATA), catalog.ORACLES[name], DATA)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_repeats(spark, name):
    q = catalog.QUERIES[name]
    first = sorted(map(str, q(spark, DATA).collect()))
    assert first and first == sorted(map(str, q(spark, DATA).collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
