import pytest

from tarn.plans import queries as q
from tests.oracle import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf, con, name):
    compare(q.QUERIES[name](spark, sf), con, q.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert q.QUERIES[name](spark, sf).count() > 0


def test_entry_and_registry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["route", "action", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
