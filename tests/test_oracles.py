import pytest

from oracle import assert_same, connect
from strandworks import registry

QUERIES = registry.queries()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    df = QUERIES[name](spark, small)
    sql = registry.oracle_sql().get(name)
    if sql:
        assert_same(df, connect(small), sql)
    else:
        assert df.columns and df.count() > 0


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(QUERIES)
