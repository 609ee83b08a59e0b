import pytest
from compare import compare, duck

from siftmill.llm import queries as q

QUERIES, SQL = q.queries(), q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, small, name):
    assert compare(spark, duck(small), QUERIES[name], SQL[name], small) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() > 0
