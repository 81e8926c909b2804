import pytest
from oracle_compare import compare, connect

from memspark.plans.catalogue import QUERIES, SQL


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, con, name):
    compare(spark, con, QUERIES[name], SQL[name])


def test_every_sql_has_its_query():
    assert not set(SQL) - set(QUERIES)
