import pytest
from oracle_compare import compare, connect

from memspark.llm.catalogue import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    compare(spark, connect(), QUERIES[name], SQL[name])
