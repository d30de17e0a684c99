import pytest

from leadloom.llm.registry import QUERIES, SQL

from ..oracle import compare


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    compare(spark, QUERIES[name], SQL[name])
