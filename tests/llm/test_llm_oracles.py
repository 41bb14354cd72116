"""Training-data queries with SQL agree with DuckDB on the smallest data."""

import pytest
from compare import connect, difference

from srcgraph.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_agrees_with_sql(spark, name):
    assert difference(spark, connect(FOLDER), FOLDER, queries.QUERIES[name], queries.ORACLES[name]) is None
