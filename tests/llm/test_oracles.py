"""Training-data queries that SQL can express against their SQL."""

import pytest

from noteloom.llm import queries
from tests.test_oracles import compare, tables  # noqa: F401 - a fixture


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, tables, name):  # noqa: F811
    compare(spark, tables, queries.QUERIES[name], queries.ORACLES[name])
