"""The training-data queries that SQL can express against DuckDB."""

import oracle
import pytest

from quantloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    assert oracle.differences(spark, queries.QUERIES[name], queries.ORACLE[name]) == ""
