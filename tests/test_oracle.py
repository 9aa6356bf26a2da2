"""Every registered query against its DuckDB text."""

import oracle
import pytest

from quantloom.plans import registry

CON = None


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, name):
    global CON
    CON = CON or oracle.connect()
    assert oracle.differences(spark, registry.QUERIES[name], registry.ORACLE[name], con=CON) == ""
