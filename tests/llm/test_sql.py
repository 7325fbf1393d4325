"""The corpus queries that have SQL against DuckDB on the whole given tables."""

import pytest

from seqloom.llm.registry import QUERIES, SQL
from tests.oracle import connect, of_spark, of_sql


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, name):
    assert of_spark(QUERIES[name](spark, sf)) == of_sql(connect(sf), SQL[name])
