"""Every query with SQL against DuckDB, the others for rows and a stable schema."""

import pytest

from seqloom.plans.all import QUERIES, SQL
from tests.oracle import connect, of_spark, of_sql


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, sf, con, name):
    assert of_spark(QUERIES[name](spark, sf)) == of_sql(con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows_only(spark, sf, name):
    df = QUERIES[name](spark, sf)
    first = df.collect()
    assert df.columns and (first or name == "s8_gradable")  # no session of the smallest tables has twenty frames in a capture
    assert sorted(map(str, first)) == sorted(map(str, QUERIES[name](spark, sf).collect()))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
