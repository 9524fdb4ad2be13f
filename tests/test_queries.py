"""Every query against the same result in SQL; queries without SQL must run and have rows."""

from __future__ import annotations

import pytest
from compare import connect, spark_rows, sql_rows

from emberlog.plans.catalog import load

QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, data, con, name):
    df = QUERIES[name](spark, data)
    names, expected = sql_rows(con, SQL[name])
    assert sorted(df.columns) == names
    assert spark_rows(df) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
