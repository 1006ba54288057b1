"""Every registered query against its SQL counterpart on the smallest tables."""

import duckdb
import pytest

import check
import __spark_entry__ as entry_points
from hoardbook.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SQL = entry_points.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for name in check.TABLES:
        connection.execute(
            f"create view {name} as select * from read_parquet('{FOLDER}/{name}.parquet')"
        )
    return connection


def test_every_query_has_a_counterpart():
    """All queries of the library itself; the training-data queries have one where SQL can say it."""
    assert set(QUERIES) <= set(SQL) <= set(entry_points.queries())


def test_entry(spark):
    result = entry_points.entry(spark)
    assert result.count() == 1500
    assert "roi_pct" in result.columns


@pytest.mark.parametrize("key", sorted(SQL))
def test_query(spark, db, key):
    result = entry_points.queries()[key](spark, FOLDER)
    got = check.rows_of(result.columns, [tuple(r) for r in result.collect()])
    plan = result._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    answer = db.execute(SQL[key])
    names = [d[0] for d in answer.description]
    assert sorted(result.columns) == sorted(names)
    assert not check.type_gaps(result, answer.description)
    assert got == check.rows_of(names, answer.fetchall())
