"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from rollcall.plans import all_queries, all_sql
from tests.conftest import SF
from tools.check import KINDS, TABLES, digest

# the training-data queries have tests of their own
QUERIES, SQL = all_queries(), all_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns[:2] == ["slice_dim", "slice_value"] and df.count() > 10


def test_every_sql_has_a_query():
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(SQL) <= set(QUERIES)
    assert len(QUERIES) >= 191


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    cursor = db.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    types = {d[0]: str(d[1]) for d in cursor.description}
    expected = cursor.fetchall()
    assert sorted(df.columns) == sorted(columns)
    assert {c: KINDS.get(t) for c, t in df.dtypes} == types
    ours, a = digest(df.columns, rows)
    theirs, b = digest(columns, expected)
    assert ours == theirs, (sorted(set(a) - set(b))[:3], sorted(set(b) - set(a))[:3])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
