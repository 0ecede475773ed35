"""The queries of the subpackage against their SQL on the smallest data."""

import glob
import os

import duckdb
import pytest

from logweave.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(tuple(str(r[c]) for c in columns) for r in frame.collect())
    if name in SQL:
        result = duck.sql(SQL[name])
        assert sorted(result.columns) == columns
        assert sorted(tuple(str(r[result.columns.index(c)]) for c in columns) for r in result.fetchall()) == got


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)
