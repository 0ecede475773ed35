"""Every query with SQL against DuckDB on the smallest data."""

import glob
import math
import os
from datetime import datetime

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(round(x, 9))
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    return str(x)


#: Queries of the core; those of the optional subpackage are tested beside it.
CORE = {name: query for module in entry.CORE for name, query in module.QUERIES.items()}


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    frame = CORE[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(tuple(cell(r[c]) for c in columns) for r in frame.collect())
    sql = entry.oracle_sql().get(name)
    if sql is not None:
        result = duck.sql(sql)
        assert sorted(result.columns) == columns
        assert sorted(tuple(cell(r[result.columns.index(c)]) for c in columns) for r in result.fetchall()) == got


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
