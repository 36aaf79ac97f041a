"""Every query with SQL against DuckDB on the sample tables."""

import glob
import os

import duckdb
import pytest

from loomgraph.plans import catalog

TABLES = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the sample tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    frame = catalog.queries()[name](spark, TABLES)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in frame.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    answer = duck.sql(sql)
    assert sorted(answer.columns) == columns
    at = [answer.columns.index(c) for c in columns]
    assert got == sorted(repr(tuple(row[i] for i in at)) for row in answer.fetchall())


def test_all_rules_are_written_back_without_a_cap(spark):
    found = {r.rule for r in catalog.queries()["grf_17_all"](spark, TABLES).collect()}
    assert found >= {"R7", "R9", "D1", "D6"}, found
    for name in ("grf_17", "grf_17_all"):
        assert "Limit 1000000" not in catalog.queries()[name](spark, TABLES)._jdf.queryExecution().logical().toString()
