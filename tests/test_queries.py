"""Every registered query over facts against the same in DuckDB's SQL."""

import datetime
import decimal
import os

import duckdb
import pytest

from factloom import queries as Q

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents labels".split():
        c.sql(f"create view {name} as select * from '{DIR}/{name}.parquet'")
    return c


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_query_equals_sql(spark, con, name):
    df = Q.QUERIES[name](spark, DIR)
    names = sorted(df.columns)
    got = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    want = con.sql(Q.ORACLE_SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(n) for n in names]
    assert got == sorted(repr([plain(row[i]) for i in at]) for row in want.fetchall())


def test_constants_prune_the_tables_that_a_query_does_not_name(spark):
    plan = Q.scan_p(spark, DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 1 and "Union" not in plan


def test_constants_reach_the_scan(spark):
    plan = Q.scan_po(spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "p_size" in plan


def test_insert_into_an_empty_graph(spark, tmp_path):
    for name in ("nation", "region"):
        spark.read.parquet(f"{DIR}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert [tuple(r) for r in Q.QUERIES["insert_data"](spark, str(tmp_path)).collect()] == [("new", "in_region")]
