"""Registered queries of the engine against their SQL on DuckDB, at the smallest scale."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from atlasframe.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    df, want = QUERIES[name](spark, SF), db.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in order) for r in want.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_customer_is_a_probe(spark, db):
    n = db.sql("select count(*) from customer").fetchall()[0][0]
    assert QUERIES["batch_lookup_join"](spark, SF).select("id").distinct().count() == n
    assert QUERIES["probe_hit_count"](spark, SF).first()["probes"] == n
    assert QUERIES["batch_prefix_join"](spark, SF).select("geohash").distinct().count() == n
    found = QUERIES["locate_points"](spark, SF).collect()
    assert len(found) == 2 * n and sum(r["geohash"] is not None for r in found) >= n
    assert any(r["geohash"] is None for r in found)
    invented = QUERIES["invented_key_probes"](spark, SF).collect()
    assert len(invented) == 2 * n and all(r["city_name"] for r in invented if r["id"] < 0) and any(r["city_name"] is None for r in invented)


def test_point_lookup_reaches_the_scan(spark):
    plan = QUERIES["point_lookup"](spark, SF)._jdf.queryExecution().toString()
    assert "EqualTo(geohash," in plan and "ReadSchema: struct<geohash:string,city_name:string,country_id:" in plan
