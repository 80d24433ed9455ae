"""The registered queries against their SQL on DuckDB, at the smallest scale."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from atlasframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert Counter(tuple(r[c] for c in columns) for r in df.collect()) == Counter(tuple(r[i] for i in order) for r in want.fetchall())
