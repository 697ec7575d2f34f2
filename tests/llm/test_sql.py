"""The queries that SQL can express, against DuckDB on whole tables."""

import glob
import os

import duckdb
import pytest

from chronoweave.llm import queries

DATA = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())
