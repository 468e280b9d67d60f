"""Corpus queries that SQL can state, against DuckDB."""

import glob
import os

import duckdb
import pytest

from panelforge.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    found = c.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(k)] for k in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[k] for k in columns) for r in df.collect()), key=repr) == want
