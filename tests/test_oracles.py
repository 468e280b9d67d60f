"""Every query of the core against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from panelforge.queries import ORACLES, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def canonical(rows):
    return sorted((tuple(None if isinstance(v, float) and v != v else round(v + 0.0, 8) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = canonical([tuple(r[c] for c in columns) for r in df.collect()])
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    assert rows == canonical([tuple(r[names.index(c)] for c in columns) for r in found.fetchall()])
