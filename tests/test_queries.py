"""Every catalogued query gives the rows of its SQL."""

import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from sparktn.plans.queries import CATALOGUE

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", [name for name, (_, sql) in CATALOGUE.items() if sql])
def test_rows(spark, db, name):
    query, sql = CATALOGUE[name]
    df = query(spark, DATA)
    want = db.sql(sql)
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted((tuple(r[k] for k in order) for r in want.fetchall()), key=key)
