"""Every query with SQL gives the rows that DuckDB gives for it."""

import glob
import os

import duckdb
import pytest

from tessera.plans import catalogue

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def base():
    con = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_like_sql(spark, base, name):
    got = catalogue.queries()[name](spark, DIR)
    sql = catalogue.oracle_sql()[name]
    want = base.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(want, key=key)
    assert want
