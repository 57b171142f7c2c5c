"""The registered queries against their SQL in DuckDB."""

import glob
import os

import duckdb
import pytest

from cairnframe.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, spark):
    db = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        db.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = db.sql(queries.oracle_sql()[name])
    df = queries.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(want.columns)
    got = sorted((tuple(r) for r in df.select(*want.columns).collect()), key=repr)
    assert got == sorted(want.fetchall(), key=repr) and got
