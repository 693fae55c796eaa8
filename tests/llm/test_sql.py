"""Corpus queries whose whole result SQL can express, on the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

from quillspark.llm import queries

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="driver tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_like_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SMALL}/documents.parquet'")
    want, got = con.sql(queries.ORACLES[name]), queries.QUERIES[name](spark, str(SMALL))
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == sorted(tuple(r[k] for k in at) for r in want.fetchall())
