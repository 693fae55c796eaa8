"""Registered queries against their SQL, on the smallest driver tables."""

from pathlib import Path

import duckdb
import pytest

from quillspark.plans import queries

SMALL = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SMALL.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in SMALL.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def shown(rows, at):
    return sorted(tuple(round(r[k], 6) if isinstance(r[k], float) else str(r[k]) for k in at) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_like_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, str(SMALL))
    want = duck.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert shown(got.collect(), columns) == shown(want.fetchall(), [want.columns.index(c) for c in columns])


@pytest.fixture(scope="module")
def ties(spark, tmp_path_factory):
    """A folder of 60 documents of six words each, other words in the same numbers of documents: to one question all score alike, summed in any order."""
    d = tmp_path_factory.mktemp("ties")
    text = lambda i: " ".join(f"{'abcdef'[n]}{(i * 7 + n) % 60 // (n + 1)}" for n in range(6))
    docs = [(i, text(i), "en", f"s{i % 3}") for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(sorted({w for _, t, *_ in docs for w in t.split()})))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


@pytest.mark.parametrize("name", ["bm25_topk", "dedupe_per_source_cap", "token_coverage"])
def test_ties_like_sql(spark, ties, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{ties}/{t}.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, ties), con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert shown(got.collect(), columns) == shown(want.fetchall(), [want.columns.index(c) for c in columns])


def odd_like_sql(spark, d, name, docs):
    """The query over these documents, asked for words that all have, equals its SQL."""
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, "red fern hill")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(d)), con.sql(queries.ORACLES[name])
    columns = sorted(got.columns)
    assert shown(got.collect(), columns) == shown(want.fetchall(), [want.columns.index(c) for c in columns])


def test_no_source_is_not_an_empty_source(spark, tmp_path):
    odd_like_sql(spark, tmp_path, "dedupe_per_source_cap", [(i, "red fern " * (i + 1) + "hill", "en", (None, "", "s")[i % 3]) for i in range(12)])


def test_null_id_is_last_of_ties(spark, tmp_path):
    odd_like_sql(spark, tmp_path, "token_coverage", [(i or None, "red fern hill" if i < 25 else "red oak", "en", "s") for i in range(30)])


@pytest.mark.parametrize("name", ["html_blocks", "html_sections", "record_merge_blocks", "record_chunks", "retrieval_answer", "draft_topk", "review_grouped"])
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, str(SMALL)).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["rule_class", "rule_method", "n", "docs"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
