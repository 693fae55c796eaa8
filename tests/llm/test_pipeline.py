"""The pipeline: columns between stages, and each stage's decisions."""

import pyarrow as pa
import pytest

import corpus_pipeline as cp
from quillspark.llm import pii


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, tables)
        assert out.columns == columns, name
        docs = cp.materialize(out, "test")
        rows = docs.collect()
        if name == "language_id":
            assert all(r["text"] and any(c.isalpha() for c in r["text"]) for r in rows)
        if name == "ngram_jaccard_join":
            ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
            assert len(ids) == len(set(ids)) and 120 in ids and 3 in ids and 155 not in ids
            assert sum(120 <= i < 150 for i in ids) < 20
        if name == "pii":
            masked = {r["doc_id"]: r["text"] for r in rows}
            assert not any(pii.base_spans(t) for t in masked.values())
            assert masked[1] == before[1] and "[EMAIL]" in masked[158]
    pieces = cp.STAGES[-1][1](spark, docs, tables).collect()
    assert pieces and all(p["offset"] + p["length"] <= 4096 for p in pieces)


def test_near_copies_like_brute_force(spark, edge, edge_rows):
    low = {c: c + 32 for c in range(65, 91)}
    sets = {}
    for i, t, *_ in edge_rows:
        if i is not None:
            w = (t or "").translate(low).replace("\x1c", "?").split()
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    comp = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low_, high = sorted((comp[a], comp[b]))
                comp = {i: low_ if c == high else c for i, c in comp.items()}
    got = [r["doc_id"] for r in cp.near_copies(spark, edge, "").collect() if r["doc_id"] is not None]
    assert sorted(got) == sorted(set(comp.values()))


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_batches_are_small_however_documents_were_read(spark, empty, name):
    """Stages called by themselves, with documents that spark.read gave, had batches of 10,000 whole texts."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["n", "bytes"])

    keys = [f"spark.sql.execution.arrow.max{k}PerBatch" for k in ("Records", "Bytes")]
    before = [spark.conf.get(k) for k in keys]
    for k in keys:
        spark.conf.unset(k)
    try:
        dict(cp.STAGES)[name](spark, empty, "")
        short, long = (spark.range(0, n, 1, 1).selectExpr("id", f"repeat('x', {size}) text").mapInArrow(sizes, "n long, bytes long").collect() for n, size in ((6000, 10), (6000, 2000)))
        assert max(r["n"] for r in short) <= 2048 and sum(r["n"] for r in short) == 6000
        assert max(r["bytes"] for r in long) <= 1 << 20 and sum(r["n"] for r in long) == 6000
    finally:
        for k, v in zip(keys, before, strict=True):
            spark.conf.set(k, v)


def test_empty(spark, empty_tables):
    assert cp.run(spark, empty_tables).count() == 0


def test_names():
    assert [n for n, _ in cp.STAGES] == ["language_id", "ngram_jaccard_join", "pii", "source_mixing", "best_fit_packing"]
