"""Operators do the whole job: nothing is lost where tables of bounded size end."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa

from quillspark.llm import fingerprint, jaccard, lm, phrases
from quillspark.llm.words import buffers


def test_op7_keeps_every_pair(spark, edge, edge_rows):
    """Scores are those of the complete trie, whatever the workers are sent."""
    texts = [r[1] or "" for r in edge_rows]
    held = [r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in edge_rows]
    b, at, _ = lm.padded(*buffers(pa.array([t for t, h in zip(texts, held, strict=True) if not h], pa.large_string())))
    key, n = np.unique(lm.grams(b)[at - lm.ORDER], return_counts=True)
    levels = {}
    for order in range(2, lm.ORDER + 1):
        k, where = np.unique(lm.tail(key, order), return_inverse=True)
        levels[order] = k, np.bincount(where, n)
    want = lm.log_probability(lm.build(levels), *buffers(pa.array(texts, pa.large_string())))
    want = sorted((r[0], w) for r, w in zip(edge_rows, want, strict=True) if r[0] is not None)
    for hot in (0, 300, lm.HOT_KEYS):
        got = sorted((r["doc_id"], r["score"]) for r in lm.score(edge, hot_words=20, hot_keys=hot).collect() if r["doc_id"] is not None)
        assert [i for i, _ in got] == [i for i, _ in want]
        bad = [(i, g, w) for (i, g), (_, w) in zip(got, want, strict=True) if not math.isclose(g, w, rel_tol=1e-4)]
        assert not bad, (hot, bad)


def shingle_sets(rows, size):
    """(doc_id, set) of every row with a doc_id."""
    out = []
    for i, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        if i is not None:
            out.append((i, {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}))
    return out


def near(a, b, percent):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def test_op10_finds_near_copies_everywhere(spark, edge, edge_rows):
    """Classes are those of all pairs of the corpus, not only of neighbours in doc_id order."""
    sets = shingle_sets(edge_rows, 5)
    comp = {i: i for i, _ in sets}
    for i, a in sets:
        for j, b in sets:
            if i < j and near(a, b, 80) and comp[i] != comp[j]:
                low, high = sorted((comp[i], comp[j]))
                comp = {k: low if c == high else c for k, c in comp.items()}
    assert any(j - i > 1 for j, i in comp.items()) and comp[155] == 3
    got = fingerprint.edits(edge).where("doc_id is not null").collect()
    assert len(got) == len(sets)
    assert {r["doc_id"]: r["near_id"] for r in got} == comp


def test_op3_counts_every_link(spark, edge, edge_rows, monkeypatch):
    """Links inside a component count too, however many blocks its sets are dealt to."""
    sets = shingle_sets(edge_rows, 3)
    want = sorted((i, sum(near(a, b, 90) for _, b in sets) - bool(a)) for i, a in sets)
    assert max(n for _, n in want) > 5
    for most in (jaccard.BLOCK_SETS, 4):
        monkeypatch.setattr(jaccard, "BLOCK_SETS", most)
        got = jaccard.link(edge).where("doc_id is not null").collect()
        assert sorted((r["doc_id"], r["n_links"]) for r in got) == want


def test_op3_versions_share_a_component(spark):
    """Rows that repeat a doc_id are versions of one document, also where they lie in different components."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (2, b), (5, a), (5, b), (6, c), (7, c), (7, None), (None, a)]
    got = {(r["doc_id"], r["n_shingles"]): r for r in jaccard.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: r["component_id"] for k, r in got.items() if k[1]} == {(1, 38): 1, (2, 38): 1, (5, 38): 1, (6, 38): 6, (7, 38): 6, (None, 38): None}
    assert got[7, 0]["component_id"] == 7
    assert got[6, 38]["n_links"] == 1 and got[7, 0]["n_links"] == 0


def test_op3_groups_with_equal_prefix_meet(spark):
    """Members of one group, which share prefix and size, are linked with each other and with other groups by their whole sets only."""
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join([*base[:k], f"x{i}", *base[k + 1 :]])) for i, k in enumerate((0, 1, 2, 60, 61, 117, 118, 119))]
    rows += [(50 + i, " ".join([*base[: 100 - i], *(f"y{i}-{k}" for k in range(20 + i))])) for i in range(6)]
    for size, percent in ((3, 90), (5, 80)):
        sets = shingle_sets(rows, size)
        want = sorted((i, sum(near(a, b, percent) for _, b in sets) - 1) for i, a in sets)
        got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()
        assert sorted((r["doc_id"], r["n_links"]) for r in got) == want


def test_op3_long_histograms_are_bounds():
    rng = np.random.default_rng(1)
    for n, m in ((600, 700), (1000, 1100), (3000, 2500)):
        both = rng.integers(0, 1 << 62, 500, dtype=np.uint64)
        x, y = (np.concatenate([both, rng.integers(0, 1 << 62, k - 500, dtype=np.uint64)]) for k in (n, m))
        assert jaccard._fits(jaccard._wide(x), jaccard._wide(y), 500)
        assert not jaccard._fits(jaccard._wide(x), jaccard._wide(y), min(n, m))
    assert jaccard._wide(x[:100]) is None and jaccard._fits(None, jaccard._wide(x), 10**9)


def test_op3_missing_histogram_bounds_nothing():
    some = np.full(jaccard.BUCKETS, 70, "<u2").tobytes()
    x, y = jaccard._bounds(np.array([None, some, some], object)), jaccard._bounds(np.array([None, None, some], object))
    need = jaccard._need(np.full(3, 10_000_000), np.full(3, 10_000_000), 90)
    assert jaccard._enough(x, y, need).tolist() == [True, True, False]


def brute_dedup(rows, phrase=13):
    first, out = {}, []
    key = lambda i: math.inf if i is None else i
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    for (i, _), w in zip(rows, words, strict=True):
        for k in range(len(w) - phrase + 1):
            first[tuple(w[k : k + phrase])] = min(first.get(tuple(w[k : k + phrase]), math.inf), key(i))
    for (i, _), w in zip(rows, words, strict=True):
        gone = {k + m for k in range(len(w) - phrase + 1) if first[tuple(w[k : k + phrase])] < key(i) for m in range(phrase)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def test_op4_versions_of_a_document(spark):
    """Rows that repeat a doc_id have results of their own: what recurs in one leaves the other alone."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(20)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b + " " + a), (6, c + " " + b), (9, c), (9, None), (3, "")]
    got = phrases.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == brute_dedup(rows)


def test_op4_shards_and_shifted_passages(spark):
    """Passages that overlap, repeat and begin anywhere, few words so that phrases recur by chance, many shards and automata."""
    rng = np.random.default_rng(11)
    base = [f"v{k}" for k in rng.integers(0, 400, 600)]
    rows = []
    for i in rng.permutation(90).tolist():
        parts = [base[a : a + n] for a, n in zip(rng.integers(0, 560, 4).tolist(), rng.integers(5, 60, 4).tolist(), strict=True)]
        rows.append((i, " ".join(w for p in parts for w in [*p, *(f"u{k}" for k in rng.integers(0, 50, int(rng.integers(0, 9))))])))
    rows += [(100, " ".join(["x"] * 500)), (101, " ".join(["x"] * 40)), (102, " ".join(["x", "y"] * 40)), (103, " ".join(["y", "x"] * 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for shards, most in ((None, phrases.AUTOMATON), (1, 50), (64, 1000)):
        got = phrases.dedup(docs, shards=shards, most=most).collect()
        assert sorted(map(tuple, got), key=str) == brute_dedup(rows)
