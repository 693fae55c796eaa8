"""Every opN query on the edge fixture against a brute-force version, and on empty tables."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from quillspark.llm import queries

W = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def words(t, lower=False):
    t = t or ""
    return W.findall(t.translate(LOW) if lower else t)


def run(spark, tables, name):
    (query,) = (q for n, q in queries.QUERIES.items() if n.startswith(f"{name}_"))
    return [r.asDict() for r in query(spark, tables).collect()]


@pytest.mark.parametrize("name", [n.split("_")[0] for n in queries.QUERIES])
def test_empty_tables(spark, empty_tables, name):
    assert run(spark, empty_tables, name) == []


def test_op1(spark, tables, edge_rows):
    got = run(spark, tables, "op1")
    assert len(got) == len(edge_rows)
    want = collections.Counter()
    for i, t, *_ in edge_rows:
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[i, len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:])] += 1
    keys = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32")
    assert collections.Counter(tuple(r[k] for k in keys) for r in got) == want
    by = collections.defaultdict(set)
    for r in got:
        by[r["payload_sha256"]].add((r["media_sha256"], r["feature"], r["media_bytes"]))
    assert all(len(v) == 1 for v in by.values())


def brute_spans(t):
    t = t or ""
    luhn = lambda d: sum(int(c) if i % 2 == 0 else (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(c)] for i, c in enumerate(reversed(d))) % 10 == 0
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+".replace(r"[\x20-]", "[ -]"), t) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(digits(m[0])) <= 15]
    return sorted(out)


def test_op2(spark, tables, edge_rows):
    got = {r["doc_id"]: r for r in run(spark, tables, "op2") if r["doc_id"] is not None}
    names = ("email", "ip", "card", "phone")
    for i, t, *_ in edge_rows:
        if i is None:
            continue
        spans, r = brute_spans(t), got[i]
        text = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
        assert [r[f"n_{n}"] for n in names] == [sum(k == j for _, k, _ in spans) for j in range(4)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(text.split(",")) - {""} <= set(r["spans"].split(","))
    assert got[158]["n_email"] == got[158]["n_ip"] == got[158]["n_card"] == got[158]["n_phone"] == 1


def test_op3(spark, tables, edge_rows):
    got = run(spark, tables, "op3")
    sets = {}
    for i, t, *_ in edge_rows:
        w = words(t, True)
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    ids = sorted(i for i in sets if i is not None)
    comp = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                low, high = sorted((comp[a], comp[b]))
                comp = {i: low if c == high else c for i, c in comp.items()}
    assert len(got) == len(edge_rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]])
    assert len(set(comp.values())) < len(comp) - 10


def test_op4(spark, tables, edge_rows):
    got = collections.Counter(tuple(r[k] for k in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in run(spark, tables, "op4"))
    first = {}
    key = lambda i: math.inf if i is None else i
    for i, t, *_ in edge_rows:
        w = words(t)
        for k in range(len(w) - 12):
            first[tuple(w[k : k + 13])] = min(first.get(tuple(w[k : k + 13]), math.inf), key(i))
    want, some = collections.Counter(), 0
    for i, t, *_ in edge_rows:
        w = words(t)
        gone = set()
        for k in range(len(w) - 12):
            if first[tuple(w[k : k + 13])] < key(i):
                gone.update(range(k, k + 13))
        some += bool(gone)
        want[i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()] += 1
    assert got == want
    assert some > 20


def test_op5(spark, tables, edge_rows):
    got = run(spark, tables, "op5")
    ids = {r["doc_id"] for r in got}
    assert ids <= {i for i, t, *_ in edge_rows if t and re.search(r"[^\W\d_]", t)}
    assert all(0 <= r["tail_2"] <= r["tail_1"] <= 1 and abs(r["expected_grade"] - r["tail_1"] - r["tail_2"]) < 1e-9 for r in got)


def test_op6(spark, tables, edge_rows):
    got = run(spark, tables, "op6")
    again = run(spark, tables, "op6")
    order = lambda rs: sorted(map(str, rs))
    assert order(got) == order(again) and len(got) == len(edge_rows)
    size = collections.Counter()
    for _, t, _, s, *_ in edge_rows:
        size[s] += len(words(t))
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(size.values())
    while free:
        total = sum(weight[s] for s in free)
        above = {s for s in free if left * weight[s] / total > 2 * size[s]}
        for s in above or free:
            target[s] = 2 * size[s] if above else left * weight[s] / total
        left -= sum(target[s] for s in above)
        free = free - above if above else set()
    want = collections.Counter((i, len(words(t)), size[s], round(target[s], 6)) for i, t, _, s, *_ in edge_rows)
    assert collections.Counter((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got) == want
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert abs(sum(r["taken"] for r in got) - sum(target.values())) <= len(sources)


def test_op7(spark, tables, edge_rows):
    got = collections.defaultdict(list)
    for r in run(spark, tables, "op7"):
        got[r["doc_id"]].append(r)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = collections.Counter()
    for i, t, *_ in edge_rows:
        if not held(i):
            count.update([*words(t, True), None])
    n, v = sum(count.values()), len(count)
    for i, t, *_ in edge_rows:
        if i is None:
            continue
        tok = [*words(t, True), None]
        r = got[i][0]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(tok), sum(count[x] > 0 for x in tok), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in tok), rel_tol=1e-9)
        assert r["score"] < 0 and r["bits_per_byte"] < 12


def test_op8(spark, tables, edge_rows):
    got = run(spark, tables, "op8")
    assert len(got) == len(edge_rows)
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    right = 0
    for i, t, lang, *_ in edge_rows[:120]:
        assert by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
        right += by[i]["lang_pred"] == lang
    assert right >= 108
    assert {by[i]["lang_pred"] for i in (150, 151, 152)} == {"und"} and by[150]["score"] == 0
    assert all(0 <= r["score"] <= 1 for r in got)


def test_op9(spark, tables, edge_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = run(spark, tables, "op9")
    want = collections.Counter()
    for i, t, *_ in edge_rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            want[i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())] += 1
    assert collections.Counter(tuple(r[k] for k in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for o, n in sorted(b):
            assert o == at
            at += n
        assert at <= 4096
    assert len(bins) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_op10(spark, tables, edge_rows):
    got = [r for r in run(spark, tables, "op10")]
    assert len(got) == len(edge_rows)
    print_of = {}
    ordered = sorted((r for r in edge_rows if r[0] is not None), key=lambda r: -r[0])
    text = dict((i, t or "") for i, t, *_ in ordered)
    ids = sorted(text, reverse=True)
    for r in got:
        if r["doc_id"] is None:
            continue
        t = text[r["doc_id"]]
        assert r["n_chars"] == len(t)
        assert print_of.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        k = ids.index(r["doc_id"])
        if k + 1 < len(ids) and r["doc_id"] != 155:
            half = len(t) // 2
            assert r["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + text[ids[k + 1]][:half]).encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
