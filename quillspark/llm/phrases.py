"""Substring dedup: repeated-phrase automata.

A phrase is 13 words in a row. Recurring ones are found first: each phrase is sent,
packed by batch, to the bucket of its minimizer (the least hash of its five-word runs,
which neighbouring phrases share), 64 bits of minimizer and 32 of the phrase, with
document and place; there it learns the smallest document that has it. Neighbouring
phrases with one such source make passages. Documents are dealt to shards; the passages
that a shard needs are cut from the words of their source documents, compiled into
Aho-Corasick automata over word codes, and every document of the shard is streamed
through them. What is removed are the automaton's hits whose passage comes from a
document with a smaller doc_id: words are compared with words, hashes only choose which
passages a shard is sent. A window that recurs has equal hashes, so none is missed (but
where two different phrases share all 96 bits and one hides the other's source).

Null text counts as empty. doc_id names a document: rows that repeat it are versions of
it, each with its own result, and make no phrase recur by themselves; documents without
one come after all others, in an order by their text.
Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, small, squeezed, tidy, two, unsqueezed
from quillspark.llm.words import Words, buffers, chunks, mix, windows

PHRASE, ANCHOR = 13, 5
#: Phrases of one minimizer that are packed together: bits of a mask.
RUN = 16
LAST = (1 << 63) - 1
#: Phrases of one pattern at most; words of one automaton, of which a shard has as many as it needs.
PART, AUTOMATON = 20, 1_000_000


def _minimizers(h: np.ndarray, at: np.ndarray, phrase: int, anchor: int) -> np.ndarray:
    """The least hash of `anchor` words in a row inside each phrase."""
    if not len(at):
        return np.zeros(0, np.uint64)
    g, _, _ = windows(h, np.array([0, len(h)]), anchor)
    width, least, done = phrase - anchor + 1, g, 1
    while done < width:
        step = min(done, width - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    return least[at]


def packed(docs: DataFrame, buckets: int, phrase: int, anchor: int) -> DataFrame:
    """(bucket, base, m, doc, pos, n, w): runs of phrases with one minimizer, as arrays in binary columns."""
    names = ["bucket", "m", "doc", "pos", "n", "w"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            raw, offsets = buffers(b.column(1))
            for i, j in chunks(offsets, 1 << 22):
                parts = []
                for x, y in ((i + k, i + m) for k, m in chunks(offsets[i : j + 1])):
                    w = Words(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x])
                    h, row, at = w.windows(phrase)
                    if not len(h):
                        continue
                    m = _minimizers(w.hash, at, phrase, anchor)
                    new = np.concatenate([[True], (m[1:] != m[:-1]) | (row[1:] != row[:-1])])
                    begin = np.flatnonzero(new)
                    place = np.arange(len(m)) - begin[np.cumsum(new) - 1]
                    begin = np.flatnonzero(place % RUN == 0)
                    parts.append((m[begin], ids[x + row[begin]], (at - w.first[row])[begin].astype(np.uint32), np.diff(np.append(begin, len(m))).astype(np.uint8), (h >> np.uint64(32)).astype(np.uint32)))
                if not parts:
                    continue
                m, doc, pos, n, w = (np.concatenate(c) for c in zip(*parts, strict=True))
                bucket = (mix(m + np.uint64(1)) % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                first = np.cumsum(n, dtype=np.int64) - n
                m, doc, pos, n, first = m[order], doc[order], pos[order], n[order], first[order]
                size = n.astype(np.int64)
                w = w[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)]
                has, cut = np.unique(bucket[order], return_index=True)
                cut = np.append(cut, len(m))
                wcut = np.concatenate([[0], np.cumsum(size)])[cut]
                base = int(doc.min())
                small = int(doc.max()) - base < 1 << 32
                doc = (doc - base).astype("<u4") if small else doc.astype("<i8")
                blob = lambda a, c: pa.array([a[s:e].tobytes() for s, e in zip(c[:-1], c[1:], strict=True)], pa.binary())
                cols = [pa.array(has), pa.array(np.full(len(has), base if small else 0)), blob(m, cut), blob(doc, cut), blob(pos, cut), blob(n, cut), blob(w, wcut)]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "base", *names[1:]])

    return docs.mapInArrow(tidy(run), "bucket int, base long, m binary, doc binary, pos binary, n binary, w binary")


def recurring(m: np.ndarray, doc: np.ndarray, pos: np.ndarray, n: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """(doc, pos, source, source_pos, n) of runs of phrases that a smaller document also has; neighbours there too."""
    size = n.astype(np.int64)
    owner = np.repeat(np.arange(len(m)), size)
    with np.errstate(over="ignore"):
        key = mix(m[owner] + (w.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    k = key[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    many = np.diff(np.append(begin, len(k)))
    d = doc[owner][order]
    least = np.repeat(np.minimum.reduceat(d, begin), many)
    first = np.repeat(np.minimum.reduceat(np.where(d == least, np.arange(len(k)), len(k)), begin), many)  # one place in it
    hit, source, there = np.zeros(len(k), bool), np.zeros(len(k), np.int64), np.zeros(len(k), np.int64)
    place = pos.astype(np.int64)[owner] + np.arange(len(k)) - (np.cumsum(size) - size)[owner]
    hit[order], source[order], there[order] = d > least, least, place[order][first]
    at = np.flatnonzero(hit)
    if not len(at):
        return [np.zeros(0, np.int64)] * 5
    owner, place, source, there = owner[at], place[at], source[at], there[at]
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (place[1:] != place[:-1] + 1) | (source[1:] != source[:-1]) | (there[1:] != there[:-1] + 1)])
    run = np.flatnonzero(new)
    return [doc[owner[run]], place[run], source[run], there[run], np.diff(np.append(run, len(at)))]


def confirmed(docs: DataFrame, phrase: int = PHRASE, anchor: int = ANCHOR) -> DataFrame:
    """(doc, pos, source, source_pos, n): n phrases in a row from pos on that the document source has from source_pos on."""
    buckets = 2 * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = ["doc", "pos", "source", "source_pos", "n"]

    def bucket(rows: list[dict]) -> pa.RecordBatch:
        cols = []
        for name, kind in (("m", np.uint64), ("pos", np.uint32), ("n", np.uint8), ("w", np.uint32)):
            cols.append(np.frombuffer(b"".join(r[name] for r in rows), kind))
        m, pos, n, w = cols
        doc = []
        for r in rows:
            wide = len(r["doc"]) == len(r["m"])
            doc.append(np.frombuffer(r["doc"], "<i8") if wide else np.frombuffer(r["doc"], "<u4").astype(np.int64) + r["base"])
        out = recurring(m, np.concatenate(doc), pos, n, w)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(out, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for b in batches:
            for r in b.to_pylist():
                if held and r["bucket"] != held[0]["bucket"]:
                    yield bucket(held)
                    held = []
                held.append(r)
        if held:
            yield bucket(held)

    rows = packed(docs, buckets, phrase, anchor).repartition("bucket").sortWithinPartitions("bucket")
    return rows.mapInArrow(tidy(run), "doc long, pos int, source long, source_pos int, n int")


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of each value of key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        k = b.column(key).to_numpy()
        cut = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if i == j:
                continue
            if held and held[0].column(key)[0].as_py() != int(k[i]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def wanted(found: DataFrame, shard: Callable[[str], Column]) -> DataFrame:
    """(shard, source, at, n): the parts of source documents, at phrases and their numbers, that a shard's documents have."""

    def parts(rows: pa.Table) -> pa.RecordBatch:
        doc, pos, source, there, n = (rows.column(c).to_numpy().astype(np.int64) for c in ("doc", "pos", "source", "source_pos", "n"))
        order = np.lexsort((pos, pos - there, source, doc))
        doc, pos, source, there, n = (c[order] for c in (doc, pos, source, there, n))
        new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (source[1:] != source[:-1]) | (pos[1:] != pos[:-1] + n[:-1]) | (there[1:] != there[:-1] + n[:-1])])
        run = np.flatnonzero(new)
        run = np.unique(np.stack([source[run], there[run], np.add.reduceat(n, run)]), axis=1)
        # cut at multiples of PART, so that the insides of passages of several documents are the same parts
        source, low, high = run[0], run[1], run[1] + run[2]
        many = (high - 1) // PART - low // PART + 1
        of = np.repeat(np.arange(len(many)), many)
        step = (low // PART)[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        at, end = np.maximum(low[of], step * PART), np.minimum(high[of], (step + 1) * PART)
        part = np.unique(np.stack([source[of], at, end - at]), axis=1)
        begin = np.flatnonzero(np.concatenate([[True], part[0, 1:] != part[0, :-1]]))
        cut = np.append(begin, part.shape[1]).astype(np.int32)
        lists = [pa.ListArray.from_arrays(cut, pa.array(part[k].astype(np.int32))) for k in (1, 2)]
        key = pa.array(np.full(len(begin), rows.column("shard")[0].as_py(), np.int32))
        return pa.RecordBatch.from_arrays([key, pa.array(part[0, begin]), *lists], ["shard", "source", "at", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, "shard"):
            yield parts(rows)

    rows = found.withColumn("shard", shard("doc")).repartition("shard").sortWithinPartitions("shard")
    return rows.mapInArrow(tidy(run), "shard int, source long, at array<int>, n array<int>")


def passages(docs: DataFrame, parts: DataFrame, phrase: int) -> DataFrame:
    """(shard, source, words): the wanted parts, words joined by a space, cut from their source documents (doc, text as squeezed)."""
    spark = docs.sparkSession
    sources = docs.join(small(parts.select(F.col("source").alias("doc")).distinct()), "doc", "left_semi")
    none = F.lit(None)
    both = squeezed(sources.select("doc", "text")).select("doc", F.lit(-1).alias("shard"), "text", none.cast("array<int>").alias("at"), none.cast("array<int>").alias("n"))
    both = both.union(parts.select("source", "shard", none.cast("binary"), "at", "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, versions = None, []
        for b in batches:
            out: list[tuple] = []
            for key, shard, text, at, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != doc:
                    doc, versions = key, []
                if shard < 0:  # texts of a document come before what is wanted of it
                    versions.append(unsqueezed([text])[0].split())
                    continue
                pieces = [ws[p : p + k + phrase - 1] for ws in versions for p, k in zip(at, n, strict=True) if p + k + phrase - 1 <= len(ws)]
                out.append((shard, key, [b" ".join(x) for x in pieces]))
            if out:
                cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.list_(pa.binary())), strict=True)]
                yield pa.RecordBatch.from_arrays(cols, ["shard", "source", "words"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = both.repartition(n, "doc").sortWithinPartitions("doc", "shard")
    return rows.mapInArrow(tidy(run), "shard int, source long, words array<binary>")


class Automaton:
    """Passages over word codes, each with the smallest document it is from."""

    def __init__(self, found: list[tuple[bytes, int]]):
        import ahocorasick

        self.code: dict[bytes, str] = {}
        self.other = chr(1)  # words of no passage
        self.length: list[int] = []
        self.source: list[int] = []
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for words, source in found:
            text = "".join([self.code.get(w) or self._new(w) for w in words.split(b" ")])
            k = self.tree.get(text, -1)
            if k < 0:
                self.tree.add_word(text, len(self.length))
                self.length.append(len(text))
                self.source.append(source)
            else:
                self.source[k] = min(self.source[k], source)
        self.tree.make_automaton()
        self.length, self.source = np.array(self.length, np.int64), np.array(self.source, np.int64)

    def _new(self, word: bytes) -> str:
        k = len(self.code) + 2
        c = self.code[word] = chr(k if k < 0xD800 else k + 0x800)  # no surrogates
        return c

    def cover(self, words: list[bytes], doc: int, edge: np.ndarray) -> None:
        """Adds to edge where hits of passages of smaller documents begin (1) and end (-1)."""
        get, other = self.code.get, self.other
        found = list(self.tree.iter("".join([get(w, other) for w in words])))
        if found:
            end, k = np.array(found, np.int64).T
            ok = self.source[k] < doc
            np.add.at(edge, end[ok] + 1 - self.length[k[ok]], 1)
            np.add.at(edge, end[ok] + 1, -1)


def automata(found: list[tuple[bytes, int]], most: int = AUTOMATON) -> list[Automaton]:
    """As many automata as it takes for none to have more than `most` words."""
    out, held, n = [], [], 0
    for words, source in found:
        k = words.count(b" ") + 1
        if held and n + k > most:
            out.append(Automaton(held))
            held, n = [], 0
        held.append((words, source))
        n += k
    return [*out, Automaton(held)] if held else out


def dedup(docs: DataFrame, phrase: int = PHRASE, anchor: int = ANCHOR, shards: int | None = None, most: int = AUTOMATON) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept words of every document, joined by one space."""
    unnamed = F.lit(LAST) - F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    docs = two(docs).select(F.coalesce("doc_id", unnamed).alias("doc"), "text", "doc_id")
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = lambda c: F.pmod(F.xxhash64(F.lit(4), c), F.lit(shards or 4 * count)).cast("int")
    found = confirmed(docs.select("doc", "text"), phrase, anchor)
    parts = materialize(wanted(found, of), "parts")
    none = F.lit(None)
    pieces = passages(docs, parts, phrase).select("shard", F.lit(0).alias("kind"), F.col("source").alias("doc"), none.cast("long").alias("doc_id"), none.cast("binary").alias("text"), "words")
    whole = squeezed(docs).select(of("doc").alias("shard"), F.lit(1), "doc", "doc_id", "text", none.cast("array<binary>"))

    def stream(rows: pa.Table, trees: list[Automaton]) -> pa.RecordBatch:
        cols: list[list] = [[], [], [], []]
        for doc, key, text in zip(*(rows.column(c).to_pylist() for c in ("doc", "doc_id", "text")), strict=True):
            words = unsqueezed([text])[0].split()  # bytes: splits at 0x20 and 0x09-0x0D only
            edge = np.zeros(len(words) + 1, np.int64)
            if len(words) >= phrase:
                for tree in trees:
                    tree.cover(words, doc, edge)
            gone = np.cumsum(edge[:-1]) > 0
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words
            for c, v in zip(cols, (key, len(words), len(words) - len(kept), b" ".join(kept).decode()), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["doc_id", "n_words", "n_removed", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, trees = None, [], []
        for b in batches:
            for rows in _grouped(iter([b]), "shard"):
                if (now := rows.column("shard")[0].as_py()) != shard:
                    shard, held, trees = now, [], []
                first = int(np.searchsorted(rows.column("kind").to_numpy(), 1))  # passages come before documents
                for source, words in zip(rows.column("doc")[:first].to_pylist(), rows.column("words")[:first].to_pylist(), strict=True):
                    held += [(w, source) for w in words]
                if first < rows.num_rows:
                    if held:
                        trees, held = automata(held, most), []
                    for i in range(first, rows.num_rows, 512):
                        yield stream(rows.slice(i, 512), trees)

    rows = pieces.union(whole).repartition(count, "shard").sortWithinPartitions("shard", "kind")
    return rows.mapInArrow(tidy(run), "doc_id long, n_words long, n_removed long, kept string")
