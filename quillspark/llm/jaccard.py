"""N-gram Jaccard join: a grouped prefix join over word shingles.

Shingles are ordered by a fixed-size count sketch of the corpus (rare ones first)
and then by hash; any order gives the same links, a good one few candidates. Equal
sets become one class, classes with equal size and equal prefix one group, and only
groups meet in the lists of their prefix shingles, where pairs are filtered by size,
place and two histograms (128 buckets; for long sets also one that grows with the
set), all upper bounds of the overlap. The bounds of a group are the maxima of its
members', so a pair of groups stays if any two members could be linked.

Two passes keep that linear where many near copies share lists: the first tests four
neighbours of each group and joins what passes to clusters; the second takes every
pair of groups that passes the bounds unless both lie in one cluster already, of long
lists only as many as join the same clusters. So every
link lies inside a cluster. There groups are expanded: whole texts meet block by block,
a large cluster in many blocks, every two sets of a cluster are compared, and verified
links give the components and the number of links of every document.

Sets are of 56-bit hashes of whole shingles. Null text, or text without words, has no
shingles and is linked with nothing; with fewer words than a shingle the whole sequence
is the one shingle. Rows with words that share a doc_id are versions of one document and
share its component. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import discard, hold, materialize, small, squeezed, tidy, two, unsqueezed
from quillspark.llm.fingerprint import bands_of, shingles, signatures
from quillspark.llm.graph import components
from quillspark.llm.words import Words, buffers, chunks, mix

SHINGLE, PERCENT = 3, 90
#: The sketch has 2 ** SKETCH_BITS counters whatever the corpus; PARTS rows carry it.
SKETCH_BITS, PARTS = 21, 64
BUCKETS = 128
#: Sets of more shingles also have a histogram with a bucket for every two to four of them.
LONG = 512


def sketch(docs: DataFrame, size: int = SHINGLE) -> np.ndarray:
    """Order level of each counter: 0 up to twice the mean count, then two a doubling. Fixed size, summed part by part."""
    span = 1 << SKETCH_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(span, np.int64)
        for b in batches:
            raw, offsets = buffers(b.column(0))
            for i, j in chunks(offsets, 1 << 22):
                part = [shingles(Words(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], lower=True), size)[0] for x, y in ((i + k, i + m) for k, m in chunks(offsets[i : j + 1]))]
                total += np.bincount((np.concatenate(part) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=span)
        if total.any():
            cut = np.minimum(total, 0xFFFF).astype("<u2").reshape(PARTS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(PARTS, dtype=np.int32)), pa.array([c.tobytes() for c in cut], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                more = np.frombuffer(data, "<u2").astype(np.uint32)
                sums[part] = np.minimum(sums[part].astype(np.uint64) + more, 0xFFFFFFFF).astype(np.uint32) if part in sums else more
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.astype("<u4").tobytes() for v in sums.values()], pa.binary())], ["part", "counts"])

    parts = docs.select("text").mapInArrow(count, "part int, counts binary").repartition(PARTS, "part").mapInArrow(add, "part int, counts binary")
    total = np.zeros((PARTS, span // PARTS), np.float64)
    for r in parts.collect():  # PARTS rows, 4 << SKETCH_BITS bytes in all
        total[r["part"]] += np.frombuffer(bytes(r["counts"]), "<u4")
    total = total.ravel()
    floor = 2 * total.mean() + 8
    return np.where(total > floor, np.clip(np.round(2 * np.log2(np.maximum(total, 1) / floor)) + 1, 1, 127), 0).astype(np.uint8)


def keyed(w: Words, level: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, first[r]..first[r+1] per row): each row's distinct shingles in the common order."""
    h, first = shingles(w, size)
    row = np.repeat(np.arange(w.rows), np.diff(first))
    key = level[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8)
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    if len(key):
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])])
        key, row = key[new], row[new]
    return key, np.searchsorted(row, np.arange(w.rows + 1))


def prefix_size(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - -(-percent * n // 100) + 1, 0)


def digests(key: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums of each row's set."""
    out, full = [], np.flatnonzero(np.diff(first))
    for salt in (0, 0x5851F42D4C957F2D):
        d = np.zeros(len(first) - 1, np.uint64)
        if len(full):
            d[full] = np.add.reduceat(mix(key ^ np.uint64(salt)), first[full])
        out.append(d.view(np.int64))
    return out


def _wide(key: np.ndarray) -> bytes | None:
    """Bucket counts of a long set, 2 ** k buckets; none for others, and where a count leaves a byte."""
    if len(key) <= LONG:
        return None
    span = 1 << (len(key) - 1).bit_length() - 2
    count = np.bincount((key & np.uint64(span - 1)).astype(np.int64), minlength=span)
    return count.astype(np.uint8).tobytes() if count.max() < 256 else None


def sets(docs: DataFrame, level, size: int, percent: int, bands: bool = False) -> DataFrame:
    """Of every document: n, the set's digest, prefix (or, bands, the bands of its signature) and histograms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = buffers(b.column(1))
            for i, j in chunks(offsets):
                key, first = keyed(Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True), level.value, size)
                n = np.diff(first)
                full = np.flatnonzero(n)
                if bands:
                    every = bands_of(signatures(b.column(1).slice(i, j - i), size=size))
                    p = np.where(n > 0, every.shape[1], 0)
                    head = every[full].ravel()
                else:
                    p = prefix_size(n, percent)
                    at = np.arange(p.sum()) - np.repeat(np.cumsum(p) - p, p) + np.repeat(first[:-1], p)
                    head = key[at]
                group = np.zeros(len(n), np.uint64)
                cut = np.concatenate([[0], np.cumsum(p)])
                if len(full):
                    group[full] = mix(np.add.reduceat(mix(head), cut[full]) + n[full].astype(np.uint64))
                owner = np.repeat(np.arange(len(n)), n)
                bound = np.bincount(owner * BUCKETS + (key & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=len(n) * BUCKETS).reshape(len(n), BUCKETS)
                bounds = pa.array([x.astype("<u2").tobytes() if x.max() < 0xFFFF else None for x in bound], pa.binary())
                wide = pa.array([_wide(key[x:y]) for x, y in zip(first[:-1], first[1:], strict=True)], pa.binary())
                lists = pa.ListArray.from_arrays(cut.astype(np.int32), pa.array(head.view(np.int64)))
                cols = [b.column(0).slice(i, j - i), pa.array(n), *map(pa.array, digests(key, first)), pa.array(group.view(np.int64)), lists, bounds, wide]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "d1", "d2", "gid", "head", "bound", "wide"])

    return docs.mapInArrow(run, "doc_id long, n long, d1 long, d2 long, gid long, head array<long>, bound binary, wide binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Batches of rows sorted by key, cut where a key ends."""
    held: dict[str, np.ndarray] | None = None
    for b in batches:
        cols = {n: b.column(n).to_numpy(zero_copy_only=False) for n in b.schema.names}
        if held is not None:
            cols = {n: np.concatenate([held[n], cols[n]]) for n in cols}
        key = cols["key"]
        last = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
        if last:
            yield {n: c[:last] for n, c in cols.items()}
        held = {n: c[last:] for n, c in cols.items()}
    if held is not None and len(held["key"]):
        yield held


def _need(na: np.ndarray, nb: np.ndarray, percent: int) -> np.ndarray:
    """Least intersection of linked sets of these sizes."""
    return -(-percent * (na + nb) // (100 + percent))


def _room(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets that meet first at these places of their prefixes can still be similar enough."""
    return 1 + np.minimum(n[i] - pos[i] - 1, n[j] - pos[j] - 1) >= _need(n[i], n[j], percent)


def _spread(lo: np.ndarray, hi: np.ndarray, of: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(of[k], j) for all j from lo[k] to hi[k], in pieces."""
    size = np.maximum(hi - lo, 0)
    edges = np.concatenate([[0], np.cumsum(size)])
    s = 0
    while s < len(of):
        e = max(s + 1, int(np.searchsorted(edges, edges[s] + most, "right")) - 1)
        n = size[s:e]
        yield np.repeat(of[s:e], n), np.arange(int(n.sum())) - np.repeat(edges[s:e] - edges[s], n) + np.repeat(lo[s:e], n)
        s = e


#: Lists up to this long are searched for rows that no other row can be linked with.
SEARCHED = 4096
#: How far neighbours in a list are apart at most, and of how many a group is tested in the first pass.
APART, PICKS = 3, 4


def neighbours(rows: DataFrame, percent: int) -> DataFrame:
    """kind 1: pairs (g, h) of groups that are near each other in a list; kind 0: the rows of lists that may be linked with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _runs(batches):
            key, n, g, pos = c["key"], c["n"], c["g"], c["pos"]
            found = []
            for k in range(1, min(APART, len(key) - 1) + 1):
                i = np.flatnonzero((key[k:] == key[:-k]) & (n[:-k] * 100 >= percent * n[k:]))
                i = i[_room(n, pos, i, i + k, percent)]
                found.append(np.stack([np.minimum(g[i], g[i + k]), np.maximum(g[i], g[i + k])]))
            pair = np.unique(np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1), axis=1)
            at = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
            length = np.bincount(at)[at]
            live = length > SEARCHED
            few = np.flatnonzero((length > 1) & ~live)
            big = np.int64(1) << 40
            hi = np.searchsorted(at * big + n, at[few] * big + n[few] * 100 // percent, "right")
            for i, j in _spread(few + 1, hi, few):
                ok = _room(n, pos, i, j, percent)
                live[i[ok]] = live[j[ok]] = True
            m = int(live.sum())
            zero = np.zeros(pair.shape[1], np.int64)
            cols = [np.concatenate(x) for x in ((np.zeros(m, np.int64), zero + 1), (key[live], zero), (pos[live], zero), (n[live], zero), (g[live], pair[0]), (np.zeros(m, np.int64), pair[1]))]
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], ["kind", "key", "pos", "n", "g", "h"])

    return rows.mapInArrow(run, "kind long, key long, pos long, n long, g long, h long")


def _bounds(x: np.ndarray) -> np.ndarray:
    """A matrix of bucket counts; a missing one bounds nothing."""
    none = np.full(BUCKETS, 0xFFFF, "<u2").tobytes()
    return np.frombuffer(b"".join(none if v is None or v != v else bytes(v) for v in x), "<u2").reshape(-1, BUCKETS)


def _enough(x: np.ndarray, y: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Whether sets with these bucket counts can share as many items as they need; always, if a count is missing."""
    missing = (x[:, 0] == 0xFFFF) | (y[:, 0] == 0xFFFF)
    return missing | (np.minimum(x, y).sum(1, dtype=np.int64) >= need)


#: Of longer lists only pairs that join clusters are kept, not all.
PAIRED = 16


def forest(n: np.ndarray, pos: np.ndarray, g: np.ndarray, comp: np.ndarray, bound: np.ndarray, percent: int) -> Iterator[np.ndarray]:
    """(2, k) pairs of a list's groups, rows sorted by size, that pass the filters: all with a long set, and of the others, which
    have no further test, as many as it takes to join what they join."""
    label = np.unique(comp, return_inverse=True)[1]
    order = np.argsort(label, kind="stable")
    first = np.searchsorted(label[order], np.arange(label.max() + 2))
    low, high = np.searchsorted(n, -(-percent * n // 100), "left"), np.searchsorted(n, n * 100 // percent, "right")
    free, long = np.ones(len(n), bool), n > LONG
    for begin in range(len(n)):
        if not free[begin]:
            continue
        queue = order[first[label[begin]] : first[label[begin] + 1]].tolist()
        free[queue] = False
        while queue:
            i = queue.pop()
            j = np.flatnonzero(free[low[i] : high[i]]) + low[i]
            j = j[_room(n, pos, i, j, percent)]
            j = j[_enough(bound[i][None], bound[j], _need(n[i], n[j], percent))]
            if not len(j):
                continue
            sure = j[~(long[j] | long[i])]
            some, one = np.unique(label[sure], return_index=True)
            pair = np.concatenate([sure[one], j[long[j] | long[i]]])
            yield np.stack([np.minimum(g[i], g[pair]), np.maximum(g[i], g[pair])])
            for k in some.tolist():
                rows = order[first[k] : first[k + 1]]
                free[rows] = False
                queue += rows.tolist()


def across(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (g, h) of groups in one list that pass the filters and don't lie in one cluster (comp); those that join the rest of a long list to it are enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _runs(batches):
            key, n, pos, g, comp = (c[x] for x in ("key", "n", "pos", "g", "comp"))
            bound = _bounds(c["bound"])
            at = np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1
            begin = np.searchsorted(at, np.arange(at[-1] + 2))
            length = np.diff(begin)
            found = [np.zeros((2, 0), np.int64)]
            for k in np.flatnonzero(length > PAIRED).tolist():
                s = slice(begin[k], begin[k + 1])
                found += forest(n[s], pos[s], g[s], comp[s], bound[s], percent)
            few = np.flatnonzero(length[at] <= PAIRED)
            big = np.int64(1) << 40
            hi = np.searchsorted(at * big + n, at[few] * big + n[few] * 100 // percent, "right")
            for i, j in _spread(few + 1, hi, few, 1 << 16):
                ok = comp[i] != comp[j]
                i, j = i[ok], j[ok]
                ok = _room(n, pos, i, j, percent)
                i, j = i[ok], j[ok]
                ok = _enough(bound[i], bound[j], _need(n[i], n[j], percent))
                i, j = i[ok], j[ok]
                found.append(np.stack([np.minimum(g[i], g[j]), np.maximum(g[i], g[j])]))
            pair = np.unique(np.concatenate(found, axis=1), axis=1)
            if pair.shape[1]:
                yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["g", "h"])

    return rows.mapInArrow(run, "g long, h long").distinct()


def _fold(x: np.ndarray, span: int) -> np.ndarray:
    return x.reshape(-1, span).sum(0, dtype=np.uint16)


def _fits(wx: bytes | None, wy: bytes | None, need: int) -> bool:
    """Whether the histograms of two long sets allow so large an overlap; the finer one is folded. A missing one bounds nothing."""
    if wx is None or wy is None:
        return True
    x, y = np.frombuffer(wx, np.uint8), np.frombuffer(wy, np.uint8)
    span = min(len(x), len(y))
    return int(np.minimum(_fold(x, span), _fold(y, span)).sum(dtype=np.int64)) >= need


def histograms(live: DataFrame, every: DataFrame, member: DataFrame) -> DataFrame:
    """(g, n, bound, wide) of the groups in live (g): the maxima of the members' histograms."""

    def most(parts: list[bytes | None], kind: str) -> bytes | None:
        return None if any(x is None for x in parts) else np.max([np.frombuffer(x, kind) for x in parts], axis=0).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = n = None
        held: tuple[list, list] = ([], [])
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[0] != g and g is not None:
                    yield out(g, n, held)
                    held = ([], [])
                g, n = row[:2]
                held[0].append(row[2])
                held[1].append(row[3])
                if len(held[0]) > 1024:
                    held = ([most(held[0], "<u2")], [most(held[1], "u1")])
        if g is not None:
            yield out(g, n, held)

    def out(g: int, n: int, held: tuple[list, list]) -> pa.RecordBatch:
        cols = [pa.array([g]), pa.array([n]), pa.array([most(held[0], "<u2")], pa.binary()), pa.array([most(held[1], "u1")], pa.binary())]
        return pa.RecordBatch.from_arrays(cols, ["g", "n", "bound", "wide"])

    schema = "g long, n long, bound binary, wide binary"
    several = member.where("g != row").select("g").distinct()
    one = every.join(small(live.join(several, "g", "left_anti").select(F.col("g").alias("row"))), "row", "left_semi").select(F.col("row").alias("g"), "n", "bound", "wide")
    many = every.join(small(member.join(several, "g", "left_semi").select("row", "g")), "row").select("g", "n", "bound", "wide")
    # once before the shuffle, so that a group of very many members sends a row per task
    many = many.sortWithinPartitions("g").mapInArrow(run, schema).repartition("g").sortWithinPartitions("g").mapInArrow(run, schema)
    return one.union(many)


def possible(pairs: DataFrame, known: DataFrame, percent: int) -> DataFrame:
    """The pairs (g, h) of groups whose histograms allow a link."""

    @F.pandas_udf("boolean")
    def ok(nx: pd.Series, x: pd.Series, wx: pd.Series, ny: pd.Series, y: pd.Series, wy: pd.Series) -> pd.Series:
        need = _need(nx.to_numpy(np.int64), ny.to_numpy(np.int64), percent)
        good = _enough(_bounds(x.to_numpy()), _bounds(y.to_numpy()), need)
        return pd.Series([bool(k) and _fits(a, b, m) for k, a, b, m in zip(good, wx, wy, need, strict=True)])

    a = known.select("g", F.col("n").alias("na"), F.col("bound").alias("ba"), F.col("wide").alias("wa"))
    b = known.select(F.col("g").alias("h"), F.col("n").alias("nb"), F.col("bound").alias("bb"), F.col("wide").alias("wb"))
    both = pairs.join(a, "g").join(b, "h").where(f"100 * na >= nb * {percent} and 100 * nb >= na * {percent}")
    return both.where(ok("na", "ba", "wa", "nb", "bb", "wb")).select("g", "h")


#: Shingles and sets of a block: two blocks meet in a task.
BLOCK_ITEMS, BLOCK_SETS = 1 << 19, 1 << 10


def _overlaps(items: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """How many items each two of the rows share; an item occurs once in a row."""
    _, of, times = np.unique(items, return_inverse=True, return_counts=True)
    shared = times > 1  # an item of one row is in no intersection
    place = np.cumsum(shared) - 1
    keep = shared[of]
    of, owner = place[of[keep]], owner[keep]
    order = np.argsort(of, kind="stable")
    of, owner = of[order], owner[order]
    out = np.zeros((rows, rows), np.float32)
    width = max(64, min(4096, (1 << 22) // max(rows, 1)))
    for lo in range(0, int(shared.sum()), width):
        i, j = np.searchsorted(of, [lo, lo + width])
        part = np.zeros((rows, width), np.float32)
        part[owner[i:j], of[i:j] - lo] = 1
        out += part @ part.T
    return out


def _roots(ok: np.ndarray) -> np.ndarray:
    """The first row that each row reaches by links."""
    root = np.arange(len(ok))
    while True:
        low = np.minimum(root, np.where(ok, root[None, :], len(ok)).min(1))
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


#: Classes that may be sent to every executor with what is known of them (some 70 bytes each).
SENT_CLASSES = 1 << 18


def links(linked: DataFrame, docs: DataFrame, level, size: int, percent: int) -> DataFrame:
    """(n, d1, d2, rep, root, times) from linked: (n, d1, d2, rep, weight, comp), the classes of clusters of several.

    A row for each task in which a class is linked with another: times documents, and root, the rep of a class that it
    reaches there. Together these rows join just what links join.
    """
    spark = docs.sparkSession
    wide = linked.groupBy("comp").agg(F.sum("n").alias("items"), F.count("*").alias("sets"))
    wide = wide.select("comp", F.greatest(F.ceil(F.col("items") / BLOCK_ITEMS), F.ceil(F.col("sets") / BLOCK_SETS)).cast("int").alias("blocks")).where("blocks > 1")
    block = F.pmod(F.xxhash64("d1", "d2"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = linked.join(wide, "comp", "left").select("n", "d1", "d2", "rep", "weight", "comp", F.coalesce("blocks", F.lit(1)).alias("blocks"), block.alias("block"))
    dealt = materialize(dealt, "linked", narrow=True)
    few = dealt.count() <= SENT_CLASSES
    live = F.broadcast(dealt) if few else dealt.hint("merge")
    text = docs.withColumnRenamed("doc_id", "rep").join(live, "rep")
    text = squeezed(text.select("n", "d1", "d2", "rep", "weight", "comp", "blocks", "block", "text"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least("block", k).alias("x"), F.greatest("block", k).alias("y")))
    rows = text.select("comp", F.explode(meets).alias("at"), "block", "rep", "n", "d1", "d2", "weight", "text")
    rows = rows.select("comp", "at.x", "at.y", "block", "rep", "n", "d1", "d2", "weight", "text")

    def items_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw, offsets = buffers(pa.array(unsqueezed(texts), pa.large_binary()).cast(pa.large_string()))
        keys, ends = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for i, j in chunks(offsets):
            key, first = keyed(Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True), level.value, size)
            keys.append(key)
            ends.append(first[1:] + ends[-1][-1])
        return np.concatenate(keys), np.concatenate(ends)

    def compare(cols: dict[str, np.ndarray], texts: list[bytes]) -> pa.RecordBatch | None:
        key, first = items_of(texts)
        n, d1, d2 = (cols[k] for k in ("n", "d1", "d2"))
        own1, own2 = digests(key, first)
        own = np.flatnonzero((own1 == d1) & (own2 == d2) & (np.diff(first) == n))  # a document may have versions in other classes
        _, one = np.unique(np.stack([d1[own], d2[own], n[own]]), axis=1, return_index=True)  # and a version may be repeated
        one = own[one]
        if len(one) < 2:
            return None
        cols = {k: c[one] for k, c in cols.items()}
        n = cols["n"]
        items = np.concatenate([key[first[k] : first[k + 1]] for k in one])
        common = _overlaps(items, np.repeat(np.arange(len(one)), n), len(one)).astype(np.int64)
        ok = common * 100 >= percent * (n[:, None] + n[None, :] - common)
        np.fill_diagonal(ok, False)
        if cols["x"][0] != cols["y"][0]:  # pairs inside a block are found where it meets itself
            ok &= cols["block"][:, None] != cols["block"][None, :]
        at = np.flatnonzero(ok.any(1))
        root, times = cols["rep"][_roots(ok)], ok @ cols["weight"]
        out = [pa.array(c[at]) for c in (n, cols["d1"], cols["d2"], cols["rep"], root, times)]
        return pa.RecordBatch.from_arrays(out, ["n", "d1", "d2", "rep", "root", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: dict[str, np.ndarray] = {}
        texts: list[bytes] = []
        for b in batches:
            more = {k: b.column(k).to_numpy().astype(np.int64) for k in b.schema.names if k != "text"}
            cols = {k: np.concatenate([cols[k], v]) for k, v in more.items()} if cols else more
            texts += b.column("text").to_pylist()
            key = np.stack([cols["comp"], cols["x"], cols["y"]])
            cut = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if (out := compare({k: c[i:j] for k, c in cols.items()}, texts[i:j])) is not None:
                    yield out
            cols, texts = {k: c[cut[-1] :] for k, c in cols.items()}, texts[cut[-1] :]
        if texts and (out := compare(cols, texts)) is not None:
            yield out

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "comp", "x", "y").sortWithinPartitions("comp", "x", "y")
    return rows.mapInArrow(tidy(run), "n long, d1 long, d2 long, rep long, root long, times long")


def clusters(every: DataFrame, member: DataFrame, percent: int, bands: bool) -> DataFrame:
    """(g, comp) of groups that may be linked with others: no link joins groups of two clusters."""
    groups = every.join(small(member.where("row = g").select("row")), "row", "left_semi")
    # in an order of its own in each list, so that neighbours differ from list to list
    rows = groups.select("n", F.col("row").alias("g"), F.posexplode("head").alias("pos", "key")).select("key", (F.lit(0) if bands else F.col("pos")).cast("long").alias("pos"), "n", "g")
    rows = rows.repartition("key").sortWithinPartitions("key", "n", F.xxhash64("g", "key"))
    found = hold(neighbours(rows, percent))
    lists = found.where("kind = 0").select("key", "pos", "n", "g")
    known = materialize(histograms(lists.select("g").distinct(), every, member), "histograms")
    beside = found.where("kind = 1").select("g", "h")
    beside = beside.union(beside.select(F.col("h").alias("g"), F.col("g").alias("h"))).groupBy("g")
    beside = beside.agg(F.array(*(F.min_by("h", F.xxhash64(F.lit(s), "g", "h")) for s in range(PICKS))).alias("h")).select("g", F.explode("h").alias("h"))
    beside = beside.select(F.least("g", "h").alias("g"), F.greatest("g", "h").alias("h")).distinct()
    comp = components(possible(beside, known, percent).select(F.col("g").alias("a"), F.col("h").alias("b")))
    comp = materialize(known.select("g").join(comp.withColumnRenamed("id", "g"), "g", "left").select("g", F.coalesce("component", "g").alias("comp")), "clusters", narrow=True)
    rows = lists.join(known.select("g", "bound").join(comp, "g"), "g").repartition("key").sortWithinPartitions("key", "n", "g")
    pairs = possible(across(rows.select("key", "pos", "n", "g", "comp", "bound"), percent), known, percent)
    of = lambda c, to: comp.select(F.col("g").alias(c), F.col("comp").alias(to))
    more = components(pairs.join(of("g", "a"), "g").join(of("h", "b"), "h").select("a", "b"))
    out = materialize(comp.join(more.withColumnRenamed("id", "comp"), "comp", "left").select("g", F.coalesce("component", "comp").alias("comp")), "clusters", narrow=True)
    found.unpersist()
    discard(known, comp)
    return out


def link(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, bands: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document: links join sets with 100 * intersection >= percent * union.

    n_links: how many other documents (rows with a doc_id) it is linked with, equal sets among them; null without a doc_id.

    bands: lists are those of equal bands of MinHash signatures instead of prefix shingles; links are verified alike.
    """
    docs = two(docs)
    level = docs.sparkSession.sparkContext.broadcast(np.zeros(1 << SKETCH_BITS, np.uint8) if bands else sketch(docs, size))
    every = materialize(sets(docs, level, size, percent, bands).withColumn("row", F.monotonically_increasing_id()), "shingles")
    named = every.where("n > 0 and doc_id is not null").select("doc_id", "row", "n", "gid", "d1", "d2")
    classes = named.groupBy("n", "gid", "d1", "d2").agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("weight"))
    classes = materialize(classes.select("n", "gid", "d1", "d2", F.col("first.doc_id").alias("rep"), F.col("first.row").alias("row"), "weight"), "classes", narrow=True)
    several = classes.groupBy("n", "gid").agg(F.min("row").alias("g"), F.count("*").alias("members")).where("members > 1").select("n", "gid", "g")
    member = materialize(classes.join(several, ["n", "gid"], "left").withColumn("g", F.coalesce("g", "row")), "members", narrow=True)
    cluster = clusters(every, member, percent, bands)
    # a group of several is a cluster even where it meets no other
    placed = member.join(cluster, "g", "left").select("n", "d1", "d2", "rep", "weight", F.coalesce("comp", "g").alias("comp"))
    placed = materialize(placed, "placed", narrow=True)
    many = placed.groupBy("comp").agg(F.count("*").alias("classes")).where("classes > 1").select("comp")
    found = materialize(links(placed.join(many, "comp", "left_semi"), docs, level, size, percent), "links", narrow=True)

    key = F.struct("n", "d1", "d2")
    versions = named.groupBy("doc_id").agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low != high").select("doc_id")
    versions = named.join(versions, "doc_id", "left_semi").select("doc_id", "n", "d1", "d2").join(placed.select("n", "d1", "d2", "rep"), ["n", "d1", "d2"])
    edges = found.select(F.col("rep").alias("a"), F.col("root").alias("b")).union(versions.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    comp = components(edges)
    times = found.groupBy("n", "d1", "d2").agg(F.sum("times").alias("times"))
    reps = placed.select("n", "d1", "d2", "rep", "weight").join(comp.withColumnRenamed("id", "rep"), "rep", "left").join(times, ["n", "d1", "d2"], "left")
    reps = reps.select("n", "d1", "d2", F.coalesce("component", "rep").alias("component"), (F.col("weight") - 1 + F.coalesce("times", F.lit(0))).alias("n_links"))
    out = every.select("doc_id", "n", "d1", "d2").join(reps, ["n", "d1", "d2"], "left")
    n_links = F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0)))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), n_links.alias("n_links"))


def one_of_each(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs, all columns, with only the smallest doc_id of each component; of rows that repeat it, the first by text. Rows without a doc_id stay."""
    go = materialize(link(docs, size, percent).where("component_id < doc_id").select(F.col("doc_id").alias("goes")).distinct(), "goes", narrow=True)
    out = docs.join(small(go), F.col("doc_id") == F.col("goes"), "left_anti")
    twice = docs.where("doc_id is not null").groupBy(F.col("doc_id").alias("repeated")).count().where("count > 1").select("repeated")
    twice = materialize(twice, "repeated", narrow=True)
    if not twice.limit(1).count():
        return out
    here = F.col("doc_id") == F.col("repeated")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    first = out.join(small(twice), here, "left_semi").withColumn("row_rank", rank).where("row_rank = 1").drop("row_rank")
    return out.join(small(twice), here, "left_anti").unionByName(first)
