"""Document fingerprints: MinHash over word shingles, in vectorised numpy.

A shingle is five lower-cased (A-Z) words in a row; a shorter text is one shingle,
a text without words has the fingerprint of no shingle. Every permutation is a
universal hash (odd multiplier, offset, upper 32 of 64 bits), so equal texts have
equal fingerprints and the share of equal values estimates the Jaccard index.

Near copies are found in the whole corpus: texts that agree in a band of their
signatures meet in a Spark join, and their links are verified on whole shingle sets.

Null text counts as empty; repeated rows each get a row; an empty table gives an
empty one; extra columns are ignored. The next document of one whose doc_id other
rows share may be one of these; documents without one come last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, small, squeezed, tidy, two, unsqueezed
from quillspark.llm.words import Words, buffers, chunks, mix, windows

PERMUTATIONS, SHINGLE, SEED = 64, 5, 20
#: Texts that agree in a band of ROWS values meet; near copies share PERCENT of their shingles. Of pairs at 80 %, 16 bands miss 2 in 10,000.
ROWS, PERCENT = 4, 80
#: Small enough that a chunk's shingles stay in a core's cache.
CHUNK = 1 << 18


def permutations(k: int = PERMUTATIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    a, b = rng.integers(0, 1 << 63, (2, k), dtype=np.uint64)
    return a * np.uint64(2) + np.uint64(1), b


def shingles(w: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first[r]..first[r+1] per row): k words in a row, all words where there are fewer, none without words."""
    n = w.count()
    h, row, _ = windows(w.hash, w.first, k)
    for size in range(1, k):
        few = np.flatnonzero(n == size)
        if len(few):
            at = w.first[few]
            with np.errstate(over="ignore"):
                one = sum((w.hash[at + j] * np.uint64(2 * j + 3) for j in range(size)), np.zeros(len(few), np.uint64))
            h, row = np.concatenate([h, mix(one + np.uint64(size))]), np.concatenate([row, few])
    if (np.diff(row) < 0).any():
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, np.searchsorted(row, np.arange(w.rows + 1))


def signatures(texts: pa.Array, k: int = PERMUTATIONS, size: int = SHINGLE) -> np.ndarray:
    """A row of k 32-bit values for each text."""
    raw, offsets = buffers(texts)
    a, b = permutations(k)
    out = np.full((len(offsets) - 1, k), 0xFFFFFFFF, np.uint32)
    for i, j in chunks(offsets, CHUNK):
        h, first = shingles(Words(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True), size)
        full = np.flatnonzero(np.diff(first))
        if not len(full):
            continue
        buf = np.empty_like(h)
        with np.errstate(over="ignore"):
            for p in range(k):
                np.multiply(h, a[p], out=buf)
                buf += b[p]
                out[i + full, p] = np.minimum.reduceat(buf, first[full]) >> np.uint64(32)
    return out


def bands_of(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A hash of each band of each signature, different from band to band."""
    part = sig.reshape(len(sig), -1, rows).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, part.shape[1] + 1, dtype=np.uint64) << np.uint64(32), part.shape[:2])
    for r in range(rows):
        h = mix(h ^ part[:, :, r])
    return h


def classes(docs: DataFrame) -> DataFrame:
    """(near_of, near_id) of documents with a near copy of a smaller doc_id: the smallest doc_id that verified links lead to.

    Links are those of the band join: texts that share a band of their signatures and PERCENT of their shingles, checked on whole sets.
    """
    from quillspark.llm.jaccard import link  # which needs this module's shingles

    found = link(docs, SHINGLE, PERCENT, bands=True).where("component_id < doc_id")
    return materialize(found.groupBy(F.col("doc_id").alias("near_of")).agg(F.min("component_id").alias("near_id")), "near", narrow=True)


def as_hex(sig: np.ndarray) -> list[str]:
    raw = sig.astype(">u4").tobytes().hex()
    n = sig.shape[1] * 8
    return [raw[i : i + n] for i in range(0, len(raw), n)]


def fingerprints(docs: DataFrame, k: int = PERMUTATIONS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint): the signature as an array of k longs, for banding and search."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = signatures(b.column(1), k, size).astype(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, sig.size + 1, k, dtype=np.int32), pa.array(sig.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc_id", "signature"])

    return two(docs).mapInArrow(tidy(run), "doc_id long, signature array<long>")


def _neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text (squeezed), part, ghost: range parts of doc_id. Each part also holds, as a ghost, the document that follows its last in descending order.

    Rows that share a doc_id are in an order by a hash of their text, and so are those without one, which come last and have parts of their own by that hash.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    got, rows, named = docs.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 20_000), F.count("*"), F.count("doc_id")).head()
    cuts = np.unique(np.array([c for c in got or [] if c is not None], np.int64))
    unnamed = max(1, -(-(rows - named) * n // max(1, rows)))  # parts of documents without an id

    @F.pandas_udf("int")
    def part(ids: pd.Series, h: pd.Series) -> pd.Series:
        null = ids.isna().to_numpy()
        nth = ((h.to_numpy(np.int64) >> 32) + (1 << 31)) * unnamed >> 32
        return pd.Series(np.where(null, -1 - nth, np.searchsorted(cuts, ids.fillna(0).to_numpy(np.int64), "right")).astype(np.int32))

    hashed = docs.withColumn("h", F.xxhash64("text"))
    ids = hashed.select("doc_id", "h", part("doc_id", "h").alias("part"))
    tops = sorted((r["part"], tuple(r["top"])) for r in ids.groupBy("part").agg(F.max(F.struct("doc_id", F.bitwise_not("h").alias("h"))).alias("top")).collect())  # a row per part
    follows: dict[tuple, list[int]] = {}
    for (p, _), (_, (top, h)) in zip(tops, [tops[-1], *tops[:-1]], strict=True) if tops else []:
        follows.setdefault((top, ~h), []).append(p)
    rows = [(*k, v) for k, v in follows.items()] or [(None, None, [])]
    ghosts = F.broadcast(spark.createDataFrame(rows, "ghost_id long, ghost_h long, into array<int>"))
    placed = hashed.withColumn("part", part("doc_id", "h")).join(ghosts, (F.col("h") == F.col("ghost_h")) & F.col("doc_id").eqNullSafe(F.col("ghost_id")), "left")
    own = F.array(F.struct(F.col("part").alias("part"), F.lit(0).alias("ghost")))
    also = F.transform(F.coalesce("into", F.array().cast("array<int>")), lambda p: F.struct(p.alias("part"), F.lit(1).alias("ghost")))
    dealt = squeezed(placed.select("doc_id", "h", "text", F.concat(own, also).alias("at")))
    return (
        dealt.select("doc_id", "h", "text", F.explode("at").alias("at"))
        .select("doc_id", "h", "text", "at.part", "at.ghost")
        .repartitionByRange(n, "part")
        .sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), "h", "text")
    )


def edits(docs: DataFrame, k: int = PERMUTATIONS, size: int = SHINGLE) -> DataFrame:
    """Fingerprints of every text and of the text whose last half gives way to the next document's beginning; near_id: the class of near copies in the whole corpus."""
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def rows(ids: list, texts: list[str], parts: list, ghosts: list) -> pa.RecordBatch | None:
        at = [i for i in range(len(ids) - 1) if not ghosts[i] and parts[i + 1] == parts[i]]
        if not at:
            return None
        edited = []
        for i in at:
            half = len(texts[i]) // 2
            edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
        sig = signatures(pa.array(texts, pa.large_string()), k, size)
        new = signatures(pa.array(edited, pa.large_string()), k, size)
        here = sig[at]
        cols = [
            pa.array([ids[i] for i in at], pa.int64()),
            pa.array([len(texts[i]) for i in at], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
            pa.array(as_hex(here)),
            pa.array(as_hex(new)),
            pa.array((here == new).mean(1)),
            pa.array((here == sig[np.array(at) + 1]).mean(1)),
        ]
        return pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list, list, list] = ([], [], [], [])
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                more = part.column(0).to_pylist(), [t.decode() for t in unsqueezed(part.column(1).to_pylist())], part.column(2).to_pylist(), part.column(3).to_pylist()
                cols = tuple(h + c for h, c in zip(held, more, strict=True))
                if out := rows(*cols):
                    yield out
                held = tuple(c[-1:] for c in cols)

    near = classes(docs)
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    out = _neighbours(two(docs)).select("doc_id", "text", "part", "ghost").mapInArrow(tidy(run), schema)
    near = small(near)
    return out.join(near, F.col("doc_id") == F.col("near_of"), "left").select(*names, F.coalesce("near_id", "doc_id").alias("near_id"))
