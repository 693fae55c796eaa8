"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are byte 3- and 4-grams of the lower-cased text whose ASCII non-letters
are spaces. Embeddings and softmax are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled rows; a temperature and a
rejection threshold are set on a part of that sample kept apart.

Null text, or text without a letter, is `und` with score 0 and rejected. Rows
without a language teach nothing; without any labelled row all rows are `und`.
Ties go to the first language in order. Repeated rows get equal answers. An empty
table gives an empty one; extra columns are ignored (`keep` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import tidy, trim
from quillspark.llm.words import buffers, chunks

BUCKET_BITS, DIM = 16, 16
#: Labelled rows that the model may be fitted on, over all languages together.
SAMPLE_ROWS, LEAST_PER_LANG = 3000, 30
#: Characters of such a row that are learned from; predictions read whole texts.
SAMPLE_CHARS = 200_000
#: Share of correct, kept-apart rows that rejection may cost.
REJECT_SHARE = 0.001
#: Bytes of a text that are scored at once.
SPAN = 1 << 20
_ASCII_LETTER = re.compile("[A-Za-z]")
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[i for i in range(128) if not chr(i).isalpha()]] = 0x20


def has_letter(text: str) -> bool:
    """Whether a character is a letter (of a Unicode category L; digits, fractions and letter numbers are none)."""
    return bool(_ASCII_LETTER.search(text)) or not text.isascii() and any(map(str.isalpha, text))


def subwords(raw: np.ndarray, bits: int = BUCKET_BITS) -> list[np.ndarray]:
    """Bucket of the 3-gram and of the 4-gram that begin at each byte."""
    b = _CLASS[raw].astype(np.uint32)
    shift = np.uint32(32 - bits)
    with np.errstate(over="ignore"):
        tri = b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)
        four = (tri[:-1] ^ (tri[:-1] >> np.uint32(15))) * np.uint32(0x27D4EB2F) + b[3:] * np.uint32(0x165667B1)
        mixed = [(x ^ (x >> np.uint32(13))) * np.uint32(0x5BD1E995) >> shift for x in (tri, four)]
    return mixed


def bags(texts: list[str], bits: int = BUCKET_BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text."""
    out = []
    for t in texts:
        raw = np.frombuffer(f"  {t.lower()}  ".encode(), np.uint8)
        b, c = np.unique(np.concatenate(subwords(raw, bits)), return_counts=True)
        out.append((b.astype(np.int64), (c / c.sum()).astype(np.float32)))
    return out


@dataclass
class Model:
    langs: list[str]
    weight: np.ndarray  # embeddings times softmax weights: bucket x language
    bias: np.ndarray
    temperature: float
    threshold: float


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _crops(texts: list[str], langs: list[int], rng: np.random.Generator) -> tuple[list[str], list[int]]:
    """The texts, and of each a few runs of words, so that short texts are known and honest scores are learned for them."""
    out, y = list(texts), list(langs)
    for t, k in zip(texts, langs, strict=True):
        ws = t.split()
        for size in (2, 6, 25):
            if len(ws) > size:
                i = int(rng.integers(0, len(ws) - size))
                out.append(" ".join(ws[i : i + size]))
                y.append(k)
    return out, y


def fit(texts: list[str], langs: list[str], bits: int = BUCKET_BITS, dim: int = DIM, epochs: int = 8, rate: float = 0.5, seed: int = 7) -> Model:
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    usable = [i for i, t in enumerate(texts) if has_letter(t)]
    y0 = [names.index(langs[i]) for i in usable]
    apart = rng.random(len(usable)) < 0.2 if len(usable) >= 50 else np.zeros(len(usable), bool)
    part = lambda keep: _crops([texts[usable[i]] for i in np.flatnonzero(keep)], [y0[i] for i in np.flatnonzero(keep)], rng)
    train, y = part(~apart)
    emb = rng.normal(0, 0.1, (1 << bits, dim)).astype(np.float32)
    soft = rng.normal(0, 0.1, (dim, len(names))).astype(np.float32)
    bias = np.zeros(len(names), np.float32)
    xs, y = bags(train, bits), np.array(y)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for rows in np.array_split(rng.permutation(len(xs)), max(1, len(xs) // 8)):
            if not len(rows):
                continue
            idx = np.concatenate([xs[r][0] for r in rows])
            share = np.concatenate([xs[r][1] for r in rows])
            begin = np.cumsum([0] + [len(xs[r][0]) for r in rows[:-1]])
            hidden = np.add.reduceat(emb[idx] * share[:, None], begin)
            err = _softmax(hidden @ soft + bias)
            err[np.arange(len(rows)), y[rows]] -= 1
            back = (err @ soft.T)[np.repeat(np.arange(len(rows)), np.diff([*begin, len(idx)]))] * share[:, None]
            soft -= step * hidden.T @ err / len(rows)
            bias -= step * err.mean(axis=0) * 0.1
            np.subtract.at(emb, idx, 40 * step * back / len(rows) ** 0.5)  # shares are small, so embeddings take longer steps
    weight = emb @ soft
    model = Model(names, weight, bias, 1.0, 0.0)
    held, yh = part(apart) if apart.any() else (train, list(y))
    z = np.array([(weight[b] * s[:, None]).sum(0) + bias for b, s in bags(held, bits)]) if held else np.zeros((0, len(names)))
    if len(z) and len(names) > 1:
        yh = np.array(yh)
        loss = lambda t: -np.log(_softmax(z / t)[np.arange(len(yh)), yh] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
        p = _softmax(z / model.temperature)
        right = p.max(1)[p.argmax(1) == yh]
        model.threshold = float(min(0.5, np.quantile(right, REJECT_SHARE))) if len(right) else 0.0
    return model


def predict(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(language, score, accepted) of each text, every byte of which counts."""
    strings = [t or "" for t in texts.to_pylist()]
    known = np.array([has_letter(t) for t in strings], bool)
    raw, offsets = buffers(pa.array([f"  {t.lower()}  " for t in strings], pa.large_string()))
    score, best = np.zeros(len(strings)), np.zeros(len(strings), np.int64)
    bits = int(np.log2(len(model.weight)))
    for i, j in chunks(offsets):
        at = offsets[i : j + 1] - offsets[i]
        n, total = np.diff(at), np.zeros((j - i, model.weight.shape[1]))
        for s in range(0, int(at[-1]), SPAN):  # one text may be long
            e = min(s + SPAN, int(at[-1]))
            row = np.searchsorted(at, [s, e - 1], "right") - 1
            cut = np.maximum(at[row[0] : row[1] + 1], s) - s
            for k, b in zip((3, 4), subwords(raw[offsets[i] + s : offsets[i] + min(e + 3, int(at[-1]))], bits), strict=True):
                w = np.zeros((e - s, model.weight.shape[1]), np.float32)
                w[: len(b)] = model.weight[b[: e - s]]
                stop = at[row[0] + 1 : row[1] + 2] - s
                for back in range(1, k):  # those that reach into the next text
                    w[(stop - back)[(stop >= back) & (stop - back < e - s)]] = 0
                total[row[0] : row[1] + 1] += np.add.reduceat(w, cut, dtype=np.float64)
        p = _softmax((total / (2 * n - 5)[:, None] + model.bias) / model.temperature)
        best[i:j], score[i:j] = p.argmax(1), p.max(1)
    score = np.where(known, score, 0.0)
    langs = [model.langs[k] if ok else "und" for k, ok in zip(best.tolist(), known, strict=True)]
    return langs, score, known & (score >= model.threshold)


def sample(labelled: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """A bounded sample of (text, lang), spread evenly over the languages, the same at every run: `rows` rows of up to `chars` characters.

    Each language's rows are those of least hash; counts give a limit that leaves few more than wanted, so only these are ranked.
    """
    ids = labelled.select("doc_id", "lang", F.xxhash64("doc_id").alias("h")).where("lang is not null and doc_id is not null")
    counts = {r["lang"]: r["n"] for r in ids.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row per language
    if not counts:
        return [], []
    most = max(LEAST_PER_LANG, rows // len(counts))
    limit = {lang: min(1.0, (most + 4 * most**0.5) / n) for lang, n in counts.items()}
    limits = labelled.sparkSession.createDataFrame([(k, int(v * (1 << 40))) for k, v in limit.items()], "of string, below long")
    near = ids.join(F.broadcast(limits), F.col("lang") == F.col("of")).where(F.shiftrightunsigned("h", 24) < F.col("below"))
    near = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))).where(F.col("rank") <= most)
    chosen = near.select("doc_id").distinct()
    got = labelled.where("lang is not null").join(F.broadcast(chosen), "doc_id", "left_semi").select(F.substring("text", 1, chars).alias("text"), "lang", "doc_id").collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], r["text"] or ""))
    return [r["text"] or "" for r in got], [r["lang"] for r in got]


def classify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, text, lang_pred, score, accepted) for every row of (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                if shared.value is None:
                    langs, score, ok = ["und"] * part.num_rows, np.zeros(part.num_rows), np.zeros(part.num_rows, bool)
                else:
                    langs, score, ok = predict(shared.value, part.column("text"))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(score), pa.array(ok)], [*part.schema.names, "lang_pred", "score", "accepted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", lang_pred string, score double, accepted boolean"
    return docs.mapInArrow(tidy(run), schema)


def keep(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose language the model accepts; all rows with a letter if there is no model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                if shared.value is None:
                    ok = np.array([bool(t) and has_letter(t) for t in part.column(at).to_pylist()], bool)
                else:
                    ok = predict(shared.value, part.column(at))[2]
                yield part.filter(pa.array(ok))

    return docs.mapInArrow(tidy(run), docs.schema)


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS) -> Model | None:
    """The model of documents that are not held out; None if none of them has a language."""
    texts, langs = sample(docs.select("doc_id", "text", "lang").where(~held_out()), rows)
    model = fit(texts, langs) if any(has_letter(t) for t in texts) else None
    trim()  # what the fit took is not kept by the driver
    return model


def identify(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, accepted) of every document."""
    model = train(docs, rows)
    scored = classify(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")
