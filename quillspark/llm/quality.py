"""Quality classification: ordinal cumulative-link regression on graded ratings.

Grades: 0 toxic, 1 neither toxic nor good, 2 good. All thresholds share one weight
vector over hashed text features (words, runs of symbols by their share, and a few
shape figures by bucket): P(grade <= k) = sigmoid(t_k - w.x). Fitted on every labelled
row: counts, gradients and tail probabilities are summed by the executors, and only
sums (by feature, by bin) go to the driver, which takes L-BFGS steps. A quarter of the
rows, by hash of doc_id, is kept apart; the selection threshold is set on all of these,
so that at most KEEP_LOSS of their good documents go. What rows add to a sum is rounded
to 2^-24, so sums are the same in any order and reruns agree.

Null or empty text, or text without a word, is never selected. Labels without a
document, or without a quality, teach nothing; a missing toxic counts as 0. Without
any labels nothing can be told apart and every document with a word is selected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize, small, tidy, two
from quillspark.llm.words import Words, buffers, chunks, mix

BITS, GRADES = 18, 3
#: One labelled row in so many is kept apart for the threshold.
APART = 4
#: Share of good, kept-apart rows that selection may lose.
KEEP_LOSS = 0.002
#: Weight of the penalty, sums that descent may ask for, rows that a feature must be in.
RIDGE, ROUNDS, LEAST = 5e-3, 60, 3
_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[[i for i in range(128) if not chr(i).isalpha()]] = 0x20
_SYMBOLS = np.full(256, 0x20, np.uint8)
for _c in map(ord, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"):
    _SYMBOLS[_c] = _c
_SHARES = np.array([0.002, 0.01, 0.03, 0.1, 0.25, 0.5])


def _shape(key: int, bucket: np.ndarray) -> np.ndarray:
    return mix((np.uint64(key) << np.uint64(32)) + bucket.astype(np.uint64))


def features(texts: pa.Array, bits: int = BITS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, row, bucket, words per row) in pieces: the distinct features of rows i..j, by row."""
    plain = texts.to_pylist()
    cased, before = buffers(texts)
    caps = np.concatenate([[0], np.cumsum((cased >= 65) & (cased <= 90))])
    upper = np.diff(caps[before]) / np.maximum(np.diff(before), 1)
    raw, offsets = buffers(pa.array([(t or "").lower() for t in plain], pa.large_string()))
    for i, j in chunks(offsets):
        part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        w, s = Words(_LETTERS[part], at), Words(_SYMBOLS[part], at)
        n = w.count()
        some = np.maximum(n, 1)
        row, key = [w.row()], [w.hash]
        if len(s.hash):  # a run of symbols counts by its share of the words
            both, inverse, times = np.unique(np.stack([s.row().astype(np.uint64), s.hash]), axis=1, return_inverse=True, return_counts=True)
            r = both[0].astype(np.int64)
            row.append(r)
            key.append(mix(both[1] + np.searchsorted(_SHARES, times / some[r]).astype(np.uint64)))
        same = np.zeros(len(n))
        if len(w.hash) > 1:
            twin = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.row()[1:] == w.row()[:-1]))
            same = np.bincount(w.row()[twin], minlength=len(n)) / some
        length = np.bincount(w.row(), w.end - w.start, len(n)) / some
        for k, v in ((1, np.searchsorted(_SHARES, same)), (2, np.searchsorted(_SHARES, upper[i:j])), (3, np.minimum(length, 15).astype(np.int64)), (4, np.log2(some).astype(np.int64))):
            row.append(np.arange(len(n)))
            key.append(_shape(k, np.asarray(v)))
        one = np.unique(np.concatenate(row).astype(np.uint64) << np.uint64(bits) | np.concatenate(key) >> np.uint64(64 - bits))
        yield i, j, (one >> np.uint64(bits)).astype(np.int64), (one & np.uint64((1 << bits) - 1)).astype(np.int64), n


@dataclass
class Model:
    weight: np.ndarray
    cuts: np.ndarray  # ascending
    threshold: float

    def tails(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a column each."""
        return 1 / (1 + np.exp(np.clip(self.cuts[None, :] - z[:, None], -40, 40)))


Sums = Callable[..., np.ndarray]


def telling(count: np.ndarray, n: np.ndarray, least: int, sigmas: float = 4.0) -> np.ndarray:
    """Features whose share differs between one grade and the others by `sigmas` standard errors; the rest are noise that long texts would add up. count: rows by grade and feature, n: rows by grade."""
    out = np.zeros(count.shape[1], bool)
    for g in range(len(n)):
        rest = n.sum() - n[g]
        if not n[g] or not rest:
            continue
        p = count.sum(0) / n.sum()
        z = np.abs(count[g] / n[g] - (count.sum(0) - count[g]) / rest) / np.sqrt(np.maximum(p * (1 - p), 1e-12) * (1 / n[g] + 1 / rest))
        out |= z >= sigmas
    return out & (count.sum(0) >= least)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gradient(index: np.ndarray, length: np.ndarray, grade: np.ndarray, w: np.ndarray, cuts: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Sums over rows, each with `length` features of `index`: of -log p by weight and by cut, and of -log p itself. Rows add multiples of 2^-24."""
    top = len(cuts)
    row = np.repeat(np.arange(len(length)), length)
    z = np.bincount(row, w[index], len(length))
    c = np.concatenate([[-np.inf], cuts, [np.inf]])
    hi = np.where(grade < top, _sigmoid(c[grade + 1] - z), 1.0)
    lo = np.where(grade > 0, _sigmoid(c[grade] - z), 0.0)
    between = 1 - np.exp(c[grade] - c[grade + 1])  # p = hi * (1 - lo) * between
    exact = lambda x: np.rint(scale[grade] * x * 2.0**24) / 2.0**24
    step = exact(1 - hi - lo)
    by_cut = np.zeros(top + 2)  # a grade's upper cut, and its lower one
    np.add.at(by_cut, grade + 1, -exact((1 - hi) / np.maximum((1 - lo) * between, 1e-18)))
    np.add.at(by_cut, grade, exact(lo / (hi * between)))
    loss = exact(-np.log(hi) - np.log(np.maximum(1 - lo, 1e-18)) - np.log(between))
    return np.concatenate([np.bincount(index, np.repeat(step, length), len(w)), by_cut[1:-1], [loss.sum()]])


def descend(sums: Sums, share: np.ndarray, grades: int, ridge: float, rounds: int, memory: int = 8, enough: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """(weights, ascending cuts) of the least mean of -log p and ridge / 2 * share * weight^2, by L-BFGS. sums: gradient by weight and cut, and the mean; share: rows that have a feature."""
    unit, k = np.sqrt(np.maximum(share, 1e-12)), len(share)

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:k] / unit, x[k] + np.concatenate([[0.0], np.cumsum(np.exp(np.clip(x[k + 1 :], -9, 9)))])

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, cuts = parts(x)
        s = sums(w, cuts)
        by_cut = s[k:-1]
        gaps = np.cumsum(by_cut[::-1])[::-1][1:] * np.diff(cuts)
        return s[-1] + ridge / 2 * float(x[:k] @ x[:k]), np.concatenate([s[:k] / unit + ridge * x[:k], [by_cut.sum()], gaps])

    x = np.concatenate([np.zeros(k), [-1.0], np.full(grades - 2, np.log(2.0 / max(1, grades - 2)))])
    f, g = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    asked, size = 1, 1 / max(1.0, float(np.abs(g).sum()))
    while asked < rounds and float(np.abs(g).max()) > enough:
        d, back = -g, []
        for s, y in reversed(past):
            back.append(float(s @ d) / float(s @ y))
            d = d - back[-1] * y
        if past:
            s, y = past[-1]
            d = d * (float(s @ y) / float(y @ y))
        for (s, y), a in zip(past, reversed(back), strict=True):
            d = d + (a - float(y @ d) / float(s @ y)) * s
        t, slope = size if not past else 1.0, float(g @ d)
        while asked < rounds:
            new, grad = value(x + t * d)
            asked += 1
            if new <= f + 1e-4 * t * slope:
                break
            t /= 4
        else:
            break
        s, y = t * d, grad - g
        if float(s @ y) > 1e-12 * float(y @ y):
            past = [*past, (s, y)][-memory:]
        done = f - new < 1e-7
        x, f, g = x + s, new, grad
        if done:
            break
    return parts(x)


def model(sums: Sums, count: np.ndarray, n: np.ndarray, tell: np.ndarray, ridge: float = RIDGE, rounds: int = ROUNDS) -> Model:
    """A model, its threshold not yet set, from the sums (of weights, cuts and the grades' weights) over rows of telling features."""
    scale = n.sum() / np.maximum(n, 1) / max(1, int((n > 0).sum()))  # grades weigh alike
    w, cuts = descend(lambda w, cuts: sums(w, cuts, scale) / n.sum(), count[:, tell].sum(0) / n.sum(), len(n), ridge, rounds)
    weight = np.zeros(len(tell), np.float32)
    weight[tell] = w
    return Model(weight, cuts, 0.5)


#: The bits of a probability above these name its bin: 2^12 bins to each power of two.
_BIN = 40


def bins(tail: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(tail, np.float64).view(np.int64) >> _BIN


def threshold(at: np.ndarray, rows: np.ndarray) -> float:
    """The greatest lower edge of a bin, 0.5 at most, under which KEEP_LOSS of all rows are. at: bins, rows: how many rows each has."""
    if not rows.sum():
        return 0.5
    order = np.argsort(at)
    k = int(np.searchsorted(np.cumsum(rows[order]), int(KEEP_LOSS * rows.sum()), "right"))
    return min(0.5, float((at[order][k : k + 1].astype(np.int64) << _BIN).view(np.float64)[0]))


def fit(rows: list[tuple[np.ndarray, int]], bits: int = BITS, grades: int = GRADES, ridge: float = RIDGE, rounds: int = ROUNDS, least: int = LEAST, seed: int = 5) -> Model:
    """Of (buckets, grade) in memory, as `train` does of a table."""
    apart = np.random.default_rng(seed).random(len(rows)) < 1 / APART
    use = [r for r, a in zip(rows, apart, strict=True) if not a] or rows
    index, length, grade = np.concatenate([b for b, _ in use]), np.array([len(b) for b, _ in use]), np.array([g for _, g in use])
    n = np.bincount(grade, minlength=grades)
    count = np.bincount(np.repeat(grade, length) << bits | index, minlength=grades << bits).reshape(grades, -1)
    tell = telling(count, n, least)
    index, length = narrowed(index, length, tell)
    out = model(lambda w, cuts, scale: gradient(index, length, grade, w, cuts, scale), count, n, tell, ridge, rounds)
    held = [b for (b, g), a in zip(rows, apart, strict=True) if a and g == grades - 1]
    if held:
        tail = out.tails(np.array([out.weight[b].sum() for b in held], float))[:, -1]
        out.threshold = threshold(*np.unique(bins(tail), return_counts=True))
    return out


def narrowed(index: np.ndarray, length: np.ndarray, tell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with their telling features only, numbered from 0."""
    keep = tell[index]
    row = np.repeat(np.arange(len(length)), length)
    return (np.cumsum(tell) - 1)[index[keep]], np.bincount(row[keep], minlength=len(length))


_HEAD = 4 * 2  # 16-bit units: how many of a row's features have each value above 16 bits


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, n, features) of every document: its words' number and its features, two bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                for i, j, row, bucket, n in features(part.column(1)):
                    heads = np.bincount(row * 4 + (bucket >> 16), minlength=4 * (j - i)).reshape(-1, 4)
                    cut = np.concatenate([[0], np.cumsum(heads.sum(1) + _HEAD)])
                    data, solid = np.empty(cut[-1], "<u2"), np.ones(cut[-1], bool)
                    at = cut[:-1, None] + np.arange(_HEAD)
                    data[at], solid[at] = heads.astype("<u4").view("<u2"), False
                    data[solid] = bucket & 0xFFFF
                    packed = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((2 * cut).astype(np.int32)), pa.py_buffer(data)])
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), packed], ["doc_id", "n", "features"])

    return two(docs).mapInArrow(tidy(run), "doc_id long, n long, features binary")


def unstored(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features, how many each row has) of a column that `stored` made."""
    _, off, data = column.cast(pa.large_binary()).buffers()
    cut = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    u = np.frombuffer(data, np.uint8)[cut[0] : cut[-1]].view("<u2") if len(column) else np.zeros(0, "<u2")
    solid = np.ones(len(u), bool)
    at = ((cut[:-1] - cut[0]) // 2)[:, None] + np.arange(_HEAD)
    solid[at] = False
    heads = np.ascontiguousarray(u[at]).view("<u4").astype(np.int64)
    high = np.repeat(np.tile(np.arange(4), len(column)), heads.ravel())
    return high << 16 | u[solid].astype(np.int64), heads.sum(1)


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade, apart) of every labelled document."""
    grade = F.when(F.coalesce("toxic", F.lit(0)) > 0, 0).when(F.col("quality") > 0, 2).otherwise(1)
    rows = labels.where("doc_id is not null and quality is not null").select("doc_id", grade.alias("grade")).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    return rows.withColumn("apart", F.pmod(F.xxhash64("doc_id"), F.lit(APART)) == 0)


def added(rows: DataFrame, add: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums): what `add` gives of a batch, summed by key over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, np.int64), np.zeros(0)
        for b in batches:
            k, v = add(b)
            keys, inverse = np.unique(np.concatenate([keys, k]), return_inverse=True)
            sums = np.bincount(inverse, np.concatenate([sums, v]), len(keys))
        for i in range(0, len(keys), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(keys[i : i + (1 << 16)]), pa.array(sums[i : i + (1 << 16)])], ["key", "value"])

    got = rows.mapInArrow(tidy(run), "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).toArrow()
    return got.column("key").to_numpy(), got.column("value").to_numpy()


def train(known: DataFrame, labels: DataFrame) -> Model | None:
    """Of the stored features of documents and all labels."""
    sc = known.sparkSession.sparkContext
    rows = materialize(known.join(small(graded(labels)), "doc_id").select("features", "grade", "apart"), "graded")
    size = (1 << BITS) + 1  # the last counts rows

    def counts(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        index, length = unstored(b.column(0))
        g = b.column(1).to_numpy().astype(np.int64)
        key, n = np.unique(np.concatenate([np.repeat(g, length) * size + index, g * size + size - 1]), return_counts=True)
        return key, n.astype(float)

    use = rows.where("not apart")
    keys, sums = added(use, counts)
    if not len(keys):  # none, or so few that all are kept apart
        use = rows
        keys, sums = added(use, counts)
        if not len(keys):
            return None
    count = np.zeros(GRADES * size)
    count[keys] = sums
    count = count.reshape(GRADES, size)
    count, n = count[:, :-1], count[:, -1]
    tell = telling(count, n, LEAST)
    sent = sc.broadcast(tell)

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, length = narrowed(*unstored(b.column(0)), sent.value)
            whole = [x.astype(t).tobytes() for x, t in ((index, "<i4"), (length, "<i4"), (b.column(1).to_numpy(), "<i4"))]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in whole], ["index", "length", "grade"])

    blocks = materialize(use.mapInArrow(tidy(narrow), "index binary, length binary, grade binary"), "graded-blocks")

    def sums_of(w: np.ndarray, cuts: np.ndarray, scale: np.ndarray) -> np.ndarray:
        at = sc.broadcast((w, cuts, scale))

        def add(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            total = 0.0
            for k in range(b.num_rows):
                total = total + gradient(*(np.frombuffer(c[k].as_py(), "<i4").astype(np.int64) for c in b.columns), *at.value)
            some = np.flatnonzero(total)
            return some, total[some]

        keys, sums = added(blocks, add)
        at.destroy()
        out = np.zeros(len(w) + len(cuts) + 1)
        out[keys] = sums
        return out

    out = model(sums_of, count, n, tell)
    ready = sc.broadcast(out)

    def tails(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        key, n = np.unique(bins(ready.value.tails(scores(b.column(0), ready.value))[:, -1]), return_counts=True)
        return key, n.astype(float)

    out.threshold = threshold(*added(rows.where(f"apart and grade = {GRADES - 1}"), tails))
    for x in (sent, ready):
        x.destroy()
    discard(rows, blocks)
    return out


def scores(column: pa.Array, m: Model) -> np.ndarray:
    index, length = unstored(column)
    return np.bincount(np.repeat(np.arange(len(length)), length), m.weight[index], len(length))


def grade(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, expected_grade, tail_1, tail_2, selected) of every document."""
    known = materialize(stored(docs), "quality-features")
    model = docs.sparkSession.sparkContext.broadcast(train(known, labels))
    names = ["doc_id", "expected_grade", "tail_1", "tail_2", "selected"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, n = model.value, b.column(1).to_numpy()
            tails = np.ones((len(n), GRADES - 1)) if m is None else m.tails(scores(b.column(2), m))
            keep = (n > 0) & (tails[:, -1] >= (m.threshold if m else 0))
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, (tails.sum(1), tails[:, 0], tails[:, 1], keep))], names)

    return known.mapInArrow(tidy(run), "doc_id long, expected_grade double, tail_1 double, tail_2 double, selected boolean")
