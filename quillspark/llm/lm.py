"""Language-model scores: prediction by partial matching over bytes, and a word unigram base.

The trie holds contexts of up to ORDER bytes, counted over all training documents.
Escape is method C (distinct / (total + distinct)); a lower level's symbols that the
higher one has seen are excluded, and its rest is scaled up to one. A text's score is the
log10 probability of its bytes and its end, A-Z in lower case; bits_per_byte is its
code length. Every (context, symbol) pair that occurs is kept, in distributed tables: the
levels are built by joins, each key that occurs in a document gets its log10 probability,
and the most frequent keys are sent to the workers as a cache; all others are joined.
`adaptive_bits` codes one text with a model that learns as it goes.

Documents train unless crc32(doc_id as text) mod 10 is 0 (a null doc_id trains).
Null text counts as empty: its only token is the end. Repeated rows count as often
as they occur and get equal scores. Without training documents every byte costs
eight bits and base_score is that of V = N = 0.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, tidy
from quillspark.llm.words import _LOWER, Words, buffers, chunks

ORDER, STOP = 5, 0xFF
#: Most (context, symbol) keys and most words that are sent to the workers; the others are joined, with the same result.
HOT_KEYS, HOT_WORDS = 1 << 21, 1 << 19
#: Key of the end token, which no word can hash to but by chance of 2 ** -64.
END_KEY = 0x0E4D0E4D0E4D0E4D
SMOOTH = 0.1


def padded(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with ORDER stops before and after each text, A-Z lowered; positions to score; their count per text)."""
    n = np.diff(offsets)
    rows = len(n)
    out = np.full(int(offsets[-1]) + ORDER * (rows + 1), STOP, np.uint8)
    shift = np.repeat(ORDER * (np.arange(rows) + 1), n)
    out[np.arange(len(raw)) + shift] = _LOWER[raw]
    size = n + 1
    begin = offsets[:-1] + ORDER * (np.arange(rows) + 1)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin, size)
    return out, at, size


def grams(b: np.ndarray) -> np.ndarray:
    """The ORDER bytes before each position and its own as one number, for positions from ORDER on."""
    key = np.zeros(max(len(b) - ORDER, 0), np.int64)
    for k in range(ORDER + 1):
        key <<= 8
        key |= b[k : len(b) - ORDER + k]
    return key


def tail(key: np.ndarray, order: int) -> np.ndarray:
    return key & ((1 << 8 * (order + 1)) - 1)


class Table:
    """A hash table from numbers to floats with open addressing, all keys at once."""

    def __init__(self, key: np.ndarray, value: np.ndarray):
        self.bits = max(4, int(max(len(key), 1)).bit_length() + 1)
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.value = np.zeros(1 << self.bits, np.float32)
        left, at = np.arange(len(key)), self._home(key)
        while len(left):
            free = self.key[at] < 0
            self.key[at[free]] = key[left[free]]  # of several for one place, the last stays
            done = self.key[at] == key[left]
            self.value[at[done]] = value[left[done]]
            left, at = left[~done], (at[~done] + 1) & ((1 << self.bits) - 1)

    def _home(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found); 0 where not found."""
        at = self._home(key)
        there = self.key[at]
        found = there == key
        value = self.value[at].astype(np.float64)
        todo = np.flatnonzero(~found & (there >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            there = self.key[at[todo]]
            hit = there == key[todo]
            found[todo[hit]] = True
            value[todo[hit]] = self.value[at[todo[hit]]]
            todo = todo[~hit & (there >= 0)]
        value[~found] = 0.0
        return value, found


@dataclass
class Trie:
    row: np.ndarray  # of each two-byte context in `second`; -1: never seen
    first: np.ndarray  # 256 x 256, distribution after one byte
    second: np.ndarray  # distribution after two bytes, a row for each that occurs
    pairs: dict[int, Table]  # by order, from 3: log10 probability of (context, symbol) that were seen
    escape: dict[int, Table]  # log10 of what a context leaves to the level below, per unit of probability there

    def log10(self, key: np.ndarray, order: int) -> np.ndarray:
        """log10 probability of each number's last byte after the `order` bytes before it."""
        if order == 2:
            row, s = self.row[key >> 8 & 0xFFFF], key & 255
            p = self.first[key >> 8 & 255, s]
            seen = row >= 0
            p[seen] = self.second[row[seen], s[seen]]
            return np.log10(np.maximum(p.astype(np.float64), 1e-30))
        value, found = self.pairs[order].get(key)
        out = np.flatnonzero(~found)
        if len(out):
            value[out] = self.escape[order].get(key[out] >> 8)[0] + self.log10(tail(key[out], order - 1), order - 1)
        return value


def _blend(count: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Distributions of one level from its counts and the level below, seen symbols excluded there."""
    seen = count > 0
    total, distinct = count.sum(-1, keepdims=True), seen.sum(-1, keepdims=True)
    rest = np.where(seen, 0.0, lower).sum(-1, keepdims=True)
    full = np.maximum(total + np.where(rest > 0, distinct, 0), 1)
    scale = np.where(rest > 0, distinct / full, 0.0) / np.where(rest > 0, rest, 1.0)
    out = np.where(seen, count / full, lower * scale)
    return np.where(total > 0, out, lower)


def build(levels: dict[int, tuple[np.ndarray, np.ndarray]]) -> Trie:
    """levels: by order from 2, (context * 256 + symbol, count)."""
    keys, n = levels[2]
    ctx = np.unique(keys >> 8)
    row = np.full(1 << 16, -1, np.int32)
    row[ctx] = np.arange(len(ctx))
    c2 = np.zeros((len(ctx), 256))
    np.add.at(c2, (row[keys >> 8], keys & 255), n)
    c1 = np.zeros((256, 256))
    np.add.at(c1, ctx & 255, c2)
    zero = _blend(c1.sum(0), np.full(256, 1 / 256))
    first = _blend(c1, np.broadcast_to(zero, (256, 256)))
    second = np.empty((len(ctx), 256), np.float32)
    for i in range(0, len(ctx), 4096):
        second[i : i + 4096] = _blend(c2[i : i + 4096], first[ctx[i : i + 4096] & 255])
    trie = Trie(row, first.astype(np.float32), second, {}, {})
    for order in range(3, max(levels) + 1):
        keys, n = levels[order]
        ctx, at = np.unique(keys >> 8, return_inverse=True)
        total, distinct = np.bincount(at, n, len(ctx)), np.bincount(at, minlength=len(ctx))
        below = 10.0 ** trie.log10(tail(keys, order - 1), order - 1) if len(keys) else np.zeros(0)
        rest = 1 - np.bincount(at, below, len(ctx))
        full = total + np.where(rest > 1e-6, distinct, 0)
        trie.pairs[order] = Table(keys, np.log10(n / full[at]))
        trie.escape[order] = Table(ctx, np.where(rest > 1e-6, np.log10(distinct / full / np.maximum(rest, 1e-6)), -30.0))
    return trie


def log_probability(trie: Trie | None, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 probability of each text and its end."""
    b, at, size = padded(raw, offsets)
    if trie is None:
        return -math.log10(256) * size
    return np.add.reduceat(trie.log10(grams(b)[at - ORDER], ORDER), np.cumsum(size) - size)


def adaptive_bits(text: str, order: int = 3) -> float:
    """Code length in bits of one text under a model that starts empty and learns each byte: escape C with symbol exclusion."""
    data = text.encode() + bytes((STOP,))
    nodes: dict[bytes, dict[int, int]] = {}
    bits = 0.0
    for i, s in enumerate(data):
        excluded: set[int] = set()
        p = 1.0
        for k in range(min(order, i), -1, -1):
            node = nodes.get(data[i - k : i])
            if not node:
                continue
            live = {x: n for x, n in node.items() if x not in excluded}
            if not live:
                continue
            total, distinct = sum(live.values()), len(live)
            if s in live:
                p *= live[s] / (total + distinct)
                break
            p *= distinct / (total + distinct)
            excluded |= live.keys()
        else:
            p *= 1 / (256 - len(excluded))
        bits -= math.log2(p)
        for k in range(min(order, i), -1, -1):
            node = nodes.setdefault(data[i - k : i], {})
            node[s] = node.get(s, 0) + 1
    return bits


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0, F.lit(False))


_BATCH = 1 << 23


def counts(docs: DataFrame) -> DataFrame:
    """(kind, key, n, m) of (held, text): 0 words and the end, 1 symbols with the ORDER bytes before them; n counts training texts, m (for symbols) all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(kind: int, key: np.ndarray, n: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in (key, n, m))], ["kind", "key", "n", "m"])

        for batch in batches:
            for held in (False, True):
                b = batch.filter(pc.equal(batch.column(0), held))
                raw, offsets = buffers(b.column(1))
                for i, j in chunks(offsets, _BATCH):
                    words, bytes_ = [], []
                    for k, m in chunks(offsets[i : j + 1]):
                        part, at = raw[offsets[i + k] : offsets[i + m]], offsets[i + k : i + m + 1] - offsets[i + k]
                        if not held:
                            words.append(Words(part, at, lower=True).hash)
                        text, where, _ = padded(part, at)
                        bytes_.append(grams(text)[where - ORDER])
                    key, n = np.unique(np.concatenate(bytes_), return_counts=True)
                    yield out(1, key, n * (not held), n)
                    if not held:
                        key, n = np.unique(np.concatenate(words), return_counts=True)
                        yield out(0, key.view(np.int64), n, n)
                        yield out(0, np.array([END_KEY], np.int64), np.array([j - i]), np.array([j - i]))

    return docs.mapInArrow(tidy(run), "kind int, key long, n long, m long").groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _columns(df: DataFrame, *names: str) -> list[np.ndarray]:
    got = df.select(*names).toArrow()
    return [got.column(k).to_numpy() for k in range(len(names))]


def _low(name: str, order: int) -> Column:
    """The last `order` bytes and the symbol of a key."""
    return F.col(name).bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))


def values(keys: DataFrame) -> DataFrame:
    """(key, m, value) of every (key, n, m): log10 probability of a key's symbol after its ORDER bytes, from the counts n of all keys.

    A level's contexts hold the values of all their symbols; a level is built from the one below by a join on
    the shorter context. No table is bounded but those of up to two bytes, which are complete.
    """
    spark = keys.sparkSession
    seen = keys.where("n > 0")
    key, n = _columns(seen.groupBy(_low("key", 2).alias("key")).agg(F.sum("n").alias("n")), "key", "n")
    keep = np.argsort(key)
    base = spark.sparkContext.broadcast(build({2: (key[keep], n[keep])}))

    @F.pandas_udf("double")
    def short(k: pd.Series) -> pd.Series:
        return pd.Series(base.value.log10(k.to_numpy(np.int64), 2))

    levels: dict[int, DataFrame] = {}
    for order in range(3, ORDER + 1):
        pairs = seen.groupBy(_low("key", order).alias("key")).agg(F.sum("n").alias("n"))
        if order == 3:
            pairs = pairs.withColumn("below", short(_low("key", 2)))
        else:
            lower = levels[order - 1].select(F.explode("symbols").alias("x")).select(F.col("x.key").alias("lower"), F.col("x.value").alias("below"))
            pairs = pairs.join(lower, _low("key", order - 1) == F.col("lower"))
        of = pairs.groupBy(F.shiftright("key", 8).alias("ctx")).agg(
            F.sum("n").alias("total"), F.count("*").alias("distinct"), (1 - F.sum(F.pow(F.lit(10.0), F.col("below")))).alias("rest"), F.collect_list(F.struct("key", "n")).alias("pairs")
        )
        left = F.col("rest") > 1e-6
        full = F.col("total") + F.when(left, F.col("distinct")).otherwise(0)
        escape = F.when(left, F.log10(F.col("distinct") / F.col("full") / F.col("rest"))).otherwise(-30.0)
        symbols = F.transform("pairs", lambda p: F.struct(p["key"].alias("key"), F.log10(p["n"] / F.col("full")).alias("value")))
        levels[order] = materialize(of.withColumn("full", full).select("ctx", escape.alias("escape"), symbols.alias("symbols")), f"lm-order{order}")

    # keys that no training text has: at each order, the value of the symbol or the escape
    new = keys.where("n = 0").select("key", "m", F.lit(0.0).alias("value"), F.lit(False).alias("done"))
    for order in range(ORDER, 2, -1):
        new = new.withColumn("ctx", F.shiftright(_low("key", order), 8)).join(levels[order], "ctx", "left")
        mine = _low("key", order)
        hit = F.filter("symbols", lambda x: x["key"] == mine)
        found = F.coalesce(F.size(hit) > 0, F.lit(False))
        more = F.when(F.col("done"), 0.0).when(found, F.get(hit, F.lit(0))["value"]).otherwise(F.coalesce("escape", F.lit(0.0)))
        new = new.select("key", "m", (F.col("value") + more).alias("value"), (F.col("done") | found).alias("done"))
    new = new.withColumn("short", short(_low("key", 2)))
    new = new.select("key", "m", (F.col("value") + F.when(F.col("done"), 0.0).otherwise(F.col("short"))).alias("value"))
    top = levels[ORDER].select(F.explode("symbols").alias("x")).select("x.key", "x.value")
    return seen.select("key", "m").join(top, "key").union(new)


def hottest(words: DataFrame, most: int = HOT_WORDS, n: str = "n") -> DataFrame:
    """The words from that count on which lets at most `most` through; by counts of counts, so nothing is sorted."""
    level = F.floor(F.log2(n) * 16).cast("int")
    by = sorted(((r["level"], r["count"]) for r in words.groupBy(level.alias("level")).count().collect()), reverse=True)
    cut, sum_ = None, 0
    for value, count in by:
        if sum_ + count > most:
            break
        cut, sum_ = value, sum_ + count
    return words.where(level >= cut) if cut is not None else words.where(F.lit(False))


def _lists(row: np.ndarray, key: np.ndarray, rows: int) -> list[pa.ListArray]:
    """(distinct keys, how often) of each row as lists."""
    order = np.lexsort((key, row))
    r, k = row[order], key[order]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (k[1:] != k[:-1])])) if len(r) else np.zeros(0, np.int64)
    cut = np.searchsorted(r[new], np.arange(rows + 1)).astype(np.int32)
    times = np.diff(np.append(new, len(r)))
    return [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int64))) for x in (k[new], times)]


def score(docs: DataFrame, hot_words: int = HOT_WORDS, hot_keys: int = HOT_KEYS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every document."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).alias("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text)
    found = materialize(counts(rows.select(held_out().alias("held"), "text")), "lm-counts")
    words = found.where("kind = 0").select("key", "n")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).head()
    least = math.log10(SMOOTH / (total + SMOOTH * (distinct + 1)))
    keys = found.where("kind = 1").select("key", "n", "m")
    if total:
        valued = materialize(values(keys), "lm-values")
        top, worth = _columns(hottest(valued, hot_keys, "m"), "key", "value")
        cache = Table(top, worth)
    else:  # no training text: every byte costs eight bits
        valued, cache = keys.select("key", "m", F.lit(0.0).alias("value")), None
    key, n = _columns(hottest(words, hot_words), "key", "n")
    order = np.argsort(key)
    shared = spark.sparkContext.broadcast((cache, key[order], np.log10((n[order] + SMOOTH) / (total + SMOOTH * (distinct + 1)))))
    names = ["rid", "doc_id", "n_tokens", "hot", "hot_sum", "hot_score", "n_bytes", "cold", "times", "cold_keys", "key_times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, key, value = shared.value
        for b in batches:
            raw, offsets = buffers(b.column("text"))
            for i, j in chunks(offsets):
                part, at = raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                w = Words(part, at, lower=True)
                row = np.concatenate([w.row(), np.arange(j - i)])
                mine = np.concatenate([w.hash.view(np.int64), np.full(j - i, END_KEY, np.int64)])
                place = np.minimum(np.searchsorted(key, mine), max(len(key) - 1, 0))
                hit = key[place] == mine if len(key) else np.zeros(len(mine), bool)
                hot = np.bincount(row[hit], minlength=j - i)
                hot_sum = np.bincount(row[hit], value[place[hit]], j - i) if len(key) else np.zeros(j - i)
                cold = _lists(row[~hit], mine[~hit], j - i)
                text, where, size = padded(part, at)
                if cache is None:
                    hot_score, cold_keys = -math.log10(256) * size, _lists(np.zeros(0, np.int64), np.zeros(0, np.int64), j - i)
                else:
                    gram = grams(text)[where - ORDER]
                    worth, there = cache.get(gram)
                    hot_score = np.add.reduceat(np.where(there, worth, 0.0), np.cumsum(size) - size)
                    cold_keys = _lists(np.repeat(np.arange(j - i), size)[~there], gram[~there], j - i)
                cols = (w.count() + 1, hot, hot_sum, hot_score, np.diff(at))
                yield pa.RecordBatch.from_arrays([b.column("rid").slice(i, j - i), b.column("doc_id").slice(i, j - i), *map(pa.array, cols), *cold, *cold_keys], names)

    schema = "rid long, doc_id long, n_tokens long, hot long, hot_sum double, hot_score double, n_bytes long, cold array<long>, times array<long>, cold_keys array<long>, key_times array<long>"
    scored = materialize(rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(tidy(run), schema), "lm-scored")

    def listed(kind: int, keys: str, times: str) -> DataFrame:
        return scored.select("rid", F.explode(F.arrays_zip(keys, times)).alias("x")).select("rid", F.lit(kind).alias("kind"), F.col(f"x.{keys}").alias("key"), F.col(f"x.{times}").alias("times"))

    worth = F.log10((F.col("n") + SMOOTH) / F.lit(total + SMOOTH * (distinct + 1)))
    known = words.select(F.lit(0).alias("kind"), "key", worth.alias("value")).union(valued.select(F.lit(1).alias("kind"), "key", "value"))
    joined = listed(0, "cold", "times").union(listed(1, "cold_keys", "key_times")).join(known, ["kind", "key"], "left")
    word = F.col("kind") == 0
    rest = joined.groupBy("rid").agg(
        F.sum(F.when(word & F.col("value").isNotNull(), F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.when(word, F.col("times") * F.coalesce("value", F.lit(least))).otherwise(0.0)).alias("cold_sum"),
        F.sum(F.when(~word, F.col("times") * F.col("value")).otherwise(0.0)).alias("cold_score"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    scored = scored.drop("cold", "times", "cold_keys", "key_times").join(rest, "rid", "left").withColumn("score", F.col("hot_score") + zero("cold_score"))
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        "n_tokens",
        (F.col("hot") + zero("known")).alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + zero("cold_sum")).alias("base_score"),
        "score",
        (-F.col("score") * math.log2(10) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
