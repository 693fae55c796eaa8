"""Personal data by weak supervision.

Strict patterns give the base spans (email, ip, card, phone), which always stay.
Every other word with a digit, and every name after a form of address, is a
candidate. Regex, checksum, gazetteer and context labelers vote on it (+, - or 0);
expectation-maximisation over the counts of vote patterns (3 ** labelers at most)
estimates how reliable each labeler is; the resulting posteriors, aggregated by a
bounded feature key, train a logistic span classifier, which alone decides.

Null text counts as empty; empty tables give empty results; repeated rows get
equal spans; extra columns are ignored (`redact` keeps them). Offsets are code
points, ends exclusive. All patterns take linear time on any text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, tidy, two

KINDS = ("email", "ip", "card", "phone", "secret", "number", "name")

_TAIL = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_HEAD = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A match can only begin where a run of digits does: a shorter run fails as the longer one did.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind."""
    out = []
    if "@" in text:
        low = 0
        for m in _TAIL.finditer(text):
            i = m.start()
            while i > low and text[i - 1] in _HEAD:
                i -= 1
            if i < m.start():
                out.append((i, 0, m.end()))
                low = m.end()
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_only_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


# Gazetteers.
ADDRESS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Monsieur", "Madame", "Señor", "Señora")
TRIGGERS = frozenset("token key apikey secret password passwd pwd credential ssn iban account konto compte cuenta passport card phone tel telephone mobile fax call".split())
REFUSALS = frozenset("version license licence lizenz licencia page chapter section figure table volume vol isbn by-nc by-sa cc".split())

_WORD = re.compile(r"(?<!\S)[^\s0-9]*+[0-9]\S*+")
_NAME = re.compile(r"(?<!\w)(?:" + "|".join(ADDRESS) + r")\.? ([A-ZÀ-Þ][\w'-]++)(?: ([A-ZÀ-Þ][\w'-]++))?")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")
_LOCAL_PHONE = re.compile(r"(?:\([0-9]{2,5}\))?[0-9]{2,5}[-./][0-9]{3,5}(?:[-./][0-9]{2,5}){0,2}")
_DATE = re.compile(r"[0-9]{1,4}[-/.][0-9]{1,2}(?:[-/.][0-9]{1,4})?")
_PLAIN = re.compile(r"[0-9.,%]+")
_OPAQUE = re.compile(r"[A-Za-z0-9_+/=-]{20,}")
_STRIP = "\"'`()[]{}<>.,;:!?*#$%&|"


@dataclass
class Candidate:
    start: int
    end: int
    kind: int
    votes: str  # a letter +, - or 0 for each labeler
    feature: int


def _iban(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _vote(core: str, before: str, named: bool) -> str:
    left = [w.strip(_STRIP).lower() for w in before.split()[-3:]]
    digits = _only_digits(core)
    opaque = bool(_OPAQUE.fullmatch(core)) and len(digits) >= 4 and len(digits) < len(core)
    shape = "+" if opaque or named or _IBAN.fullmatch(core) or _SSN.fullmatch(core) or _LOCAL_PHONE.fullmatch(core) and len(digits) >= 9 else "-" if _PLAIN.fullmatch(core) and not 13 <= len(digits) <= 19 or _DATE.fullmatch(core) or len(core) <= 6 else "0"
    check = "0"
    if _IBAN.fullmatch(core):
        check = "+" if _iban(core) else "-"
    elif 13 <= len(digits) <= 19 and len(digits) == len(core):
        check = "+" if luhn(digits) else "-"
    words = "+" if TRIGGERS & set(left) else "-" if REFUSALS & set(left) else "0"
    tail = before.rstrip("\"' ")[-1:]
    context = "+" if tail in ("=", ":") and before else "-" if left and left[-1].isdigit() else "0"
    kinds = sum((a.isdigit() != b.isdigit()) for a, b in zip(core, core[1:], strict=False))
    mixed = "+" if kinds >= 6 and len(core) >= 16 else "-" if len(core) <= 6 and not named else "0"
    return shape + check + words + context + mixed + ("+" if named else "0")


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return bisect_right(edges, n)


FEATURE_SIZES = (6, 4, 3, 3, 2, 2)


def _feature(core: str, before: str, named: bool) -> int:
    """One number of mixed radix: length, share of digits, letters, what is before, separators, form of address."""
    digits = sum("0" <= c <= "9" for c in core)
    tail = before.rstrip("\"' ")[-1:]
    parts = (
        _bucket(len(core), (5, 9, 13, 20, 32)),
        0 if not core else min(3, 4 * digits // len(core)),
        2 if core.upper() != core else 1 if core.lower() != core else 0,
        2 if tail in ("=", ":") and before else 1 if before[-1:] in ('"', "'") else 0,
        int(any(c in "-/()." for c in core)),
        int(named),
    )
    k = 0
    for p, n in zip(parts, FEATURE_SIZES, strict=True):
        k = k * n + p
    return k


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[Candidate]:
    """Words with a digit, and names, outside of the base spans."""
    out = []
    found = [(m.start(), m.end(), False) for m in _WORD.finditer(text)] if _DIGIT.search(text) else []
    found += [(m.start(1), m.end(), True) for m in _NAME.finditer(text)]
    if not found:
        return out
    taken = sorted((s, e) for s, _, e in base)
    reach = list(accumulate((e for _, e in taken), max))  # the furthest end up to each base span
    for start, end, named in sorted(found):
        while start < end and text[start] in _STRIP:
            start += 1
        while end > start and text[end - 1] in _STRIP:
            end -= 1
        i = bisect_right(taken, (end, -1))
        if start == end or i and reach[i - 1] > start:
            continue
        core, before = text[start:end], text[max(0, start - 60) : start]
        digits = _only_digits(core)
        kind = 6 if named else 4 if len(core) > len(digits) and _OPAQUE.fullmatch(core) else 5
        if out and out[-1].end > start:
            continue
        out.append(Candidate(start, end, kind, _vote(core, before, named), _feature(core, before, named)))
    return out


def reliabilities(counts: dict[str, float], rounds: int = 60) -> tuple[dict[str, float], np.ndarray, float]:
    """EM over vote patterns. Gives each pattern's probability of personal data, P(vote | class) as labeler x class x (+, -, 0), and the prior."""
    if not counts:
        return {}, np.zeros((0, 2, 3)), 0.5
    names = sorted(counts)
    weight = np.array([counts[k] for k in names], float)
    code = np.array([["+-0".index(c) for c in k] for k in names])
    yes, no = (code == 0).sum(1), (code == 1).sum(1)
    post = np.clip((1 + 2 * yes) / (2 + 2 * yes + 2 * no + (yes == 0)), 0.02, 0.98)  # begins at the majority, silence counting a little against
    like = np.zeros((code.shape[1], 2, 3))
    prior = 0.5
    for _ in range(rounds):
        prior = float(np.clip((weight * post).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        for c, p in enumerate((1 - post, post)):
            for v in range(3):
                like[:, c, v] = ((code == v) * (weight * p)[:, None]).sum(0) + 1.0
        # a labeler is no worse than chance: its + never speaks against, its - never for personal data
        like /= like.sum(2, keepdims=True)
        for v, good in ((0, 1), (1, 0)):
            worse = like[:, good, v] < like[:, 1 - good, v]
            mid = (like[worse, 0, v] + like[worse, 1, v]) / 2
            like[worse, 0, v] = like[worse, 1, v] = mid
        logs = np.log(like)
        z = np.log(prior / (1 - prior)) + sum(logs[k, 1, code[:, k]] - logs[k, 0, code[:, k]] for k in range(code.shape[1]))
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return dict(zip(names, post.tolist(), strict=True)), like, prior


@dataclass
class Model:
    weight: np.ndarray = field(default_factory=lambda: np.zeros(sum(FEATURE_SIZES) + 1))
    posterior: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.5

    def score(self, feature: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_one_hot(feature) @ self.weight, -30, 30)))


def _one_hot(feature: np.ndarray) -> np.ndarray:
    f = np.asarray(feature, np.int64)
    x = np.zeros((len(f), sum(FEATURE_SIZES) + 1))
    x[:, -1] = 1
    rest, end = f.copy(), sum(FEATURE_SIZES)
    for n in reversed(FEATURE_SIZES):
        x[np.arange(len(f)), end - n + rest % n] = 1
        rest //= n
        end -= n
    return x


def fit(rows: list[tuple[str, int, int]], steps: int = 400) -> Model:
    """From (votes, feature, count): reliabilities, then a weighted logistic regression on the posteriors."""
    counts: dict[str, float] = {}
    for votes, _, n in rows:
        counts[votes] = counts.get(votes, 0) + n
    post, _, _ = reliabilities(counts)
    if not rows:
        return Model()
    x = _one_hot(np.array([f for _, f, _ in rows]))
    y = np.array([post[v] for v, _, _ in rows])
    w = np.sqrt(np.array([n for _, _, n in rows], float))  # common forms must not drown rare ones
    w /= w.sum()
    beta = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (w * (p - y)) + 1e-3 * beta
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(hess, grad)
        beta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Model(beta, post)


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, extra): base spans as (start, kind, end), candidates as (start, kind, end, feature) with their votes."""
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                base, extra, votes = [], [], []
                for t in part.column(1).to_pylist():
                    spans = base_spans(t)
                    more = candidates(t, spans)
                    base.append([x for s in spans for x in s])
                    extra.append([x for c in more for x in (c.start, c.kind, c.end, c.feature)])
                    votes.append([c.votes for c in more])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, ints), pa.array(extra, ints), pa.array(votes, pa.list_(pa.string()))], ["doc_id", "base", "extra", "votes"])

    return two(docs).mapInArrow(tidy(run), "doc_id long, base array<int>, extra array<int>, votes array<string>")


def train(scanned: DataFrame) -> Model:
    """The model of all candidates: their counts by votes and feature, a table of bounded size."""
    feature = F.element_at("extra", (F.col("k") * 4 + 4).cast("int"))
    rows = scanned.select("extra", F.posexplode("votes").alias("k", "vote")).groupBy("vote", feature.alias("feature")).count()
    return fit(sorted((r["vote"], r["feature"], r["count"]) for r in rows.collect()))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def detect(docs: DataFrame) -> DataFrame:
    """Per document: counts by base kind, the base spans' hash, and all spans; base ones and what the classifier adds."""
    found = materialize(scan(docs), "pii")
    model = docs.sparkSession.sparkContext.broadcast(train(found))
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in names]
            for key, base, extra in zip(*(b.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
                spans = [tuple(base[i : i + 3]) for i in range(0, len(base), 3)]
                more = [tuple(extra[i : i + 3]) for i in range(0, len(extra), 4)]
                ok = model.value.score(np.array(extra[3::4])) >= model.value.threshold if more else []
                added = [s for s, keep in zip(more, ok, strict=True) if keep]
                row = (key, *(sum(s[1] == k for s in spans) for k in range(4)), hashlib.sha256(joined(spans).encode()).hexdigest(), joined(sorted(spans + added)), len(added))
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return found.select("doc_id", "base", "extra").mapInArrow(tidy(run), schema)


def mask(text: str, model: Model) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    spans = base_spans(text)
    more = candidates(text, spans)
    if more:
        ok = model.score(np.array([c.feature for c in more])) >= model.threshold
        spans = sorted(spans + [(c.start, c.kind, c.end) for c, keep in zip(more, ok, strict=True) if keep])
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if spans else text


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs, all columns, with personal data masked in text_col; null stays null."""
    keyed = docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(train(materialize(scan(keyed), "pii")))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                texts = [None if t is None else mask(t, model.value) for t in part.column(at).to_pylist()]
                cols = [pa.array(texts, part.column(k).type) if k == at else c for k, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(cols, schema=part.schema)

    return docs.mapInArrow(tidy(run), docs.schema)
