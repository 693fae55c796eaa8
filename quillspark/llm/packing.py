"""Best-fit packing of tokenised documents by bin completion.

Only lengths matter to the packing, and there are at most `capacity` of them: the
counts by length go to the driver (a table of fixed size), a branch-and-bound over
fillings runs there, and its plan (runs of equal bins) goes back to the pieces,
which find their place from their rank among pieces of their length.

The first incumbent is best-fit decreasing. The search completes the largest length
left by its undominated fillings, least waste first, and cuts a branch whose waste
allows no plan better than the incumbent. It has limits (`Limits`), as bin packing is
NP-hard: `solve` says whether it met one, how many completions it looked at, and the
lower bound, so `Packing.proven` is true only of plans that no other can beat.

Null text counts as empty (one end token); repeated rows are packed as often as
they occur; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import logging
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import materialize, tidy, trim, two
from quillspark.llm.words import buffers, chunks

CAPACITY, END_ID, SALTS = 4096, 1, 16
#: Bytes of texts encoded at once.
CHUNK = 1 << 20
#: ASCII marks, without "<" of special tokens: at a word's end they never share a piece with a letter or digit before them.
_MARKS = "!\"#$%&'()*+,-./:;=>?@[\\]^_`{|}~"

log = logging.getLogger(__name__)
#: Words of Latin letters only. Each is one piece to the tokenizer, composed already, and lower-cased letter by letter.
_PLAIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")
#: Texts of printable ASCII without "<", Latin letters and white space can be lower-cased first; their words are letters and then marks, or anything else.
_SIMPLE = re.compile("[\t-\r !-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*+")
_LETTERS = "".join(sorted({c.lower() for c in map(chr, range(0x250)) if _PLAIN.fullmatch(c)}))

#: The characters by which byte-level models write bytes of Latin letters and space.
_LEVEL = np.arange(256, dtype="<u2")
_LEVEL[[*range(0x7F, 0xA1), 0xAD]] = np.arange(0x121, 0x144)

_CACHE: dict[str, tuple[Any, Any, Any]] = {}


class Plain:
    """The tokenizer's merges alone, for lower-case words of _PLAIN: without its patterns and normalizers, several times as fast."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        suffix = model["end_of_word_suffix"]
        self.tok = Tokenizer(models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=suffix, cache_capacity=0))  # words come once
        self.tok.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(max(model["vocab"].values()) + 1, bool)  # ids that end a word
        for token, k in model["vocab"].items():
            self.last[k] = token.endswith(suffix)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        text = " ".join(words)
        if not text.isascii():  # a character for each byte, as the vocabulary is written
            text = _LEVEL[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-16-le")
        (e,) = self.tok.encode_batch_fast([text], add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        return ids, np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0)


def _tokenizer(path: str | None) -> tuple[Any, Plain, Known]:
    """The tokenizer, its merges alone, and the ids it gave."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _CACHE:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _CACHE[path] = Tokenizer.from_file(path), Plain(path), Known()
        trim()
    return _CACHE[path]


def _bare(text: str) -> bool:
    """Whether it holds 0x1C-0x1F, which are no white space to the tokenizer."""
    return any(c in text for c in "\x1c\x1d\x1e\x1f")


def _words(text: str) -> list[str]:
    """White-space pieces of a text with 0x1C-0x1F. The tokenizer drops white space and never merges across it."""
    for c in "\t\n\r\x0b\x0c\x85\xa0  ":
        text = text.replace(c, " ")
    return text.split(" ")


def _fresh(tok: Any, words: list[str]) -> dict[str, bytes]:
    """Ids of words that are new; one call for all, a special token between them, as it is cut out before anything else."""
    mark = next((t.content for t in tok.get_added_tokens_decoder().values() if t.special and not t.normalized), None)
    odd = [w for w in words if mark is None or "<" in w]  # may hold a special token itself
    out = {w: np.array(tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in odd}
    rest = [w for w in words if w not in out]
    if rest:
        (e,) = tok.encode_batch_fast([mark.join(rest)], add_special_tokens=False)
        ids = np.array(e.ids, "<u4")
        raw, cuts = ids.tobytes(), (4 * np.flatnonzero(ids == tok.token_to_id(mark))).tolist()
        out.update(zip(rest, (raw[a:b] for a, b in zip([0, *(c + 4 for c in cuts)], [*cuts, len(raw)], strict=True)), strict=True))
    return out


def _core(word: str) -> tuple[str, str]:
    """A word's part up to its last letter or digit, in lower case, and the marks after it: they are never one piece. Words that are neither ASCII nor Latin letters stay as they are."""
    core = word.rstrip(_MARKS)
    if core and (_PLAIN.fullmatch(core) or word.isascii() and "<" not in word and core[-1].isalnum()):
        return core.lower(), word[len(core) :]
    return word, ""


def _ids(tok: Any, plain: Plain, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of cores, marks and other words, one after another, and how many each has."""
    kind = [0 if w.isascii() and w.isalpha() else 1 if not w.isascii() and _PLAIN.fullmatch(w) else 2 for w in words]
    order = sorted(range(len(words)), key=kind.__getitem__)
    found, counts = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
    for k in range(3):
        at = order[bisect_left(order, k, key=kind.__getitem__) : bisect_left(order, k + 1, key=kind.__getitem__)]
        for i in range(0, len(at), 4096):
            some = [words[j] for j in at[i : i + 4096]]
            if k < 2:
                ids, count = plain.encode(some)
            else:
                each = _fresh(tok, some)
                ids, count = np.frombuffer(b"".join(each[w] for w in some), "<u4"), np.array([len(each[w]) // 4 for w in some], np.int64)
            found.append(ids)
            counts.append(count)
    by, count = np.empty(len(words), np.int64), np.concatenate(counts)
    by[order] = np.arange(len(words))
    return _runs(np.concatenate(found), (np.cumsum(count) - count)[by], count[by]), count[by]


def _runs(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """values[first : first + count] of each, one after another."""
    total = int(count.sum())
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    at = np.repeat((first - (np.cumsum(count) - count)).astype(kind), count)
    at += np.arange(total, dtype=kind)
    return values[at]


class Known:
    """Ids of parts met before, in a worker, as Arrow strings and numbers: about 5 MB. When it is full, parts not met again since the last time go."""

    LIMIT, BYTES = 1 << 17, 64  # parts, and a part's length

    def __init__(self) -> None:
        self.parts, self.ids = pa.array([], pa.large_string()), np.zeros(0, "<u4")
        self.first, self.count, self.again = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def of(self, tok: Any, plain: Plain, parts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first, count): each part's ids are ids[first : first + count]. Parts are distinct."""
        at = pc.fill_null(pc.index_in(parts, value_set=self.parts), -1).to_numpy()
        new = np.flatnonzero(at < 0)
        fresh = parts.take(pa.array(new))
        ids, count = _ids(tok, plain, fresh.to_pylist())
        first = np.cumsum(count) - count
        out = np.concatenate([self.ids, ids]), np.empty(len(at), np.int64), np.empty(len(at), np.int64)
        old = np.flatnonzero(at >= 0)
        out[1][old], out[2][old] = self.first[at[old]], self.count[at[old]]
        out[1][new], out[2][new] = len(self.ids) + first, count
        self.again[at[old]] = True
        self._keep(fresh, ids, first, count)
        return out

    def _keep(self, fresh: pa.Array, ids: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        take = np.flatnonzero(pc.binary_length(fresh).to_numpy() <= self.BYTES)[: self.LIMIT]
        if len(self.parts) + len(take) > self.LIMIT:
            held = np.flatnonzero(self.again)[: self.LIMIT - len(take)]
            self.parts, self.ids, self.count = self.parts.take(pa.array(held)), _runs(self.ids, self.first[held], self.count[held]), self.count[held]
            self.again = np.zeros(len(held), bool)
        self.parts = pa.concat_arrays([self.parts, fresh.take(pa.array(take))])
        self.ids = np.concatenate([self.ids, _runs(ids, first[take], count[take])])
        self.count = np.concatenate([self.count, count[take]])
        self.first = np.cumsum(self.count) - self.count
        self.again = np.concatenate([self.again, np.zeros(len(take), bool)])


def _simple_parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Cores and marks of a simple text's lower-case words: marks are apart only from letters."""
    core = pc.utf8_rtrim(words, characters=_MARKS)
    apart = pc.utf8_is_alpha(core)
    return pc.if_else(apart, core, words), pc.if_else(apart, pc.utf8_ltrim(words, characters=_LETTERS), "")


def _other_parts(words: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Those of any words: the ones that a simple text may hold, then the rest."""
    simple = pc.match_substring_regex(words, "\\A[!-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]*\\z")
    core, marks = _simple_parts(pc.if_else(simple, pc.utf8_lower(words), ""))
    rest = pc.invert(simple)
    parts = [_core(w) for w in words.filter(rest).to_pylist()]
    return tuple(pc.replace_with_mask(x, rest, pa.array([p[k] for p in parts], pa.large_string())) for k, x in enumerate((core, marks)))


def _joined(found: tuple[Any, Plain, Known], words: pa.Array, counts: np.ndarray, parts: Callable[[pa.Array], tuple[pa.Array, pa.Array]], end_id: int) -> Iterator[bytes]:
    """Ids of texts with so many words each, and the end id after each."""
    tok, plain, known = found
    words = pc.dictionary_encode(words)
    n, words = len(words.dictionary), (words.indices.to_numpy(), words.dictionary)
    number, both = words[0], pc.dictionary_encode(pa.concat_arrays(parts(words[1])))
    del words
    ids, first, count = known.of(tok, plain, both.dictionary)
    part = both.indices.to_numpy().reshape(2, n).T.ravel()  # each word's core, then its marks
    ids = np.append(_runs(ids, first[part], count[part]), np.array([end_id], "<u4"))
    count = np.append(count[part].reshape(n, 2).sum(axis=1), 1)
    first = np.cumsum(count) - count
    begin = np.concatenate([[0], np.cumsum(counts)])
    for i, j in chunks(begin, 1 << 16):
        some = np.insert(number[begin[i] : begin[j]], begin[i + 1 : j + 1] - begin[i], n)  # the end id is a word, too
        length = count[some]
        raw = _runs(ids, first[some], length).tobytes()
        cuts = (4 * np.cumsum(length)[np.cumsum(counts[i:j] + 1) - 1]).tolist()
        yield from (raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False))


def encode(texts: list[str], path: str | None = None, end_id: int = END_ID) -> list[bytes]:
    """Each whole text's ids and the end id, as little-endian unsigned 32-bit integers."""
    found = _tokenizer(path)
    kind = [0 if _SIMPLE.fullmatch(t) else 2 if _bare(t) else 1 for t in texts]
    of = [[t for t, k in zip(texts, kind, strict=True) if k == g] for g in range(3)]
    simple = pc.ascii_split_whitespace(pc.utf8_lower(pa.array(of[0], pa.large_string())))
    other = pc.utf8_split_whitespace(pa.array(of[1], pa.large_string()))
    bare = pa.array(map(_words, of[2]), pa.list_(pa.large_string()))
    by = [_joined(found, ws.flatten(), pc.list_value_length(ws).to_numpy(), parts, end_id) for ws, parts in ((simple, _simple_parts), (other, _other_parts), (bare, _other_parts))]
    out = [next(by[k]) for k in kind]
    pa.default_memory_pool().release_unused()
    return out


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's ids, cut only where longer than capacity."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(buffers(b.column(1))[1], CHUNK):
                part = b.slice(i, j - i)
                cols: list[list] = [[] for _ in names]
                for key, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist(), tokenizer_path, end_id), strict=True):
                    for k in range(0, len(ids), 4 * capacity):
                        cut = ids[k : k + 4 * capacity]
                        row = (key, k // (4 * capacity), k // 4, len(cut) // 4, zlib.crc32(cut))
                        for c, v in zip(cols, row, strict=False):
                            c.append(v)
                        if with_ids:
                            cols[5].append(np.frombuffer(cut, "<u4"))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=False)], names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return two(docs).mapInArrow(tidy(run), schema)


Filling = tuple[tuple[int, int], ...]  # (length, times), longest first


@dataclass
class Limits:
    """What the search may do: completions in all, and at each largest length fillings kept, steps of their enumeration, and lengths tried a step."""

    nodes: int = 20_000
    width: int = 8
    steps: int = 400
    lengths: int = 24


@dataclass
class Packing:
    """Fillings and how many bins have each; the lower bound, completions looked at, and whether a limit cut the search."""

    plan: list[tuple[Filling, int]]
    bound: int
    nodes: int = 0
    cut: bool = False

    @property
    def bins(self) -> int:
        return sum(r for _, r in self.plan)

    @property
    def proven(self) -> bool:
        return self.bins == self.bound or not self.cut


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound: for each k, pieces over capacity - k stand apart from those under k, and the rest is volume."""
    size = np.arange(capacity + 1)
    count = np.asarray(count[: capacity + 1], np.int64)
    number, volume = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    k = np.arange(capacity // 2 + 1)
    big = number[-1] - number[capacity - k + 1]
    half = capacity // 2 + 1
    mid, mid_volume = number[capacity - k + 1] - number[half], volume[capacity - k + 1] - volume[half]
    low = volume[half] - volume[k]
    more = np.maximum(0, -(-(low - (mid * capacity - mid_volume)) // capacity))
    return int(max((big + mid + more).max(), -(-int(volume[-1]) // capacity)))


def dominated(a: Filling, b: Filling) -> bool:
    """Whether b's pieces fit into a's, several into one where they fit: then b never beats a."""
    rooms = sorted((x for x, t in a for _ in range(t)), reverse=True)
    parts = sorted((x for x, t in b for _ in range(t)), reverse=True)
    if len(parts) > 12:  # too many ways; not testing keeps more fillings, never fewer
        return False

    def go(i: int, rooms: list[int]) -> bool:
        if i == len(parts):
            return True
        tried = set()
        for k, r in enumerate(rooms):
            if r >= parts[i] and r not in tried:
                tried.add(r)
                if go(i + 1, [*rooms[:k], r - parts[i], *rooms[k + 1 :]]):
                    return True
        return False

    return sum(parts) <= sum(rooms) and go(0, rooms)


def fillings(count: np.ndarray, room: int, limits: Limits) -> tuple[list[tuple[int, Filling]], bool]:
    """Undominated fillings (waste, filling) of `room`, least waste first, and whether a limit left some out."""
    found: dict[Filling, int] = {}
    state = {"steps": limits.steps, "cut": False}

    def add(items: list[int], waste: int) -> None:
        run: dict[int, int] = {}
        for x in items:
            run[x] = run.get(x, 0) + 1
        found.setdefault(tuple(sorted(run.items(), reverse=True)), waste)

    def dive(r: int, top: int, items: list[int]) -> None:
        if state["steps"] <= 0 or sum(w == 0 for w in found.values()) >= limits.width:
            state["cut"] = True
            return
        state["steps"] -= 1
        if r and r <= top and count[r] > items.count(r):  # one piece fills what is left: it dominates all else here
            add([*items, r], 0)
            return
        if r > 1:  # two pieces that do
            x = np.arange(max((r + 1) // 2, r - top), min(top, r - 1) + 1)
            x = x[(count[x] > 0) & (count[r - x] > 0)]
            for one in x[::-1][: limits.lengths].tolist():
                if count[one] - items.count(one) > (one == r - one) and count[r - one] > items.count(r - one):
                    add([*items, one, r - one], 0)
                    if sum(w == 0 for w in found.values()) >= limits.width:
                        state["cut"] = True
                        return
        sizes = np.flatnonzero(count[: min(r, top) + 1])[::-1]
        state["cut"] |= len(sizes) > limits.lengths
        fits = 0
        for x in sizes[: limits.lengths].tolist():
            free = int(count[x]) - items.count(x)
            if free <= 0:
                continue
            fits += 1
            if x * 64 < r:  # small ones only: as many as fit, at once
                times = min(free, r // x)
                state["cut"] = True
                dive(r - times * x, x - 1, items + [x] * times)
            else:
                dive(r - x, x, [*items, x])
            if state["steps"] <= 0:
                break
        if not fits:
            add(items, r)

    if room == 0:
        return [(0, ())], False
    dive(room, room, [])
    if not found:
        add([], room)
    kept: list[tuple[int, Filling]] = []
    for filling, waste in sorted(found.items(), key=lambda x: (x[1], [-v for p in x[0] for v in p])):
        if not any(dominated(better, filling) for _, better in kept):
            if len(kept) == limits.width:
                return kept, True
            kept.append((waste, filling))
    return kept, state["cut"]


def best_fit(count: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing over counts: pieces of a length go to the fullest bins that take them, equal bins together."""
    room: dict[int, dict[Filling, int]] = {}
    free: list[int] = []  # rooms of open bins, ascending

    def put(filling: Filling, left: int, bins: int) -> None:
        if left not in room:
            room[left] = {}
            insort(free, left)
        room[left][filling] = room[left].get(filling, 0) + bins

    for x in np.flatnonzero(count)[::-1].tolist():
        todo = int(count[x])
        while todo:
            k = bisect_left(free, x)
            if k < len(free):
                left = free[k]
                filling, bins = room[left].popitem()
                if not room[left]:
                    del room[left], free[k]
            else:
                left, filling, bins = capacity, (), todo
            each = min(todo, left // x)  # the fullest bin stays the fullest
            full = min(bins, todo // each)
            put((*filling, (x, each)), left - each * x, full)
            todo -= full * each
            if bins > full and filling:
                put(filling, left, bins - full)
    return [(f, n) for fills in room.values() for f, n in fills.items()]


def greedy(count: np.ndarray, capacity: int) -> list[tuple[Filling, int]]:
    """Bins filled one after another, longest pieces first, whole runs of equal bins at a time: another first incumbent."""
    count, plan = count.copy(), []
    while count.any():
        room, items = capacity, []
        for x in np.flatnonzero(count)[::-1].tolist():
            if x <= room:
                times = min(int(count[x]), room // x)
                items.append((x, times))
                room -= times * x
        runs = min(int(count[x]) // t for x, t in items)
        for x, t in items:
            count[x] -= runs * t
        plan.append((tuple(items), runs))
    return plan


def solve(counts: np.ndarray, capacity: int = CAPACITY, limits: Limits | None = None) -> Packing:
    """Bin completion over counts by length."""
    limits = limits or Limits()
    total = int((np.arange(len(counts)) * counts).sum())
    best = Packing(min((best_fit(counts, capacity), greedy(counts, capacity)), key=lambda p: sum(r for _, r in p)), lower_bound(counts, capacity))
    bins = best.bins
    if bins <= best.bound:
        return best
    count, stack, plan, waste, used = counts.astype(np.int64).copy(), [], [], 0, 0

    def options() -> list[tuple[int, Filling]]:
        top = int(np.flatnonzero(count)[-1])
        count[top] -= 1
        out = []
        found, cut = fillings(count, capacity - top, limits)
        best.cut |= cut
        for w, items in found:
            run = dict(items)
            run[top] = run.get(top, 0) + 1
            out.append((w, tuple(sorted(run.items(), reverse=True))))
        count[top] += 1
        return out

    stack.append(iter(options()))
    while stack:
        if best.nodes >= limits.nodes:
            best.cut = True
            break
        step = next(stack[-1], None)
        if step is None:
            stack.pop()
            if plan:
                items, runs, w = plan.pop()
                for x, t in items:
                    count[x] += runs * t
                waste -= w * runs
                used -= runs
            continue
        best.nodes += 1
        w, items = step
        runs = min(int(count[x]) // t for x, t in items)
        allowed = (bins - 1) * capacity - total
        if w and waste + w * runs > allowed:
            runs = max(1, min(runs, (allowed - waste) // w))
            if waste + w * runs > allowed and int(count.sum()) > sum(t for _, t in items):
                continue
        best.cut |= runs > 1  # other fillings of the same length are not tried in between
        for x, t in items:
            count[x] -= runs * t
        plan.append((items, runs, w))
        waste += w * runs
        used += runs
        if not count.any():
            if used < bins:
                bins, best.plan = used, [(i, r) for i, r, _ in plan]
                if bins <= best.bound:
                    break
            stack.append(iter(()))
        else:
            stack.append(iter(options()))
    return best


def places(plan: list[tuple[Filling, int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, times a bin, first bin, offset), ascending by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    rank: dict[int, int] = {}
    first = 0
    for items, runs in plan:
        offset = 0
        for x, t in items:
            rows.setdefault(x, []).append((rank.get(x, 0), t, first, offset))
            rank[x] = rank.get(x, 0) + t * runs
            offset += x * t
        first += runs
    return {x: np.array(r, np.int64) for x, r in rows.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer_path: str | None = None, limits: Limits | None = None, salts: int = SALTS, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its offset there; full pieces stand alone."""
    cut = materialize(pieces(docs, capacity, end_id, tokenizer_path, with_ids), "pieces")
    salt = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int")
    by = cut.groupBy("length", salt.alias("salt")).count().collect()  # capacity * salts rows at most
    count = np.zeros((capacity + 1, salts), np.int64)
    for r in by:
        count[r["length"], r["salt"]] = r["count"]
    before = np.cumsum(count, axis=1) - count
    found = solve(count.sum(axis=1), capacity, limits)
    log.info("%d sequences, lower bound %d, %d completions, %s", found.bins, found.bound, found.nodes, "proven least" if found.proven else "search cut by its limits")
    where = places(found.plan)
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("salt", salt).withColumn("rank", F.row_number().over(order).cast("long") - 1)
    names = cut.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank").to_numpy() + before[length, b.column("salt").to_numpy()]
            seq, off = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for x in np.unique(length).tolist():
                at, rows = np.flatnonzero(length == x), where[x]
                r = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
                k = rank[at] - r[:, 0]
                seq[at], off[at] = r[:, 2] + k // r[:, 1], r[:, 3] + k % r[:, 1] * x
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields) + ", sequence_id long, offset long"
    return ranked.mapInArrow(tidy(run), schema)
