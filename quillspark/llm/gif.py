"""GIF: LZW code streams, palettes, disposal and transparency, timed frames.

A writer and a general reader in plain Python and numpy. The reader takes global
and local palettes, interlaced rasters, graphic control blocks (delay, disposal
0-3, transparent index) and composites every frame on the logical screen.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CLEAR, END = 256, 257
#: Data codes after a clear code until the table is full, and the clear code itself.
_SEGMENT = 3839
WIDTH, HEIGHT = 64, 1024


#: Pixels of a screen or a frame that a reader will hold, 4 bytes each.
MOST_PIXELS = 1 << 27


class Damaged(ValueError):
    """The file breaks off, or holds what no GIF holds."""


def _widths(size: int) -> np.ndarray:
    """Code width by the number of codes since the last clear code."""
    used = (1 << size) + 2 + np.maximum(np.arange(4200) - 1, 0)
    return np.clip(np.floor(np.log2(used)).astype(np.int64) + 1, size + 1, 12)


_SCHEDULE = {s: _widths(s) for s in range(2, 9)}
_OFFSETS = {s: np.concatenate([[0], np.cumsum(w)]) for s, w in _SCHEDULE.items()}


def lzw_codes(data: bytes) -> list[int]:
    """Codes of 8-bit samples, a clear code first and whenever the table is full."""
    out = [CLEAR]
    put, table, nxt = out.append, {}, 258
    get = table.get
    it = iter(data)
    w = next(it, None)
    if w is None:
        return [CLEAR, END]
    for c in it:
        k = w << 8 | c
        x = get(k)
        if x is not None:
            w = x
            continue
        put(w)
        table[k] = nxt
        nxt += 1
        if nxt == 4096:
            put(CLEAR)
            table.clear()
            nxt = 258
        w = c
    put(w)
    put(END)
    return out


def lzw_pack(codes: list[int]) -> bytes:
    c = np.asarray(codes, np.int64)
    width = np.empty(len(c), np.int64)
    width[0] = 9
    width[1:] = _SCHEDULE[8][np.arange(len(c) - 1) % _SEGMENT]
    at = np.cumsum(width) - width
    value, byte = c << (at & 7), at >> 3
    n = int(at[-1] + width[-1] + 7) >> 3
    out = np.bincount(byte, value & 255, n + 3)
    out[1:] += np.bincount(byte, value >> 8 & 255, n + 2)
    out[2:] += np.bincount(byte, value >> 16, n + 1)
    return out[:n].astype(np.uint8).tobytes()


def lzw_decode(data: bytes, size: int = 8, limit: int | None = None) -> bytes:
    """Samples of a packed stream of minimum code size `size`; stops at the end code, at `limit` samples or where data ends. A code of no entry raises Damaged."""
    if size not in _SCHEDULE:
        raise Damaged(f"code size {size}")
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    bits, clear, end = len(data) * 8, 1 << size, (1 << size) + 1
    base = [bytes((i,)) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    at = have = counted = 0
    table, prev = list(base), b""
    since = 0
    while at + size < bits and (limit is None or have < limit):
        if since + 4096 <= 4200:
            sched, offs = _SCHEDULE[size][since : since + 4096], _OFFSETS[size][since : since + 4097] - _OFFSETS[size][since]
        else:  # the table is full and no clear code came
            sched, offs = np.full(4096, 12), np.arange(4097) * 12
        n = int(np.searchsorted(offs, bits - at, "right")) - 1
        if n <= 0:
            break
        pos = at + offs[:n]
        byte = pos >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (pos & 7) & ((1 << sched[:n]) - 1)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else n
        todo = codes[:stop].tolist()
        if todo and not prev:
            if todo[0] >= clear:
                raise Damaged(f"code {todo[0]} after a clear code")
            prev = base[todo[0]]
            out.append(prev)
            todo = todo[1:]
        room = 4096 - len(table)
        add, put = table.append, out.append
        for c in todo[:room]:
            try:
                e = table[c]
            except IndexError:
                if c > len(table):
                    raise Damaged(f"code {c} of {len(table)}") from None
                e = prev + prev[:1]
            put(e)
            add(prev + e[:1])
            prev = e
        for c in todo[room:]:
            prev = table[c]
            put(prev)
        have += sum(map(len, out[counted:]))
        counted = len(out)
        if stop == n:
            since += n
            at += int(offs[n])
            continue
        at += int(offs[stop + 1])
        if codes[stop] == end:
            break
        table, prev, since = list(base), b"", 0
    whole = b"".join(out)
    return whole if limit is None else whole[:limit]


def _blocks(data: bytes) -> bytes:
    return b"".join(bytes((len(p),)) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


#: Red, green and blue of a sample: its upper three, next three and last two bits.
PALETTE = np.stack([np.arange(256) >> 5 << 5, (np.arange(256) >> 2 & 7) << 5, (np.arange(256) & 3) << 6], 1).astype(np.uint8)


def encode(payload: bytes, width: int = WIDTH, height: int = HEIGHT, delay: int = 4) -> bytes:
    """A GIF whose frames hold the payload's bytes as palette indices, row by row, each frame full width."""
    if not payload or len(payload) % width:
        raise ValueError(f"a payload is a positive multiple of {width} bytes")
    size = width * height
    rows = min(height, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, rows, 0xF7, 0, 0), PALETTE.tobytes()]
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08")
        out.append(_blocks(lzw_pack(lzw_codes(part))))
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    """start_cs and delay_cs in hundredths of a second; raster: palette indices; canvas: the composited screen as 0xAARRGGBB."""

    start_cs: int
    delay_cs: int
    disposal: int
    transparent: int
    left: int
    top: int
    raster: np.ndarray
    canvas: np.ndarray


def _colours(rgb: bytes) -> np.ndarray:
    p = np.frombuffer(rgb[: len(rgb) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.uint32)
    out = np.zeros(256, np.uint32)
    out[: len(p)] = np.uint32(0xFF000000) | p[:, 0] << np.uint32(16) | p[:, 1] << np.uint32(8) | p[:, 2]
    return out


def frames(data: bytes, most_pixels: int = MOST_PIXELS) -> Iterator[Frame]:
    """Every whole frame in order; its canvas holds only until the next one. A bad signature raises ValueError, a file that is damaged or breaks off Damaged after its whole frames."""
    if data[:3] != b"GIF" or len(data) < 13:
        raise ValueError("not a GIF")
    w, h, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    if w * h > most_pixels:
        raise Damaged(f"a screen of {w} x {h}")
    at, common = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        common, at = _colours(data[at : at + n]), at + n
    screen = np.zeros((h, w), np.uint32)
    clock = delay = disposal = 0
    transparent = -1

    def blocks(i: int) -> tuple[bytes, int]:
        parts = []
        while i < len(data) and data[i]:
            parts.append(data[i + 1 : i + 1 + data[i]])
            i += 1 + data[i]
        return b"".join(parts), i + 1

    while at < len(data):
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else -1
        elif kind == 0x2C and at + 10 <= len(data):
            left, top, fw, fh, f = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            at += 10
            colours = common
            if f & 0x80:
                n = 3 << (f & 7) + 1
                colours, at = _colours(data[at : at + n]), at + n
            if colours is None:
                colours = _colours(bytes(np.repeat(np.arange(256, dtype=np.uint8), 3)))
            if fw * fh > most_pixels:
                raise Damaged(f"a frame of {fw} x {fh}")
            if at >= len(data):
                break
            size = data[at]
            body, at = blocks(at + 1)
            samples = lzw_decode(body, size, fw * fh)
            if len(samples) < fw * fh:
                raise Damaged(f"{len(samples)} of {fw * fh} samples")
            raster = np.frombuffer(samples, np.uint8).reshape(fh, fw)
            if f & 0x40:  # four passes of rows
                order = np.concatenate([np.arange(0, fh, 8), np.arange(4, fh, 8), np.arange(2, fh, 4), np.arange(1, fh, 2)])
                plain = np.empty_like(raster)
                plain[order] = raster
                raster = plain
            before = screen.copy() if disposal == 3 else None
            seen = raster[: max(0, h - top), : max(0, w - left)]
            spot = screen[top : top + seen.shape[0], left : left + seen.shape[1]]
            if transparent >= 0:
                solid = seen != transparent
                spot[solid] = colours[seen[solid]]
            else:
                spot[...] = colours[seen]
            yield Frame(clock, delay, disposal, transparent, left, top, raster, screen)
            clock += delay
            if disposal == 2:
                spot[...] = 0
            elif disposal == 3:
                screen = before
            delay = disposal = 0
            transparent = -1
        elif kind == 0x3B:
            return
        else:
            raise Damaged(f"block {kind}")
    raise Damaged("no trailer")


def decode(data: bytes, most_pixels: int = MOST_PIXELS) -> list[Frame]:
    """The whole frames in order, also of a damaged file; a bad signature raises ValueError."""
    out = []
    try:
        for f in frames(data, most_pixels):
            f.canvas = f.canvas.copy()
            out.append(f)
    except Damaged:
        pass
    return out


def histogram(frame: Frame, bins: int = 4) -> np.ndarray:
    """Visible pixels of the composited frame by red, then green, then blue bin; the last value counts transparent ones."""
    c = frame.canvas.ravel()
    shown = c[c >> np.uint32(24) > 0]
    down = np.uint32(8 - int(np.log2(bins)))
    parts = [np.bincount((shown >> np.uint32(s) & np.uint32(255)) >> down, minlength=bins) for s in (16, 8, 0)]
    return np.concatenate([*parts, [c.size - shown.size]])
