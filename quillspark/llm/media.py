"""Media columns: GIF files as binary columns, decoded into timed frames with colour histograms.

Null or undecodable media give no frames (`decode_gifs`); a damaged file, or one that
breaks off, gives its whole frames, and `gif_info` has an `error` text. A reader holds
one frame and one screen at a time, of up to `gif.MOST_PIXELS`; larger ones are an
error. Null text counts as empty. Extra columns of the input are ignored,
repeated rows give repeated rows, an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm import gif
from quillspark.llm.common import tidy, two

UNIT = 64

FRAMES = "id long, frame int, start_cs long, delay_cs long, disposal int, transparent int, left_px int, top_px int, width int, height int, histogram array<long>"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, duration_cs long"


def payload(text: str | None) -> bytes:
    """UTF-8 with bytes 0 up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


def to_gifs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", height: int = gif.HEIGHT, delay_cs: int = 4) -> DataFrame:
    """(id, n_bytes, media): every whole text as a GIF whose samples are its padded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = part.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len((t or "").encode()) for t in texts], pa.int64()), pa.array([gif.encode(payload(t), UNIT, height, delay_cs) for t in texts], pa.binary())],
                    ["id", "n_bytes", "media"],
                )

    return two(docs, id_col, text_col).mapInArrow(tidy(run), "id long, n_bytes long, media binary")


def decode_gifs(media: DataFrame, id_col: str = "id", media_col: str = "media", bins: int = 4) -> DataFrame:
    """One row per frame: times, placement, disposal and the composited frame's histogram (red, green, blue bins, transparent pixels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 6, pa.list_(pa.int64())]
        names = [x.split()[0] for x in FRAMES.split(", ")]
        for b in batches:
            rows = []
            for key, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    for k, f in enumerate(gif.frames(data or b"")):
                        rows.append((key, k, f.start_cs, f.delay_cs, f.disposal, f.transparent, f.left, f.top, f.raster.shape[1], f.raster.shape[0], gif.histogram(f, bins).tolist()))
                except ValueError:  # gif_info tells why
                    pass
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(tidy(run), FRAMES)


def gif_info(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, media_bytes, n_frames, duration_cs, error) of every file: its whole frames, and what is wrong with it (null: nothing)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for data in b.column(1).to_pylist():
                n = time = 0
                error = None if data is not None else "no media"
                try:
                    for f in gif.frames(data) if data is not None else ():
                        n, time = n + 1, time + f.delay_cs
                except ValueError as e:
                    error = str(e)
                for c, v in zip(cols, (None if data is None else len(data), n, time, error), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], ["id", "media_bytes", "n_frames", "duration_cs", "error"])

    return media.select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(tidy(run), "id long, media_bytes long, n_frames long, duration_cs long, error string")


def digest(media: DataFrame) -> DataFrame:
    """Reads stored GIFs (id, n_bytes, media) back: hashes of their samples and file, and the colour histogram over all frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            for n, data in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                sha, back, tail, total, count, time = hashlib.sha256(), 0, b"", 0, 0, 0
                for f in gif.frames(data):
                    part = f.raster.tobytes()
                    sha.update(part)
                    back, tail, total = back + len(part), (tail + part[-UNIT:])[-UNIT:], total + gif.histogram(f)
                    count, time = count + 1, time + f.delay_cs
                row = (n, back, sha.hexdigest(), zlib.crc32(tail), len(data), hashlib.sha256(data).hexdigest(), ",".join(map(str, total)), count, time)
                for c, v in zip(cols, row, strict=True):
                    c.append(v)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            names = [x.split()[0] for x in DIGEST.split(", ")]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return media.select("id", "n_bytes", "media").mapInArrow(tidy(run), DIGEST)
