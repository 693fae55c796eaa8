"""What the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import gc
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import hold, materialize, ship, shared_dir

__all__ = ["bound_batches", "discard", "documents", "hold", "materialize", "ship", "shared_dir", "small", "squeezed", "table", "tidy", "trim", "two", "unsqueezed"]


#: Rows of an Arrow batch: whole texts travel in them, so Spark's default of 10,000 makes each of many megabytes.
BATCH_ROWS = 2048
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: And bytes of one in the pipeline, a little under the 1 MB that operators take at once: JVM and workers hold it several times.
BATCH_BYTES = 15 << 16
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def _bound_rows(spark: SparkSession) -> None:
    if spark.conf.get(_ROWS) == "10000":  # unless the session chose a size
        spark.conf.set(_ROWS, str(BATCH_ROWS))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session are small in rows and bytes, unless it chose sizes."""
    _bound_rows(spark)
    if spark.conf.get(_BYTES, "67108864b") == "67108864b":  # the default of 64 MB
        spark.conf.set(_BYTES, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    _bound_rows(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def two(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only doc_id and text (null: empty), so that no other column can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def discard(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and that nothing reads any more."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            p = path(folder)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of ids that may be sent to every executor; more are joined by a shuffle.
SENT_IDS = 2_000_000


def small(ids: DataFrame) -> DataFrame:
    """ids, to be broadcast if they are few enough (their rows are counted), else to be joined by a shuffle."""
    return F.broadcast(ids) if ids.count() <= SENT_IDS else ids.hint("merge")


def squeezed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its text column as zstd-compressed UTF-8: a shuffle of whole texts takes a third less than Spark's own compression."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for b in batches:
            k = b.schema.get_field_index(text_col)
            data = [struct.pack("<q", len(raw)) + codec.compress(raw, asbytes=True) for raw in (t.encode() for t in b.column(k).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()) if i == k else c for i, c in enumerate(b.columns)], b.schema.names)

    schema = ", ".join(f"`{f.name}` {'binary' if f.name == text_col else f.dataType.simpleString()}" for f in df.schema.fields)
    return df.mapInArrow(tidy(run), schema)


def unsqueezed(data: list[bytes]) -> list[bytes]:
    codec = pa.Codec("zstd")
    return [codec.decompress(x[8:], struct.unpack_from("<q", x)[0], asbytes=True) for x in data]


def trim() -> None:
    """Give freed memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which at a partition's end gives freed memory back to the system: idle workers otherwise keep what their largest task took."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return whole
