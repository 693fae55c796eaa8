"""Structured Streaming forms: windows over event time, sessions, duplicate arrivals, reviews of arriving documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read(spark: SparkSession, folder: str, schema: str | StructType, name: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; rows later than the watermark are dropped on a stream."""
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """A user's events without a pause of `gap`."""
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id")
    return rows.agg(F.count("*").alias("n")).select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def first_arrivals(files: DataFrame, late: str = "1 day") -> DataFrame:
    """Arrivals (arrival, content) by content hash, each once within the watermark."""
    return files.withColumn("doc_sig", F.sha2("content", 256)).withWatermark("arrival", late).dropDuplicatesWithinWatermark(["doc_sig"])


def review_each(sections: DataFrame, review: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Reviews every micro-batch whole, as taxonomy is carried within a document, and appends violations under out/batch=N; a batch that is run again overwrites its own folder."""

    def step(batch: DataFrame, epoch: int) -> None:
        review(batch).write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return sections.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
