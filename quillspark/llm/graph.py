"""Connected components of edge tables: edges are contracted part by part, and large and small stars join the parts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import discard, materialize, tidy

#: Edges that a task contracts at once.
CHUNK = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) of every node but the smallest of each component: v is the smallest."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(ids))
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        np.minimum.at(low, root[a], low[a])  # a tree whose node meets a smaller one follows with its root
        np.minimum.at(low, root[b], low[b])
        low = low[low]
        if (low == root).all():
            break
        root = low
    u = np.flatnonzero(root != np.arange(len(ids)))
    return ids[u], ids[root[u]]


def contracted(e: DataFrame) -> DataFrame:
    """(u, v): fewer edges that join the same nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(tuple(c.to_numpy() for c in b.columns))
            n += b.num_rows
            if n > CHUNK:
                held = [roots(*(np.concatenate(c) for c in zip(*held, strict=True)))]
                if len(held[0][0]) > CHUNK // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["u", "v"])
                    held = []
                n = sum(len(c[0]) for c in held)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in roots(*(np.concatenate(c) for c in zip(*held, strict=True)))], ["u", "v"])

    return e.mapInArrow(tidy(run), "u long, v long")


def _settled(e: DataFrame) -> bool:
    """Whether every node has one edge, to a node that has none."""
    ends = e.select(F.col("u").alias("id"), F.lit(1).alias("child")).union(e.select("v", F.lit(0)))
    many = ends.groupBy("id").agg(F.sum("child").alias("edges"), F.min("child").alias("least"))
    return not many.where("edges > 1 or edges > 0 and least = 0").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of (a, b): component is the smallest id that can be reached.

    Minima are aggregated before they meet the edges, so a node with very many
    neighbours is a skewed join, never a group in one task's memory.
    """
    parts = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 32)
    # each edge from the larger to the smaller end
    e = edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).repartition(parts)
    e = materialize(contracted(e), "edges")
    while not _settled(e):  # every round brings nodes nearer to their least one, so this ends
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        to_low = large.join(low, "u").where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        now = to_low.union(low.select("u", F.col("m").alias("v"))).repartition(parts)
        last, e = e, materialize(contracted(now), "edges")
        discard(last)
    top = e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(top)
