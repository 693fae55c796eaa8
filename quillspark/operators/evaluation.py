"""Quality figures of parsed documents and of retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bigrams(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, bigram, n): the multiset of neighbouring alphanumeric tokens."""
    t = F.transform(F.regexp_extract_all(F.lower("text"), F.lit("([a-z0-9]+)"), F.lit(1)), lambda x: x)
    rows = texts.select(key, t.alias("t"))
    pairs = F.zip_with(F.slice("t", F.lit(1), F.greatest(F.size("t") - 1, F.lit(0))), F.slice("t", 2, 10_000_000), lambda a, b: F.concat_ws(" ", a, b))
    return rows.select(key, F.explode(F.when(F.size("t") > 1, pairs)).alias("bigram")).groupBy(key, "bigram").agg(F.count("*").alias("n"))


def overlap(expected: DataFrame, got: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, precision, recall, f1) of two texts per key by their shared bigrams."""
    both = bigrams(expected, key).withColumnRenamed("n", "want").join(bigrams(got, key).withColumnRenamed("n", "have"), [key, "bigram"], "full_outer")
    s = both.groupBy(key).agg(F.sum(F.least(F.coalesce("want", F.lit(0)), F.coalesce("have", F.lit(0)))).alias("same"), F.coalesce(F.sum("want"), F.lit(0)).alias("want"), F.coalesce(F.sum("have"), F.lit(0)).alias("have"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    p, r = ratio(F.col("same"), F.col("have")), ratio(F.col("same"), F.col("want"))
    return s.select(key, p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"))


def recall(expected: Column, got: Column) -> Column:
    """Share of an expected set that was found; 1 where nothing was expected."""
    e = F.array_distinct(expected)
    return F.when(F.size(e) > 0, F.size(F.array_intersect(e, got)) / F.size(e)).otherwise(F.lit(1.0))


def ordered_accuracy(expected: Column, got: Column) -> Column:
    """Share of positions that hold the same value."""
    same = F.size(F.filter(F.zip_with(expected, got, lambda a, b: a.eqNullSafe(b)), lambda x: x))
    return F.when(F.size(expected) > 0, F.least(same, F.size(expected)) / F.size(expected)).otherwise(F.lit(1.0))


def distribution_score(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """1 - sum |difference| / sum expected over counts by key."""
    both = expected.withColumnRenamed("n", "want").join(got.withColumnRenamed("n", "have"), key, "full_outer")
    gap = F.sum(F.abs(F.coalesce("want", F.lit(0)) - F.coalesce("have", F.lit(0))))
    return both.agg(F.when(F.sum("want") > 0, 1 - gap / F.sum("want")).otherwise(F.lit(1.0)).alias("score"))


def cell_accuracy(expected: Column, got: Column) -> Column:
    """Share of a table's cells that are equal in their place."""
    total = F.aggregate(expected, F.lit(0), lambda a, r: a + F.size(r))
    row = lambda a, b: F.size(F.filter(F.zip_with(a, F.coalesce(b, F.array().cast("array<string>")), lambda x, y: (x == y) & x.isNotNull()), lambda x: F.coalesce(x, F.lit(False))))
    same = F.aggregate(F.zip_with(expected, got, lambda a, b: F.when(a.isNotNull(), row(a, b)).otherwise(F.lit(0))), F.lit(0), lambda a, x: a + x)
    return F.when(total > 0, same / total).otherwise(F.lit(1.0))
