"""A corpus pipeline: language, near copies, personal data, source mix, sequences.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept;
all but the last return the columns of documents. Results between stages are written
as Parquet to the shared folder and read back.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import jaccard, langid, mixing, packing, pii
from quillspark.llm.common import bound_batches, materialize, table

#: No SQL expresses the learned stages; tests hold the stages against brute force.
ORACLE_SQL = None

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """stage, whose workers get small batches however its documents were read."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@bounded
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts."""
    return langid.keep(docs, langid.train(docs))


#: Near copies share 80 % of their five-word shingles.
SHINGLE, PERCENT = 5, 80


@bounded
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each group of near copies."""
    return jaccard.one_of_each(docs, SHINGLE, PERCENT)


@bounded
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


@bounded
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each pass that takes a document, the last one cut where the source's target ends."""
    return mixing.mixed(docs).select(*docs.columns)


@bounded
def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix with their place in sequences of 4096."""
    return packing.pack(docs)


STAGES = [("language_id", language), ("ngram_jaccard_join", near_copies), ("pii", personal_data), ("source_mixing", source_mix), ("best_fit_packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
