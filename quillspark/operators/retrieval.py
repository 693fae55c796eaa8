"""Hybrid retrieval: BM25 and vector lanes, merged, reranked, deduplicated, with parents.

Many queries run in one plan. An index is tables: `postings` (term, chunk_id, tf, dl),
`terms` (term, df) and one row of corpus figures; the scores of a query come from an
equi-join on its terms, so work follows the postings that it touches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.phrases import contains_any, has_any_phrase, tokens

# Ranking constants and the phrases that steer it.
K1, BM25_B, RRF_K = 1.5, 0.75, 60
DIRECT = (
    "supporting information", "supporting info", "required information", "required data", "additional information", "additional data",
    "documentation", "what data do i need", "what must i include", "what do i need to include", "what should i include",
    "what needs to be included", "include in my assessment", "required for all assessments", "required under specific conditions",
    "beyond the basics", "beyond the basic requirements", "extra supporting info", "extra supporting information",
)
NOUNS = ("information", "info", "data", "documentation")
VERBS = ("include", "included", "required", "need", "needed", "submit", "missing", "extra", "additional")
ALL_CONDITIONS = ("all conditions", "all assessments", "basic requirements")
SPECIFIC_CONDITIONS = ("specific conditions", "threatened taxa", "threatened species", "beyond the basics", "additional required supporting information", "extra supporting info")
BASIC_QUERY = "required supporting information under all conditions for IUCN Red List assessments"
SPECIFIC_QUERY = "required supporting information under specific conditions for threatened taxa"
BEYOND_QUERY = "additional required supporting information under specific conditions for threatened taxa beyond the basics"
REQUIRED_SOURCE, STANDARDS_SOURCE = "Required_and_Recommended_Supporting_Information", "RL_Standards_Consistency"
#: (query terms, source names, their boost, section or table terms, their boost)
INTENTS = (
    (("red list status", "red list category", "category is", "currently in"), ("RL_categories_and_criteria", "RedListGuidelines"), 0.16, ("categories", "category", "figure 2.1"), 0.12),
    (("d2", "criterion d", "criterion b", "eoo", "aoo", "cutoff", "cut-off", "threshold"), ("RedListGuidelines", "RL_categories_and_criteria", "RL_criteria_summary_sheet"), 0.18, ("criterion", "guidelines for applying criterion", "structure of the iucn red list categories"), 0.1),
    (("country", "countries", "occur", "recorded from", "elevation", "location", "locations"), (STANDARDS_SOURCE, "Mapping_Standards"), 0.12, ("distribution", "map", "location", "occurrence", "country"), 0.1),
    (("threat", "conservation", "research", "use", "trade", "habitat", "system", "supporting information"), (REQUIRED_SOURCE, STANDARDS_SOURCE), 0.1, (), 0.0),
)


def is_supporting_info(q: Column) -> Column:
    """q: a lower-cased query."""
    return has_any_phrase(q, *DIRECT) | (has_any_phrase(q, *NOUNS) & has_any_phrase(q, *VERBS))


@dataclass
class Index:
    postings: DataFrame
    terms: DataFrame
    figures: DataFrame


def index(corpus: DataFrame) -> Index:
    """Of a corpus with chunk_id and search_text."""
    docs = corpus.select("chunk_id", tokens(F.col("search_text")).alias("t")).select("chunk_id", "t", F.size("t").alias("dl"))
    postings = docs.select("chunk_id", "dl", F.explode("t").alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    terms = postings.groupBy("term").agg(F.count("*").alias("df"))
    figures = docs.agg(F.count("*").alias("n_docs"), (F.coalesce(F.sum("dl"), F.lit(0)) / F.greatest(F.count("*"), F.lit(1))).alias("avgdl"))
    return Index(postings, terms, figures)


def steady_sum(x: Column) -> Column:
    """A sum of doubles that is the same in any order: multiples of 2^-20, and of 2^-60 for the rest, add up exactly (to 2^33, and over 2^14 rows)."""
    high = F.rint(x * 2.0**20) / 2.0**20
    return F.sum(high) + F.sum(F.rint((x - high) * 2.0**60) / 2.0**60)


def bm25(queries: DataFrame, idx: Index, k: int = 20) -> DataFrame:
    """(query_id, chunk_id, bm25_score, sparse_rank) of the k best chunks; a token that a query repeats counts as often. Scores equal to 9 digits are ties, by chunk_id, null last."""
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    # one row of figures: known to fit
    rows = asked.join(idx.terms, "term").join(idx.postings, "term").crossJoin(F.broadcast(idx.figures))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") + K1 * (1 - BM25_B + BM25_B * F.greatest("dl", F.lit(1)) / F.greatest("avgdl", F.lit(1e-9)))
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / F.greatest(norm, F.lit(1e-9))
    score = steady_sum(part)
    scored = rows.groupBy("query_id", "chunk_id").agg(score.alias("bm25_score")).where("bm25_score > 0")
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25_score", 9)), F.asc_nulls_last("chunk_id"))
    return scored.withColumn("sparse_rank", F.row_number().over(best)).where(F.col("sparse_rank") <= k)


def embed(rows: DataFrame, key: str, text: str, load: Callable[[], Callable[[list[str]], Any]], batch: int = 64) -> DataFrame:
    """(key, embedding): unit vectors of texts. load gives the encoder, once a worker; it takes a list of texts and gives a row of numbers for each."""
    made: list[Any] = []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if not made:
            made.append(load())
        for b in batches:
            for i in range(0, len(b), batch):
                part = b.iloc[i : i + batch]
                v = np.asarray(made[0](part[text].fillna("").tolist()), np.float32).reshape(len(part), -1)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": list(v)})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def write_index(path: str, corpus: DataFrame, parents: DataFrame, vectors: DataFrame | None = None) -> None:
    """An index on disk: corpus, parents, postings by term, and vectors if there are any."""
    idx = index(corpus)
    tables = {"corpus": corpus, "parents": parents, "postings": idx.postings.repartitionByRange("term").sortWithinPartitions("term"), "terms": idx.terms, "figures": idx.figures}
    for name, df in (tables | ({"vectors": vectors} if vectors is not None else {})).items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def read_index(spark: SparkSession, path: str) -> tuple[Index, DataFrame, DataFrame, DataFrame | None]:
    """(index, corpus, parents, vectors); vectors None if the index has none."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    try:
        vectors = read("vectors").select("chunk_id", "embedding")
    except AnalysisException:  # no such table, or not one of vectors
        vectors = None
    return Index(read("postings"), read("terms"), read("figures")), read("corpus"), read("parents"), vectors


def dense(queries: DataFrame, vectors: DataFrame, k: int = 24) -> DataFrame:
    """(query_id, chunk_id, dense_score, dense_rank): exact nearest unit vectors by 1 / (1 + squared distance). Ties by chunk_id."""
    # every stated query meets every vector; Spark picks the side to send by its size
    both = vectors.select("chunk_id", F.col("embedding").alias("v")).crossJoin(queries.select("query_id", F.col("embedding").alias("q")))
    gap = F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b).cast("double") * (a - b).cast("double")), F.lit(0.0), lambda s, x: s + x)
    best = Window.partitionBy("query_id").orderBy(F.desc("dense_score"), "chunk_id")
    return both.select("query_id", "chunk_id", (1 / (1 + gap)).alias("dense_score")).withColumn("dense_rank", F.row_number().over(best)).where(F.col("dense_rank") <= k)


def merge_lanes(sparse: DataFrame, vector: DataFrame) -> DataFrame:
    """Full outer merge by query and chunk; fused_score is kept for display, ranking doesn't use it."""
    w = Window.partitionBy("query_id")
    d = vector.withColumn("dense_part", 1 / (RRF_K + F.col("dense_rank")) + 0.1 * F.col("dense_score") / F.greatest(F.max("dense_score").over(w), F.lit(1e-9)))
    s = sparse.withColumn("sparse_part", 1 / (RRF_K + F.col("sparse_rank")) + 0.06 * F.col("bm25_score") / F.max("bm25_score").over(w))
    out = d.join(s, ["query_id", "chunk_id"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.select(
        "query_id", "chunk_id", zero("dense_score").alias("dense_score"), "dense_rank", zero("bm25_score").alias("bm25_score"), "sparse_rank",
        (zero("dense_part") + zero("sparse_part")).alias("fused_score"),
    )


def coverage(query: Column, text: Column) -> Column:
    """Share of a query's distinct tokens that a text has."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(F.lit(0.0))


def table_label(title: Column) -> Column:
    t = F.coalesce(title, F.lit(""))
    return F.when(t.contains("Table 1"), "table1").when(t.contains("Table 2"), "table2").when(t.contains("Table 3"), "table3").otherwise("other")


def _plus(test: Column, value: float) -> Column:
    return F.when(test, F.lit(value)).otherwise(F.lit(0.0))


def boosts(query: Column) -> Column:
    """What block type, source, section and the query's intent add to a candidate's score."""
    q = F.lower(query)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    kind, source, title, section = F.coalesce("block_type", F.lit("text")), text("source_file"), text("table_title"), text("section_title")
    label, support = table_label(F.col("table_title")), is_supporting_info(q)
    out = 0.06 * F.greatest(F.coalesce("priority", F.lit(1.0)) - 1.0, F.lit(0.0)) + _plus(kind == "table_row", 0.18) + _plus(kind == "table", 0.08)
    out += F.when(
        support,
        _plus(source.contains(REQUIRED_SOURCE), 0.18) + _plus(source.contains(STANDARDS_SOURCE), 0.12) + _plus(contains_any(title, "Table 1", "Table 2"), 0.14)
        + _plus(contains_any(section, "Required Supporting Information", "Specific Condition"), 0.08) + _plus(kind == "text", -0.03),
    ).otherwise(F.lit(0.0))
    general, specific = has_any_phrase(q, *ALL_CONDITIONS), has_any_phrase(q, *SPECIFIC_CONDITIONS)
    out += _plus(general & (label == "table1"), 0.24) + _plus(general & (label == "table1") & (kind == "table"), 0.08) + _plus(general & (label == "table2"), -0.06)
    out += _plus(specific & (label == "table2"), 0.2) + _plus(specific & (label == "table2") & (kind == "table_row"), 0.04) + _plus(specific & (label == "table1"), -0.04)
    place = F.lower(F.concat_ws(" ", section, title))
    for terms, sources, by_source, parts, by_part in INTENTS:
        out += F.when(contains_any(q, *terms), _plus(contains_any(source, *sources), by_source) + _plus(contains_any(place, *parts), by_part)).otherwise(F.lit(0.0))
    more = support & contains_any(q, "beyond the basics", "extra", "additional")
    return out + _plus(more & (label == "table2"), 0.18) + _plus(more & (label == "table1"), -0.04)


def rerank(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 24) -> DataFrame:
    """Candidates with their chunk's columns and rerank_score, the k best of each query. Ties by chunk_id."""
    w = Window.partitionBy("query_id")
    rows = candidates.join(corpus, "chunk_id").join(queries.select("query_id", F.col("text").alias("query")), "query_id")
    lane = lambda c: F.col(c) / F.greatest(F.max(c).over(w), F.lit(1e-9))
    score = 0.42 * lane("dense_score") + 0.22 * lane("bm25_score") + 0.16 * coverage(F.col("query"), F.col("search_text")) + boosts(F.col("query"))
    rows = rows.withColumn("rerank_score", score)
    return rows.withColumn("place", F.row_number().over(w.orderBy(F.desc("rerank_score"), "chunk_id"))).where(F.col("place") <= k).drop("place")


def subqueries(queries: DataFrame) -> DataFrame:
    """(query_id, sub, text): a question about supporting information becomes three, any other stays one."""
    q = F.lower("text")
    specific = F.when(has_any_phrase(q, "beyond the basics", "extra", "additional"), BEYOND_QUERY).otherwise(SPECIFIC_QUERY)
    texts = F.when(is_supporting_info(q), F.array(F.lit(BASIC_QUERY), specific, F.col("text"))).otherwise(F.array("text"))
    return queries.select("query_id", F.posexplode(texts).alias("sub", "text"))


METRICS = ("rerank_score", "fused_score", "dense_score", "bm25_score")


def merge_subqueries(candidates: DataFrame) -> DataFrame:
    """One row per query and chunk over its subqueries: each score's best, the rest from the first subquery that found it."""
    first = [c for c in candidates.columns if c not in (*METRICS, "query_id", "chunk_id", "sub")]
    return candidates.groupBy("query_id", "chunk_id").agg(*(F.max(c).alias(c) for c in METRICS), F.min_by(F.struct(*first), "sub").alias("x")).select("query_id", "chunk_id", *METRICS, "x.*")


def dedupe_and_cap(candidates: DataFrame, per_source: int = 8) -> DataFrame:
    """Best first: one candidate per place (source, page, kind, table, row), then at most per_source of a source; null is a source of its own. `place` is the order that is left."""
    best = (F.desc("rerank_score"), "chunk_id")
    place = Window.partitionBy("query_id", "source_file", "page", "block_type", "table_id", "row_id").orderBy(*best)
    rows = candidates.withColumn("nth", F.row_number().over(place)).where("nth = 1")
    source = Window.partitionBy("query_id", "source_file").orderBy(*best)
    rows = rows.withColumn("nth", F.row_number().over(source)).where(F.col("nth") <= per_source)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*best))).drop("nth")


def backfill(corpus: DataFrame, label: str, preferred: str) -> DataFrame:
    """The corpus's first chunk of a table, of the preferred kind if there is one."""
    rows = corpus.where(F.coalesce("table_title", F.lit("")).contains(label.replace("table", "Table ")))
    order = (F.when(F.col("block_type") == preferred, 0).otherwise(1), F.coalesce("page", F.lit(999)), F.coalesce("row_id", F.lit(999)), "chunk_id")
    return rows.orderBy(*order).limit(1).withColumn("forced_for_coverage", F.lit(True))


def select(candidates: DataFrame, queries: DataFrame, corpus: DataFrame, k: int = 8, per_source: int = 8) -> DataFrame:
    """The k results of each query. One about supporting information begins with the best of table 1 and of table 2, from the corpus where no candidate has them."""
    rows = dedupe_and_cap(candidates, per_source).withColumn("forced_for_coverage", F.lit(False))
    rows = rows.withColumn("label", table_label(F.col("table_title")))
    asked = queries.select("query_id", is_supporting_info(F.lower("text")).alias("support"))
    rows = rows.join(asked, "query_id")
    picks = []
    for n, (label, kind) in enumerate((("table1", "table"), ("table2", "table_row"))):
        order = Window.partitionBy("query_id").orderBy(F.when(F.col("block_type") == kind, 0).otherwise(1), "place")
        own = rows.where(F.col("support") & (F.col("label") == label)).withColumn("nth", F.row_number().over(order)).where("nth = 1").drop("nth")
        missing = asked.where("support").join(own.select("query_id"), "query_id", "left_anti")
        spare = missing.crossJoin(F.broadcast(backfill(corpus, label, kind)))  # one row
        fill = {c: F.col(c) if c in spare.columns else F.lit(0.0 if c in METRICS else None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns}
        picks.append(own.unionByName(spare.select(*fill.values())).withColumn("turn", F.lit(n)))
    forced = picks[0].unionByName(picks[1])
    others = rows.join(forced.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").withColumn("turn", F.col("place") + 1)
    order = Window.partitionBy("query_id").orderBy("turn")
    out = forced.unionByName(others).withColumn("result", F.row_number().over(order)).where(F.col("result") <= k)
    return out.drop("turn", "place", "support")


def attach_parents(results: DataFrame, parents: DataFrame) -> DataFrame:
    """Left join of each result's table: its text as parent_text. The latest of several parents wins."""
    p = parents.select("source_file", "table_id", F.col("text").alias("parent_text"), F.col("page").alias("parent_page")).where("source_file <> '' and table_id <> ''")
    p = p.groupBy("source_file", "table_id").agg(F.max(F.struct("parent_page", "parent_text")).alias("p")).select("source_file", "table_id", "p.parent_page", "p.parent_text")
    return results.join(p, ["source_file", "table_id"], "left")


def parent_rows(text: Column, most: int = 4) -> Column:
    """The first lines of a table's content that name a page."""
    content = F.when(text.contains("Content:"), F.regexp_extract(text, "(?s)^.*?Content:(.*)$", 1)).otherwise(text)
    return F.slice(F.filter(F.transform(F.split(content, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x.startswith("Page ")), 1, most)


def scaffold(results: DataFrame) -> DataFrame:
    """(query_id, scaffold): the four best pieces of evidence as lines."""
    section = F.coalesce(F.nullif("section_title", F.lit("")), F.nullif("table_title", F.lit("")), F.lit("Unknown section"))
    body = F.replace(F.regexp_replace(F.element_at(F.split("text", "Content:"), -1), r"^\s+|\s+$", ""), F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("- Section: "), section, F.lit(" | Source: "), F.coalesce("source_file", F.lit("")), F.lit(" | Page: "), F.coalesce(F.col("page").cast("string"), F.lit("None")), F.lit(" | Evidence: "), F.left(body, F.lit(260)))
    rows = results.where("result <= 4").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("result", line.alias("line")))), lambda x: x["line"]).alias("lines"))
    head = F.array(F.lit("Answer scaffold"), F.lit("---------------"), F.lit("Most relevant retrieved reference evidence:"))
    return rows.select("query_id", F.array_join(F.concat(head, "lines"), "\n").alias("scaffold"))


def answer(queries: DataFrame, corpus: DataFrame, parents: DataFrame, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, dense_k: int = 24, sparse_k: int = 24, k: int = 8, idx: Index | None = None) -> DataFrame:
    """Both lanes for every subquery, then one ranked, deduplicated list of k results per query, parents attached. idx: the corpus's index, if it was read."""
    subs = subqueries(queries)
    keyed = subs.select(F.struct("query_id", "sub").alias("query_id"), "text")
    sparse = bm25(keyed, idx or index(corpus), sparse_k)
    if vectors is not None and query_vectors is not None:
        vector = dense(query_vectors.select(F.struct("query_id", "sub").alias("query_id"), "embedding"), vectors, dense_k)
    else:
        vector = sparse.where("false").select("query_id", "chunk_id", F.lit(0.0).alias("dense_score"), F.lit(0).alias("dense_rank"))
    found = rerank(merge_lanes(sparse, vector), keyed, corpus, max(4 * k, 24))
    found = found.select(F.col("query_id.query_id").alias("query_id"), F.col("query_id.sub").alias("sub"), *(c for c in found.columns if c not in ("query_id", "query")))
    return attach_parents(select(merge_subqueries(found), queries, corpus, k), parents)
