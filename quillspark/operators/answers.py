"""Answers to questions: evidence scaffolds, grounded prompts and what a model's reply becomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.phrases import contains_any
from quillspark.operators import retrieval, thresholds

# The wording of scaffolds and prompts, and their limits.
EXCERPTS, PARENT_CHARS, DRAFT_CHARS, SNIPPET_CHARS = 4, 700, 800, 260
HEAD = ("Answer scaffold", "---------------")
FOR_ALL, FOR_SOME = "Required for all assessments:", "Additional required under specific conditions relevant to threatened taxa:"
NONE_FOR_ALL, NONE_FOR_SOME = "- No clean Table 1 evidence selected.", "- No clean Table 2 evidence selected."
SPECIFIC_FIRST = ("beyond the basics", "extra", "additional", "specific conditions")
OPENING = "You are reviewing an IUCN assessment draft using retrieved evidence."
CLOSING = (
    "", "Instructions:", "- Deterministic reference facts are authoritative when present.", "- Use retrieved reference evidence to add context and detail.",
    "- Use draft assessment evidence only to describe what the uploaded draft appears to contain.",
    "- If the draft is silent on a point, say that it is not evident from the retrieved draft evidence.", "", "Write a grounded answer with these headings:",
    "1. Deterministic reference facts", "2. What the IUCN reference documents require", "3. What the uploaded draft appears to contain", "4. Any uncertainty", "",
    "Do not invent requirements that are not supported by the evidence.",
)


def supporting_scaffold(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, scaffold) of questions about supporting information: table 1, by its parent's rows where there are any, and table 2, in the order that the question suggests."""
    body = F.regexp_replace(F.element_at(F.split("text", "Content:"), -1), r"^\s+|\s+$", "")
    own_rows = F.when(F.col("parent_text").isNotNull(), retrieval.parent_rows(F.col("parent_text"))).when(F.col("block_type") == "table", retrieval.parent_rows(F.col("text")))
    r = results.withColumn("label", retrieval.table_label(F.col("table_title"))).withColumn("rows", F.when(F.size(own_rows) > 0, own_rows)).withColumn("body", body)
    ordered = lambda label, value: F.transform(F.array_sort(F.collect_list(F.when((F.col("label") == label) & value.isNotNull(), F.struct("result", value.alias("x"))))), lambda s: s["x"])
    g = r.groupBy("query_id").agg(ordered("table1", F.col("rows")).alias("parent"), ordered("table1", F.col("body")).alias("one"), ordered("table2", F.col("body")).alias("two"))
    g = queries.select("query_id", F.lower("text").alias("q")).where(retrieval.is_supporting_info(F.col("q"))).join(g, "query_id", "left")
    none = F.array().cast("array<string>")
    lines = lambda items, spare: F.when(F.size(items) > 0, F.transform(F.slice(items, 1, 4), lambda x: F.concat(F.lit("- "), F.left(x, F.lit(SNIPPET_CHARS))))).otherwise(F.array(F.lit(spare)))
    one = F.coalesce(F.get("parent", F.lit(0)), F.col("one"), none)
    first = F.concat(F.array(F.lit(FOR_ALL)), lines(one, NONE_FOR_ALL))
    second = F.concat(F.array(F.lit(FOR_SOME)), lines(F.coalesce("two", none), NONE_FOR_SOME))
    gap = F.array(F.lit(""))
    text = F.when(contains_any(F.col("q"), *SPECIFIC_FIRST), F.concat(second, gap, first)).otherwise(F.concat(first, gap, second))
    return g.select("query_id", F.array_join(F.concat(F.array(*map(F.lit, HEAD)), text), "\n").alias("scaffold"))


def prompts(queries: DataFrame, results: DataFrame, draft_hits: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt): threshold facts, scaffold, excerpts with their parents and the draft's sections, in the wording that the model gets."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    line = F.concat(F.lit("- Result "), F.col("result").cast("string"), F.lit(" | Source: "), text("source_file"), F.lit(" | Page: "), text("page"), F.lit(" | Block type: "), text("block_type"), F.lit(" | Section: "), text("section_title"), F.lit(" | Text: "), text("text"))
    parent = F.when(text("parent_text") != "", F.concat(F.lit("\n  Parent context: "), F.left("parent_text", F.lit(PARENT_CHARS)))).otherwise(F.lit(""))
    joined = lambda order, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("x")))), lambda s: s["x"]), "\n")
    excerpts = results.where(F.col("result") <= EXCERPTS).groupBy("query_id").agg(joined("result", F.concat(line, parent)).alias("excerpts"))
    scaffolds = retrieval.scaffold(results).withColumnRenamed("scaffold", "general").join(supporting_scaffold(results, queries), "query_id", "full_outer")
    q = queries.join(excerpts, "query_id", "left").join(scaffolds, "query_id", "left")
    if draft_hits is None:
        q = q.withColumn("draft", F.lit("No draft has been uploaded for review."))
    else:
        hit = F.concat(F.lit("- Section: "), F.col("section_path"), F.lit(" | Source key: "), text("source_key"), F.lit(" | Score: "), F.col("score").cast("string"), F.lit(" | Text: "), F.left("text", F.lit(DRAFT_CHARS)))
        hits = draft_hits.groupBy("query_id").agg(F.concat(F.lit("Draft assessment evidence (top 6 chunks):\n"), joined("hit", hit)).alias("draft"))
        q = q.join(hits, "query_id", "left").withColumn("draft", F.coalesce("draft", F.lit("Draft assessment evidence: No draft chunks were available for this prompt.")))
    parts = (
        F.lit(OPENING), F.concat(F.lit("User question: "), F.col("text")), F.lit(""), F.lit("Deterministic reference facts:"),
        F.coalesce(F.when(thresholds.is_threshold_query(F.col("text")), thresholds.answer(F.col("text"))), F.lit("No deterministic reference facts matched this question.")), F.lit(""),
        F.lit("Retrieved reference evidence scaffold:"), F.coalesce("scaffold", "general", F.lit("No reference scaffold available.")), F.lit(""),
        F.lit("Retrieved reference evidence excerpts:"), F.coalesce("excerpts", F.lit("- No retrieved reference chunks were available.")), F.lit(""), F.col("draft"), *map(F.lit, CLOSING),
    )
    return q.select("query_id", F.concat_ws("\n", *parts).alias("prompt"))


def reply_text(configured: Column, output: Column, error: Column) -> Column:
    """What a reader sees of a model's reply."""
    return (
        F.when(~configured, "External LLM not configured")
        .when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("External LLM request failed: "), error))
        .when(F.coalesce(output, F.lit("")) == "", "External LLM returned no final answer")
        .otherwise(output)
    )
