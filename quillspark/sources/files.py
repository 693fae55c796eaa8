"""Files in and out: JSON lines of records, rules with a front matter, feedback tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.schemas import RECORD


def read_records(spark: SparkSession, pattern: str) -> DataFrame:
    """Records of JSON-lines files, a file a row first: blank ones are left out, a missing doc_id names file and line, a line that is no JSON object raises with both."""
    texts = spark.read.text(pattern, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    lines = texts.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "line"))
    is_object = F.schema_of_variant(F.try_parse_json("line")).startswith("OBJECT")
    wrong = F.raise_error(F.concat(F.lit("Malformed record: "), F.col("file"), F.lit(", line "), (F.col("at") + 1).cast("string")))
    value = F.when(F.col("line").rlike(r"^\s*$"), None).when(F.coalesce(is_object, F.lit(False)), F.col("line")).otherwise(wrong)
    r = lines.select("file", "at", value.alias("value")).select("file", "at", F.from_json("value", RECORD + ", pdf_stem string").alias("r"), F.get_json_object("value", "$.priority").isNull().alias("plain")).select("file", "at", "plain", "r.*")
    stem = F.element_at(F.split("file", "/"), -2)
    r = r.where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return r.select(
        F.coalesce("doc_id", F.concat(stem, F.lit("::line::"), F.format_string("%05d", F.col("at") + 1))).alias("doc_id"), F.coalesce("pdf_stem", stem).alias("pdf_stem"),
        F.when(F.col("plain"), F.lit(1.0)).otherwise(F.col("priority")).alias("priority"), *(c for c in r.columns if c not in ("file", "at", "plain", "doc_id", "pdf_stem", "priority")),
    )


def load_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of all documents' folders under a folder; raises where there are none."""
    r = read_records(spark, f"{folder}/*/retrieval_blocks.jsonl")
    if not r.limit(1).count():
        raise ValueError(f"No retrieval records found: {folder}")
    return r


def read_rules(spark: SparkSession, folder: str) -> DataFrame:
    """(name, scope, severity, category, body) of Markdown files that begin with a front matter; one that lacks a field raises."""
    files = spark.read.text(f"{folder}/*.md", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.md$", 1).alias("name"), F.col("value"))
    head, body = F.regexp_extract("value", r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)", 1), F.regexp_replace("value", r"(?s)^---\s*\n.*?\n---\s*(?:\n|$)", "")

    def field(name: str):
        value = F.regexp_extract(head, rf"(?m)^{name}:\s*(.*?)\s*$", 1)
        value = F.regexp_replace(value, r"""^(['"])(.*)\1$""", "$2")
        return F.when(value != "", value).otherwise(F.raise_error(F.concat(F.lit("Rule "), F.col("name"), F.lit(f" missing front matter field: {name}")))).alias(name)

    return files.select("name", field("scope"), field("severity"), field("category"), F.regexp_replace(body, r"^\s+|\s+\z", "").alias("body"))


def feedback_rows(grouped: DataFrame) -> DataFrame:
    """A row per violation of grouped ones, under the headings of the feedback table; nulls become empty."""
    v = grouped.select("display_name", "group_pos", F.posexplode("violations").alias("nth", "v"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return v.select("group_pos", "nth", F.col("display_name").alias("Section title"), text("v.matched_text").alias("Matched text"), text("v.matched_snippet").alias("Context"), text("v.message").alias("Message"), text("v.suggested_fix").alias("Suggested fix"))


def finding_rows(results: DataFrame) -> DataFrame:
    """A row per finding of rule results."""
    f = results.select("rule_name", F.explode("findings").alias("f"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return f.select(text("rule_name").alias("Rule name"), text("f.section_path").alias("Report section"), text("f.severity").alias("Severity"), text("f.issue").alias("Feedback"), text("f.suggestion").alias("Suggestion"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_batch(parsed: DataFrame, summary: DataFrame, path: str) -> None:
    """A batch's blocks as JSON, a folder for each document that could be parsed, and its summary with the errors of the others."""
    parsed.where("error is null").drop("error").write.mode("overwrite").partitionBy("doc_title").json(f"{path}/documents")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/_errors")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
