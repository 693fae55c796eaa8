"""Model-based review as data: which rule sees which sections, results, metrics, summaries.

The model itself is a callable that the caller gives; it runs inside mapInPandas, one
call per task, and a failing call becomes a row with its error.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import replies

RESULT = "doc_id string, rule_name string, task int, status string, error string, findings array<struct<section_path:string,issue:string,severity:string,suggestion:string>>, input_tokens int, output_tokens int, token_source string, duration_seconds double"


def normal(c: Column) -> Column:
    return F.lower(F.replace(F.trim(c), F.lit(" "), F.lit("")))


def plan(rules: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, rule_name, task, section_paths): the model calls of each document.

    rules: name, scope; sections: doc_id, pos, title (the document's top-level parts).
    `full_document` and a list with "all" see everything in one call, `relevant_sections: a, b`
    those titles in one call (even if there are none), `section_type:*` each section in its own.
    """
    names = F.transform(F.split(F.regexp_replace("scope", r"^\s*relevant_sections:", ""), ","), normal)
    r = rules.select(F.col("name").alias("rule_name"), F.trim("scope").alias("scope")).withColumn("names", F.when(F.col("scope").startswith("relevant_sections:"), names))
    known = (F.col("scope") == "full_document") | (F.col("scope") == "section_type:*") | F.col("names").isNotNull()
    r = r.withColumn("scope", F.when(known, F.col("scope")).otherwise(F.raise_error(F.concat(F.lit("Unknown scope format: "), F.col("scope")))))
    docs = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "title"))).alias("parts"))
    every = docs.crossJoin(r)  # each rule is asked of each document
    whole = (F.col("scope") == "full_document") | F.coalesce(F.array_contains("names", "all"), F.lit(False))
    chosen = F.when(whole, F.col("parts")).otherwise(F.filter("parts", lambda p: F.coalesce(F.array_contains("names", normal(p["title"])), F.lit(False))))
    calls = F.when(F.col("scope") == "section_type:*", F.transform("parts", lambda p: F.array(p))).otherwise(F.array(chosen))
    t = every.select("doc_id", "rule_name", F.posexplode(calls).alias("task", "call"))
    return t.select("doc_id", "rule_name", "task", F.transform("call", lambda p: p["title"]).alias("section_paths"))


def message(body: Column, document_json: Column) -> Column:
    return F.concat(F.lit("<rule>\n"), body, F.lit("\n</rule>\n\n<document>\n"), document_json, F.lit("\n</document>"))


def estimated_tokens(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.greatest(F.lit(1), F.floor(F.length(text) / 4))).otherwise(F.lit(0)).cast("int")


def run(tasks: DataFrame, complete: Callable[[str], Any], at_once: int = 1) -> DataFrame:
    """RESULT rows of tasks with a `prompt` column: replies are JSON lists of findings, fenced or not.

    complete gives a text, or an object with text and token counts (`providers.Completion`); up to at_once calls of a partition run side by side.
    """

    def one(row: tuple) -> tuple:
        doc, rule, task, prompt = row
        began, reply, spent = time.time(), "", None
        try:
            spent = complete(prompt)
            reply = getattr(spent, "text", spent)
            found = [{k: " > ".join(f[k]) if isinstance(f[k], list) else f[k] for k in ("section_path", "issue", "severity", "suggestion")} for f in json.loads(reply.strip().removeprefix("```json").removeprefix("```").removesuffix("```"))]
            if bad := [f["severity"] for f in found if f["severity"] not in ("high", "medium", "low")]:
                raise ValueError(f"severity {bad[0]}")
            state, error = "success", None
        except Exception as e:  # noqa: BLE001 - errors are data
            state, error, found = "error", f"{type(e).__name__}: {e}"[:500], []
        got, put, source = max(1, len(prompt) // 4), max(1, len(reply) // 4) if reply else 0, "estimated"
        if spent is not None and hasattr(spent, "token_source"):
            got, put, source = spent.input_tokens, spent.output_tokens, spent.token_source
        return doc, rule, task, state, error, found, got, put, source, time.time() - began

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RESULT.split(", ") if not c.startswith(("issue", "severity", "suggestion"))]
        with ThreadPoolExecutor(at_once) as pool:
            for b in batches:
                yield pd.DataFrame(list(pool.map(one, zip(b["doc_id"], b["rule_name"], b["task"], b["prompt"], strict=True))), columns=names)

    return tasks.select("doc_id", "rule_name", "task", "prompt").mapInPandas(call, RESULT)


def completer(provider: str, model: str, system: str, **options: Any) -> Callable[[str], Any]:
    """What `run` calls: prompts to a model of an endpoint. Each worker makes its own on its first prompt, so keys are read there."""
    made: list[Any] = []

    def complete(prompt: str) -> Any:
        from quillspark.operators import providers

        if not made:
            made.append(providers.provider(provider, model, **options))
        return made[0].complete(system, prompt)

    return complete


def calls(plan: DataFrame) -> DataFrame:
    """(doc_id, calls): how many requests a review of each document makes."""
    return plan.groupBy("doc_id").agg(F.count("*").alias("calls"))


def grid(tasks: DataFrame, models: list[tuple[str, str]], complete: Callable[[str, str], Callable[[str], Any]]) -> DataFrame:
    """RESULT rows with provider and model, of every task under each (provider, model): complete(provider, model) gives what `run` calls. Models ending in :free are asked one prompt at a time."""
    out = None
    for provider, model in models:
        found = run(tasks, complete(provider, model), 1 if model.endswith(":free") else 8).select(F.lit(provider).alias("provider"), F.lit(model).alias("model"), "*")
        out = found if out is None else out.union(found)
    return out


def grid_runs(results: DataFrame) -> DataFrame:
    """A row per document, provider and model: status, figures, the errors of its rules by task, and where its files go."""
    by = ("doc_id", "provider", "model")
    errors = F.array_sort(F.collect_list(F.when(F.col("status") != "success", F.struct("rule_name", "task", "error"))))
    told = results.groupBy(*by).agg(errors.alias("errors"), F.round(F.sum("duration_seconds"), 3).alias("rule_seconds"))
    stem = F.concat_ws("/", F.col("doc_id"), F.concat(F.col("provider"), F.lit("__"), replies.slug(F.col("model"))))
    runs = summarize(results, *by).join(told, list(by))
    return runs.withColumn("status", F.when(F.col("rules_failed") == 0, "success").otherwise("error")).withColumn("results_path", F.concat(stem, F.lit(".json"))).withColumn("meta_path", F.concat(stem, F.lit("_meta.json")))


def grid_summary(runs: DataFrame) -> DataFrame:
    """One row: documents, models, runs, and the sums of the runs' figures."""
    sums = ("rules_attempted", "rules_succeeded", "rules_failed", "total_input_tokens", "total_output_tokens", "total_tokens", "total_findings")
    ok = F.col("status") == "success"
    return runs.agg(
        F.countDistinct("doc_id").alias("documents"), F.countDistinct("provider", "model").alias("models"), F.count("*").alias("runs_attempted"),
        F.count_if(ok).alias("runs_succeeded"), F.count_if(~ok).alias("runs_failed"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums),
        F.coalesce(F.bool_or("token_estimation_used"), F.lit(False)).alias("token_estimation_used"),
    )


def summarize(results: DataFrame, *by: str) -> DataFrame:
    """Counts, tokens and findings of rule results; failed rules have no findings."""
    ok = F.col("status") == "success"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return results.groupBy(*by).agg(
        F.count("*").alias("rules_attempted"), F.count_if(ok).alias("rules_succeeded"), F.count_if(~ok).alias("rules_failed"),
        total("input_tokens").alias("total_input_tokens"), total("output_tokens").alias("total_output_tokens"),
        total(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.coalesce(F.bool_or(F.col("token_source") == "estimated"), F.lit(False)).alias("token_estimation_used"),
        total(F.when(ok, F.size("findings")).otherwise(0)).alias("total_findings"),
    )


def by_rule(results: DataFrame) -> DataFrame:
    """(doc_id, rule_name, findings): the later task's findings win where a rule has several."""
    return results.groupBy("doc_id", "rule_name").agg(F.max_by("findings", "task").alias("findings"))
