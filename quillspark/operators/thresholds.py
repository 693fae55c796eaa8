"""Deterministic lookup of category thresholds for questions that ask for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.phrases import contains_any
from quillspark.functions.spans import B, E

# The terms of a threshold question, and the answers.
TERMS = ("threshold", "thresholds", "cutoff", "cut-off", "criterion a", "criterion b", "criterion c", "criterion d", "criterion e", "b1", "b2", "d1", "d2", "extinction probability", "qualif")
CONTEXT = ("threshold", "cutoff", "criterion", "qualif")
CRITERIA = {
    "A": ("Population reduction", (
        "Criterion A uses percentage population reduction over the relevant time window.",
        "A1 thresholds: CR ≥ 90%, EN ≥ 70%, VU ≥ 50%.",
        "A2, A3 and A4 thresholds: CR ≥ 80%, EN ≥ 50%, VU ≥ 30%.",
    )),
    "B": ("Geographic range", (
        "Criterion B requires B1 (EOO) and/or B2 (AOO), plus at least 2 of 3 conditions: severe fragmentation or number of locations, continuing decline, or extreme fluctuations.",
        "B1 EOO thresholds: CR < 100 km², EN < 5,000 km², VU < 20,000 km².",
        "B2 AOO thresholds: CR < 10 km², EN < 500 km², VU < 2,000 km².",
        "Typical number of locations thresholds: CR = 1, EN ≤ 5, VU ≤ 10.",
    )),
    "C": ("Small population size and decline", (
        "Criterion C total mature-individual thresholds: CR < 250, EN < 2,500, VU < 10,000.",
        "C1 continuing decline thresholds: CR 25% in 3 years or 1 generation, EN 20% in 5 years or 2 generations, VU 10% in 10 years or 3 generations.",
    )),
    "D": ("Very small or restricted population", (
        "Criterion D thresholds: CR < 50 mature individuals, EN < 250 mature individuals, VU D1 < 1,000 mature individuals.",
        "Criterion D2 applies only to VU.",
    )),
    "E": ("Quantitative analysis", (
        "Criterion E extinction probability thresholds: CR ≥ 50% within 10 years or 3 generations (max 100 years), EN ≥ 20% within 20 years or 5 generations (max 100 years), VU ≥ 10% within 100 years.",
    )),
}
EOO = "Criterion B1 EOO thresholds: CR < 100 km², EN < 5,000 km², VU < 20,000 km²."
AOO = "Criterion B2 AOO thresholds: CR < 10 km², EN < 500 km², VU < 2,000 km²."
LOCATIONS = "Typical number of locations thresholds under Criterion B: CR = 1, EN ≤ 5, VU ≤ 10."
MATURE = "Criterion D thresholds: CR < 50 mature individuals, EN < 250 mature individuals, VU D1 < 1,000 mature individuals."
D2 = "Criterion D2 thresholds: AOO < 20 km² or number of locations ≤ 5, with a plausible future threat that could drive the taxon to CR or EX in a very short time."
EXTINCTION = CRITERIA["E"][1][0]


def is_threshold_query(query: Column) -> Column:
    q = F.lower(query)
    near = contains_any(q, *CONTEXT)
    return contains_any(q, *TERMS) | (contains_any(q, "aoo", "eoo") & near) | (contains_any(q, "locations", "mature individuals") & (near | contains_any(q, "d1", "d2", "b1", "b2")))


def criterion(query: Column) -> Column:
    """The criterion that a question names or implies, or null."""
    q = F.lower(query)
    named = F.nullif(F.regexp_extract(query, rf"(?i){B}criterion\s*([A-E]){E}", 1), F.lit(""))
    coded = F.nullif(F.regexp_extract(query, rf"(?i){B}([A-E])[12]{E}", 1), F.lit(""))
    implied = F.when(contains_any(q, "aoo", "eoo", "locations"), "B").when(q.contains("mature individuals"), "D").when(q.contains("extinction probability"), "E")
    return F.coalesce(F.upper(named), F.upper(coded), implied)


def _lines(*parts: Column) -> Column:
    return F.nullif(F.concat_ws("\n", *parts), F.lit(""))


def answer(query: Column) -> Column:
    """The text that answers a threshold question, or null where there is none."""
    q, c = F.lower(query), criterion(query)
    asks = lambda term, text: F.when(q.contains(term), F.lit(text))
    summary = {k: "\n".join([f"Criterion {k}: {title}", *lines]) for k, (title, lines) in CRITERIA.items()}
    return (
        F.when(c == "B", F.coalesce(_lines(asks("eoo", EOO), asks("aoo", AOO), asks("locations", LOCATIONS)), F.lit(summary["B"])))
        .when(c == "D", F.coalesce(_lines(asks("mature individuals", MATURE), asks("d2", D2)), F.lit(summary["D"])))
        .when((c == "E") & q.contains("extinction probability"), F.lit(EXTINCTION))
        .when(c == "E", F.lit(summary["E"]))
        .when(c == "A", F.lit(summary["A"]))
        .when(c == "C", F.lit(summary["C"]))
    )
