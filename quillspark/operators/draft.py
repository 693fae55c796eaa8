"""Retrieval from a document's own draft: token overlap, path matches and intents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.phrases import contains_any, draft_tokens, has_any_phrase, has_phrase

# The intents of a question, and what they add by a section's path or text.
# An intent: (phrases, or "in:" and substrings of the question; steps). The first step that
# matches counts; a step is ("path" or "text", substrings, weight). Steps of `ALSO` count on their own.
INTENTS = (
    (("data deficient", "assessment rationale", "why is"), (("path", ("assessment rationale",), 2.8), ("text", ("data deficient",), 1.6))),
    (("extent of occurrence", "eoo"), (("path", ("extent of occurrence",), 3.0), ("text", ("eoo",), 1.6))),
    (("location", "locations"), (("path", ("locations information",), 3.0), ("path", ("very restricted aoo or number of locations",), 2.2), ("text", ("number of locations", "very restricted"), 1.4))),
    (("d2", "very restricted"), (("path", ("triggers vu d2",), 3.0), ("text", ("very restricted", "d2"), 1.6))),
    (("where is", "geographic", "distribution", "found geographically"), (("path", ("geographic range",), 2.4), ("path", ("> distribution",), 1.2), ("text", ("distribution",), 0.5))),
    (("country", "countries", "occur in", "occurrence"), (("path", ("countries of occurrence",), 3.2), ("text", ("<b>country</b>",), 1.8))),
    (("recorded from",), (("path", ("countries of occurrence",), 2.8),)),
    (("elevation", "altitude", "depth zone", "depth zones"), (("path", ("elevation / depth / depth zones",), 3.0), ("text", ("<b>elevation",), 1.6))),
    (("habitat", "ecology"), (("path", ("iucn habitats classification scheme",), 2.8), ("path", ("> habitats and ecology",), 1.8), ("text", ("habitat", "system:"), 0.8))),
    (("in:", "system"), (("path", ("> systems",), 3.0), ("text", ("<b>system: </b>", "<b>system:</b>"), 1.6))),
    (("use", "trade", "utilized"), (("path", ("use and trade",), 3.0), ("text", ("species not utilized", "known uses"), 1.4))),
    (("in:", "threat"), (("path", ("threats classification scheme",), 2.8), ("path", ("> threats",), 1.8), ("text", ("threat",), 0.6))),
    (("conservation actions are in place", "in place"), (("path", ("conservation actions in- place",), 3.0), ("text", ("occur in at least one pa",), 1.6))),
    (("conservation actions are needed", "actions needed"), (("path", ("important conservation actions needed",), 3.0),)),
    (("conservation work", "conservation measures needed", "extra conservation work"), (("path", ("important conservation actions needed",), 3.2),)),
    (("in:", "research"), (("path", ("research needed",), 2.8), ("text", ("<b>research</b>",), 1.5))),
    (("ecosystem service", "ecosystem services"), (("path", ("ecosystem services provided by the species",), 3.0), ("text", ("insufficient information available",), 1.4))),
    (("biogeographic", "realm", "realms"), (("path", ("biogeographic realms",), 3.0), ("text", ("biogeographic realm",), 1.6))),
    (("growth form", "growth forms", "plant growth"), (("path", ("plant specific",), 3.0), ("text", ("plant growth forms",), 1.6))),
    (("bibliography", "references", "reference", "cited", "citation", "citations", "literature"), (("path", ("bibliography",), 3.6),)),
)
STATUS = (("path", ("assessment information",), 3.4), ("text", ("red list status", "<b>status:</b>"), 1.8))
CATEGORY = (("path", ("assessment information",), 3.4), ("text", ("red list status", "vulnerable", "endangered", "critically endangered", "data deficient"), 1.8))
TREND = (("path", ("population information",), 3.0), ("text", ("current population trend",), 1.6))
POPULATION = (("path", ("population information",), 2.4), ("path", ("> population",), 1.8), ("text", ("population",), 0.5))
MAP_STATUS = (("path", ("map status",), 3.0), ("text", ("<b>map status</b>",), 1.6))
ROOT_TERMS = (
    "red list status", "data deficient", "extent of occurrence", "eoo", "location", "locations", "population", "country", "countries",
    "elevation", "habitat", "ecology", "system", "use", "trade", "threat", "conservation", "research", "ecosystem service", "biogeographic",
    "realm", "map status", "bibliography", "references", "citation", "cited",
)
SUPPORT_DIRECT = (
    "supporting information", "supporting info", "required information", "required data", "additional information", "additional data",
    "what do i need to include", "what must i include", "what should i include", "beyond the basics", "extra supporting info",
    "extra supporting information", "required under specific conditions",
)
SUPPORT_NOUNS = ("information", "info", "data", "documentation")
SUPPORT_VERBS = ("include", "included", "required", "need", "needed", "submit", "extra", "additional")
SUPPORT_PATHS = (
    (("assessment information",), 2.2), (("assessment rationale",), 1.8), (("locations information",), 2.2), (("population information",), 2.0),
    (("threats classification scheme",), 2.4), (("conservation actions in- place",), 2.0), (("important conservation actions needed",), 2.3),
    (("research needed",), 2.0), (("countries of occurrence",), 1.5), (("iucn habitats classification scheme", "> systems"), 1.4),
)
SUPPORT_MORE = (
    (("threats classification scheme",), 1.2), (("important conservation actions needed", "conservation actions in- place"), 1.2),
    (("locations information", "population information"), 1.0), (("assessment information",), -0.4),
)


def store(sections: DataFrame) -> DataFrame:
    """(doc_id, idx, section_path, source_key, text, tokens) of sections that say something, repeats of key and text once."""
    flat = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    path = F.trim(F.regexp_replace("section_key", r"(?i)\s+\[(?:paragraph|table|row)\s+\d+\]$", ""))
    path = F.when(path == "", "Assessment").otherwise(path)
    rows = sections.select("doc_id", "pos", path.alias("section_path"), F.col("section_key").alias("source_key"), flat(F.col("text")).alias("text")).where("text <> ''")
    first = F.row_number().over(Window.partitionBy("doc_id", "source_key", "text").orderBy("pos"))
    rows = rows.withColumn("nth", first).where("nth = 1")
    idx = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    plain = flat(F.regexp_replace("text", "<[^>]+>", " "))
    return rows.select("doc_id", idx.alias("idx"), "section_path", "source_key", "text", draft_tokens(F.concat("section_path", F.lit("\n"), plain)).alias("tokens"))


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts, F.lit(0.0))


def intent_boost(q: Column, path: Column, text: Column) -> Column:
    """All three in lower case."""
    field = {"path": path, "text": text}
    root = ~path.contains(">")
    path_has = lambda *p: contains_any(path, *p)

    def steps(spec: tuple) -> Column:
        out = None
        for where, parts, weight in spec:
            hit = contains_any(field[where], *parts)
            out = F.when(hit, F.lit(weight)) if out is None else out.when(hit, F.lit(weight))
        return out.otherwise(F.lit(0.0))

    when = lambda test, value: F.when(test, value).otherwise(F.lit(0.0))
    asks = lambda phrases: contains_any(q, *phrases[1:]) if phrases[0] == "in:" else has_any_phrase(q, *phrases)
    parts = [when(asks(phrases), steps(spec)) for phrases, spec in INTENTS]

    status = has_any_phrase(q, "red list status", "assessment status") | (q.contains("status") & q.contains("red list"))
    parts += [when(status, steps(STATUS)), when(status & path_has("assessment rationale"), F.lit(-0.4)), when(status & root, F.lit(-1.2))]
    category = (has_any_phrase(q, "red list category", "category") & has_any_phrase(q, "red list", "iucn")) | has_any_phrase(q, "currently listed", "currently in")
    parts += [when(category, steps(CATEGORY)), when(category & path_has("assessment rationale"), F.lit(-0.5))]
    trend = has_phrase(q, "population trend")
    parts += [when(trend, steps(TREND)), when(~trend & q.contains("population"), steps(POPULATION))]
    work = has_any_phrase(q, "conservation work", "conservation measures needed", "extra conservation work")
    parts.append(when(work & path_has("research needed") & ~q.contains("research"), F.lit(-0.5)))
    parts.append(when(has_any_phrase(q, "map status", "map") & q.contains("status"), steps(MAP_STATUS)))
    parts.append(when(root & has_any_phrase(q, *ROOT_TERMS), F.lit(-0.8)))

    support = has_any_phrase(q, *SUPPORT_DIRECT) | (has_any_phrase(q, *SUPPORT_NOUNS) & has_any_phrase(q, *SUPPORT_VERBS))
    more = has_any_phrase(q, "beyond the basics", "extra", "additional")
    extra = [when(path_has(*p), F.lit(w)) for p, w in SUPPORT_PATHS] + [when(root, F.lit(-1.2))] + [when(more & path_has(*p), F.lit(w)) for p, w in SUPPORT_MORE]
    return _sum([*parts, when(support, _sum(extra))])


def retrieve(queries: DataFrame, drafts: DataFrame, k: int = 6) -> DataFrame:
    """The k best draft sections of each query (query_id, doc_id, text) by score, then order; zero scores count. A query without tokens gets the first k."""
    asked = queries.select("query_id", "doc_id", F.col("text").alias("query"), F.array_distinct(draft_tokens(F.col("text"))).alias("asked"))
    rows = asked.join(drafts, "doc_id")
    path = F.lower("section_path")
    overlap = F.size(F.array_intersect("asked", F.array_distinct("tokens")))
    in_path = F.size(F.filter("asked", lambda t: path.contains(t))) * 0.75
    score = F.when(F.size("asked") == 0, F.lit(0.0)).otherwise(overlap + in_path + intent_boost(F.lower("query"), path, F.lower("text")))
    rows = rows.withColumn("raw", score)
    best = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("raw"), "idx"))
    return rows.withColumn("hit", best).where(F.col("hit") <= k).select("query_id", "doc_id", "hit", F.bround("raw", 3).alias("score"), "section_path", "source_key", "text")
