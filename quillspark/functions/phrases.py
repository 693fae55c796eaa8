"""Phrase predicates and the two retrieval tokenizers."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions.spans import B, E

# Token shapes and the words that draft retrieval leaves out.
TOKEN = r"[A-Za-z0-9][A-Za-z0-9()\[\].,/%:+\-_–—]*"
DRAFT_TOKEN = r"[A-Za-z0-9][A-Za-z0-9()\[\].,/%:+\-_]*"
STOPWORDS = (
    "about", "a", "according", "already", "an", "and", "any", "are", "as", "at", "be", "beyond", "by", "does", "draft", "extra", "for",
    "from", "how", "in", "is", "it", "its", "known", "main", "many", "of", "official", "on", "or", "roughly", "say", "separate", "species",
    "that", "the", "this", "to", "what", "where", "which",
)


def tokens(text: Column) -> Column:
    """Lower-cased tokens in order, with what punctuation they end in."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1)), F.lower)


def draft_tokens(text: Column) -> Column:
    """Tokens with their singular forms, stop words out, repeats kept."""
    stop = F.array(*map(F.lit, STOPWORDS))

    def forms(t: Column) -> Column:
        n = F.length(t)
        some = F.array(
            t,
            F.when(t.endswith("ies") & (n > 4), F.concat(F.substring(t, F.lit(1), n - 3), F.lit("y"))),
            F.when(t.endswith("es") & (n > 4), F.substring(t, F.lit(1), n - 2)),
            F.when(t.endswith("s") & (n > 3), F.substring(t, F.lit(1), n - 1)),
        )
        kept = F.array_sort(F.array_distinct(F.filter(some, lambda x: x.isNotNull() & (x != "") & ~F.array_contains(stop, x))))
        return F.when(F.array_contains(stop, t), F.array().cast("array<string>")).otherwise(kept)

    words = F.transform(F.regexp_extract_all(text, F.lit(f"({DRAFT_TOKEN})"), F.lit(1)), F.lower)
    return F.flatten(F.transform(words, forms))


def has_phrase(text: Column, phrase: str) -> Column:
    """Whole words, however far apart their spaces; a phrase with other marks is a plain substring. text is lower case."""
    p = phrase.strip().lower()
    if not p:
        return F.lit(False)
    if all(c.isalnum() or c.isspace() for c in p):
        return text.rlike(B + r"\s+".join(map(re.escape, p.split())) + E)
    return text.contains(p)


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def has_any_phrase(text: Column, *phrases: str) -> Column:
    return any_of([has_phrase(text, p) for p in phrases])


def contains_any(text: Column, *parts: str) -> Column:
    return any_of([text.contains(p) for p in parts])
