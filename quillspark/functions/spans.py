"""Regex matches with offsets, tag removal and context, as Column expressions.

Spark's regex functions give strings, not offsets. Here a match is wrapped in two
private-use code points by one regexp_replace over the whole text (so lookarounds see
all of it), split at them, and a fold over the parts gives each match its offsets.
Offsets count code points from 0, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPEN, CLOSE = "", ""
#: Letters, numbers and underscore: what Python's \\w takes; Java's takes marks too, or ASCII only.
WORD = r"\p{L}\p{N}_"
#: Not preceded, and not followed, by such a character.
B, E = rf"(?<![{WORD}])", rf"(?![{WORD}])"
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"
SPAN = "struct<start:int,end:int,text:string>"
NONE = f"array<{SPAN}>"


def plain(text: Column) -> Column:
    """Without the two code points that mark matches."""
    return F.translate(text, OPEN + CLOSE, "")


def matches(text: Column, pattern: str | Column) -> Column:
    """Array of (start, end, text) of all non-empty matches, left to right."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    marked = F.regexp_replace(text, pattern, F.lit(f"{OPEN}$0{CLOSE}"))
    parts = F.split(marked, f"[{OPEN}{CLOSE}]", -1)

    def step(acc: Column, part: Column) -> Column:
        end = acc["pos"] + F.length(part)
        one = F.array(F.struct(acc["pos"].alias("start"), end.alias("end"), part.alias("text")))
        return F.struct(end.alias("pos"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    begin = F.struct(F.lit(0).alias("pos"), F.lit(False).alias("inside"), F.array().cast(NONE).alias("out"))
    return F.when(marked == text, F.array().cast(NONE)).otherwise(F.aggregate(parts, begin, step, lambda acc: acc["out"]))


def tag_pattern(*names: str) -> str:
    return "(?i)</?(?:" + "|".join(names) + ")>"


#: Which style tags are removed before a rule looks at a text.
TAGS = {
    "all": tag_pattern("i", "em", "b", "strong", "sup", "sub"),
    "scripts": tag_pattern("i", "em", "b", "strong"),
    "italics": tag_pattern("b", "strong", "sup", "sub"),
}


def clean(text: Column, mode: str = "all") -> Column:
    """The text without the tags of a mode; `scripts` and `italics` name what stays."""
    return F.regexp_replace(text, TAGS[mode], "")


def original(tags: Column, at: Column) -> Column:
    """Offset in the original text of offset `at` of the cleaned one; tags: their matches in the original."""
    return F.aggregate(tags, at, lambda p, t: F.when(t["start"] <= p, p + t["end"] - t["start"]).otherwise(p))


def cut(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, end - start)


#: Code points beside a span that are looked at first.
WINDOW = 200


def snippet(text: Column, start: Column, end: Column, around: int = 2) -> Column:
    """The tokens that a span overlaps and `around` more on either side. Only a window beside the span is looked at, unless these tokens are longer."""
    solid = f"[^{SPACE[1:-1]}]"
    inside = cut(text, start, end)

    def near(side: Column, edge: Column) -> Column:
        """From the span outwards: the rest of its outer token, unless that edge is a space, and whole tokens."""
        whole = F.regexp_extract(side, rf"^{solid}*(?:{SPACE}+{solid}+){{0,{around}}}", 0)
        apart = F.regexp_extract(side, rf"^(?:{SPACE}*{solid}+){{0,{around}}}", 0)
        return F.when(edge.rlike(SPACE), apart).otherwise(whole)

    def beside(some: Column, every: Column, edge: Column) -> Column:
        """What is near, from the window if that ends within it."""
        found = near(some, edge)
        return F.when(F.length(found) < WINDOW, found).otherwise(near(every, edge))

    ahead = F.reverse(F.substring(text, F.greatest(F.lit(1), start - WINDOW + 1), F.least(F.lit(WINDOW), start)))
    left = F.reverse(beside(ahead, F.reverse(F.substring(text, F.lit(1), start)), F.substring(inside, 1, 1)))
    right = beside(F.substring(text, end + 1, F.lit(WINDOW)), F.substring(text, end + 1, F.length(text)), F.substring(inside, -1, 1))
    core = F.when(left == "", F.regexp_replace(inside, f"^{SPACE}+", "")).otherwise(inside)
    core = F.when(right == "", F.regexp_replace(core, f"{SPACE}+$", "")).otherwise(core)
    return F.concat(left, core, right)


def inside_italic(text: Column, start: Column, end: Column) -> Column:
    """The last italic tag before the span opens one, and one closes after it."""
    opened = F.substring(text, F.lit(1), start).rlike(r"(?s)<(?:i|em)>(?!.*</(?:i|em)>)")
    after = F.substring(text, end + 1, F.length(text))
    return opened & (after.contains("</i>") | after.contains("</em>"))
