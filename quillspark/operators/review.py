"""Review of report sections by the rule catalogue.

`sections` has doc_id, pos (order in the document), section_key and text. Table rows
see the table rules, bibliographies theirs, all others the body rules; blank sections
see none. The body also carries a document's taxonomy forward: a ladder names genus,
species and higher taxa for the sections after it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import lexicons as lex
from quillspark.functions.spans import NONE, SPACE, TAGS, B, E, clean, cut, inside_italic, matches, original, plain, snippet
from quillspark.functions.phrases import any_of
from quillspark.operators.rules import ROUTES, SPANS, Rule, Text, needles

STYLE = "(?i)</?(?:i|em|b|strong|sup|sub)>"
FINDING = "struct<checker:int,method:int,pattern:int,start:int,end:int,mode:string,rule_class:string,rule_method:string,message:string,suggested_fix:string>"
NOTHING = f"array<{FINDING}>"
ORDER = ("doc_id", "pos", "checker", "method", "pattern", "start", "end")


def route(section_key: Column) -> Column:
    """table before bibliography before body."""
    return F.when(section_key.rlike(rf"(?i)\[table{SPACE}+\p{{Nd}}+\]"), "table").when(F.lower(section_key).contains("bibliography"), "bibliography").otherwise("body")


def section_name(section_key: Column) -> Column:
    """Without a trailing paragraph marker; table markers stay."""
    return F.regexp_replace(section_key, rf"{SPACE}+\[paragraph{SPACE}+\p{{Nd}}+\]$", "")


def display_name(section_key: Column) -> Column:
    """Without any paragraph, table or row marker."""
    return F.regexp_replace(section_key, r"(?i)\s+\[(?:paragraph|table|row)\s+\d+\]", "")


def routed(sections: DataFrame) -> DataFrame:
    """Sections that are not blank, with their route."""
    s = sections.select("doc_id", "pos", "section_key", plain(F.col("text")).alias("text"))
    return s.where(F.regexp_replace("text", SPACE, "") != "").withColumn("route", route(F.col("section_key")))


def _ladder(text: Column) -> Column:
    """Taxonomy of a section that is a ladder (six parts or more, four of them capitals, two names at the end), else null."""
    parts = F.filter(F.transform(F.split(text, " - ", -1), lambda p: F.regexp_replace(p, rf"^{SPACE}+|{SPACE}+$", "")), lambda p: p != "")
    capitals = F.filter(parts, lambda p: p.rlike("^[A-Z][A-Z]+$"))
    genus, species = F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 1)
    name = "^[A-Za-z][A-Za-z-]*$"
    is_one = (F.size(parts) >= 6) & (F.size(capitals) >= 4) & genus.rlike(name) & species.rlike(name)
    value = F.struct(
        F.transform(capitals, F.initcap).alias("higher"),
        F.concat(F.upper(F.substring(genus, 1, 1)), F.lower(F.substring(genus, 2, 1000))).alias("genus"),
        F.lower(species).alias("species"),
    )
    return F.when(is_one, value)


def taxonomy(sections: DataFrame) -> DataFrame:
    """Routed sections with `ladder` (their own) and higher, genus and species as known from the document up to them."""
    s = sections.withColumn("ladder", F.when(F.col("route") == "body", _ladder(clean(F.col("text"), "italics"))))
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        s.withColumn("higher", F.array_distinct(F.flatten(F.collect_list("ladder.higher").over(so_far))))
        .withColumn("genus", F.last("ladder.genus", ignorenulls=True).over(so_far))
        .withColumn("species", F.last("ladder.species", ignorenulls=True).over(so_far))
    )


def _named(t: Column, name: Column) -> Column:
    """Matches of a name, with its italic tags where it has both."""
    one = F.concat(F.lit(rf"{B}\Q"), name, F.lit(rf"\E{E}"))
    return matches(t, F.concat(F.lit("(?iu)<(?:i|em)>"), one, F.lit("</(?:i|em)>|"), one))


def _state_findings(t: Column, higher: Column, genus: Column, species: Column) -> Column:
    """Findings on the names that the document has introduced."""
    bare = lambda m: F.regexp_replace(m["text"], "(?i)</?(?:i|em)>", "")
    tagged = lambda m: m["text"].startswith("<")

    def finding(m: Column, method: int, order: Column, name: str, message: Column, fix: Column) -> Column:
        return F.struct(
            F.lit(2).alias("checker"), F.lit(method).alias("method"), order.alias("pattern"), m["start"].alias("start"), m["end"].alias("end"),
            F.lit("italics").alias("mode"), F.lit("FormattingChecker").alias("rule_class"), F.lit(f"FormattingChecker.{name}").alias("rule_method"),
            message.alias("message"), fix.alias("suggested_fix"),
        )

    def of_name(n: Column, i: Column) -> Column:
        wrong = F.filter(_named(t, n["name"]), lambda m: ~((tagged(m) | inside_italic(t, m["start"], m["end"])) & (bare(m) == n["name"])))
        say = F.concat(F.lit("Scientific names should be italicized and use correct case: '<i>"), n["name"], F.lit("</i>'"))
        return F.transform(wrong, lambda m: finding(m, 0, i, "check_genus_and_species", say, F.concat(F.lit("Italicized: "), n["name"])))

    def of_taxon(n: Column, i: Column) -> Column:
        wrong = F.filter(_named(t, n), lambda m: tagged(m) | (bare(m) != n))
        say = F.concat(F.lit("Family/taxonomy names should be capitalized and not italicized: '"), n, F.lit("'"))
        return F.transform(wrong, lambda m: finding(m, 1, i, "check_higher_order_taxonomy_formatting", say, n))

    extra = lambda own, more: F.sort_array(F.array_distinct(F.concat(F.array(own), F.array(*map(F.lit, more)))))
    as_name = lambda names: F.transform(names, lambda x: F.struct(x.alias("name")))
    names = F.concat(as_name(extra(genus, lex.EXTRA_GENUS)), as_name(extra(species, lex.EXTRA_SPECIES)))
    taxa = F.array_distinct(F.concat(higher, F.array(*map(F.lit, lex.EXTRA_HIGHER))))
    taxa = F.transform(F.array_sort(F.transform(taxa, lambda x: F.struct((-F.length(x)).alias("n"), x.alias("x")))), lambda s: s["x"])
    nothing = F.array().cast(NOTHING)
    first = F.when(genus.isNotNull() & species.isNotNull(), F.flatten(F.transform(names, of_name))).otherwise(nothing)
    second = F.when(F.size(higher) > 0, F.flatten(F.transform(taxa, of_taxon))).otherwise(nothing)
    return F.concat(first.cast(NOTHING), second.cast(NOTHING))


def tags_of(text: Column, mode: str) -> Column:
    """The tags that cleaning in a mode takes out."""
    return F.when(text.contains("<"), matches(text, TAGS[mode])).otherwise(F.array().cast(NONE))


def located(rows: DataFrame) -> DataFrame:
    """Findings with their offsets mapped back to the section's own text, with matched text and context."""
    rows = rows.withColumn("from", original(F.col("tags"), F.col("start"))).withColumn("to", original(F.col("tags"), F.col("end") - 1) + 1)
    return rows.select(
        "doc_id", "pos", section_name(F.col("section_key")).alias("section_name"), "checker", "method", "pattern", F.col("from").alias("start"), F.col("to").alias("end"),
        "rule_class", "rule_method", cut(F.col("text"), F.col("from"), F.col("to")).alias("matched_text"),
        snippet(F.col("text"), F.col("from"), F.col("to")).alias("matched_snippet"), "message", "suggested_fix",
    )


FOUND = ("doc_id", "pos", "section_key", "text", "checker", "method", "pattern", "start", "end", "tags", "rule_class", "rule_method", "message", "suggested_fix")


def findings(sections: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """A row for each match of these rules that passes its guard, in offsets of the cleaned text."""
    modes = sorted({r.mode for r in rules})
    s = sections.withColumns({f"clean_{m}": clean(F.col("text"), m) for m in modes} | {f"tags_{m}": tags_of(F.col("text"), m) for m in modes})
    # spans that guards ask for, once a section
    s = s.withColumns({c: spans(F.col("clean_all")) if any(r.needs == c for r in rules) else F.array().cast(NONE) for c, spans in SPANS.items()})
    as_data = lambda x: F.lit(x if isinstance(x, str) else None).cast("string")
    catalogue = F.array(*(F.struct(F.lit(k).alias("rule"), F.lit(r.mode).alias("mode"), F.lit(r.regex).alias("regex"), as_data(r.message).alias("message"), as_data(r.fix).alias("fix")) for k, r in enumerate(rules)))

    def of_mode(mode: Column, what: str = "clean") -> Column:
        out = F.col(f"{what}_{modes[0]}")
        for m in modes[1:]:
            out = F.when(mode == m, F.col(f"{what}_{m}")).otherwise(out)
        return out

    def of_rule(r: Column) -> Column:
        return F.transform(matches(of_mode(r["mode"]), r["regex"]), lambda m: F.struct(r["rule"].alias("rule"), r["mode"].alias("mode"), r["message"].alias("message"), r["fix"].alias("fix"), m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("match")))

    # most rules don't occur in a text: plain searches in its folded form (as patterns ignore case) tell that sooner than patterns
    s = s.withColumns({f"fold_{m}": F.lower(F.upper(F.translate(F.col(f"clean_{m}"), "İ", "i"))) for m in modes})

    def may_occur(r: Rule) -> Column:
        some, digit = needles(r)
        tests = [any_of([F.col(f"fold_{r.mode}").contains(x) for x in some])] if some else []
        tests += [F.col(f"clean_{r.mode}").rlike(r"\p{Nd}")] if digit else []
        return reduce(lambda a, b: a & b, tests) if tests else F.col(f"clean_{r.mode}").rlike(r.regex)

    occurs = F.array(*map(may_occur, rules))
    some = F.filter(F.zip_with(catalogue, occurs, lambda r, hit: F.struct(r.alias("r"), hit.alias("hit"))), lambda x: x["hit"])
    rows = s.select("*", F.explode(F.flatten(F.transform(some, lambda x: of_rule(x["r"])))).alias("f")).select(*s.columns, "f.*")
    text, t = Text(F.col("section_key"), F.col("text"), F.col("known_names"), F.col("link_spans")), of_mode(F.col("mode"))
    m = {"start": F.col("start"), "end": F.col("end"), "text": F.col("match"), "fix": F.col("fix")}

    def case(of: str, value: Callable, otherwise: Column) -> Column:
        """One branch for all rules that share a function."""
        shared: dict = {}
        for k, r in enumerate(rules):
            if callable(getattr(r, of)):
                shared.setdefault(getattr(r, of), []).append(k)
        out = None
        for f, ks in shared.items():
            hit = F.col("rule").isin(*ks)
            out = F.when(hit, value(f)) if out is None else out.when(hit, value(f))
        return otherwise if out is None else out.otherwise(otherwise)

    rows = rows.where(case("guard", lambda f: f(text, t, m), F.lit(True)))
    by_rule = lambda field: F.element_at(F.array(*(F.lit(field(r)) for r in rules)), F.col("rule") + 1)
    return rows.select(
        "doc_id", "pos", "section_key", "text", by_rule(lambda r: r.checker).alias("checker"), by_rule(lambda r: r.method).alias("method"), by_rule(lambda r: r.pattern).alias("pattern"),
        case("part", lambda f: f(m)[0], F.col("start")).alias("start"), case("part", lambda f: f(m)[1], F.col("end")).alias("end"), of_mode(F.col("mode"), "tags").alias("tags"),
        by_rule(lambda r: r.cls).alias("rule_class"), by_rule(lambda r: f"{r.cls}.{r.name}").alias("rule_method"),
        case("message", lambda f: f(m), F.col("message")).alias("message"), case("fix", lambda f: f(m), F.col("fix")).alias("suggested_fix"),
    )


def check(sections: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Violations of some of the body's rules in body sections."""
    return located(findings(routed(sections).where("route = 'body'"), rules))


def check_taxonomy(sections: DataFrame) -> DataFrame:
    """Violations of the rules that need the document's taxonomy; a ladder itself is not checked."""
    s = taxonomy(routed(sections)).where("route = 'body' and ladder is null and genus is not null").withColumn("tags", tags_of(F.col("text"), "italics"))
    found = _state_findings(clean(F.col("text"), "italics"), F.col("higher"), F.col("genus"), F.col("species"))
    return located(s.select("doc_id", "pos", "section_key", "text", "tags", F.explode(found).alias("f")).select("doc_id", "pos", "section_key", "text", "tags", "f.*").select(*FOUND))


def review(sections: DataFrame) -> DataFrame:
    """All violations of all sections; sort by ORDER for the order in which a reader would meet them."""
    s = routed(sections)
    out = check_taxonomy(sections)
    for name, rules in ROUTES.items():
        out = out.unionByName(located(findings(s.where(F.col("route") == name), rules)))
    return out


def clean_up(violations: DataFrame) -> DataFrame:
    """Style tags gone from what is shown; fixes stay as they are."""
    return violations.withColumns({c: F.regexp_replace(c, STYLE, "") for c in ("matched_text", "matched_snippet", "message")})


def grouped(violations: DataFrame, sections: DataFrame) -> DataFrame:
    """Violations by displayed section, groups in the order of their first section; those without one last, as the whole document."""
    shown = violations.withColumn("display_name", F.coalesce(display_name(F.col("section_name")), F.lit("Whole document")))
    order = sections.groupBy("doc_id", display_name(F.col("section_key")).alias("display_name")).agg(F.min("pos").alias("group_pos"))
    fields = ("pos", "checker", "method", "pattern", "start", "end", "rule_class", "rule_method", "matched_text", "matched_snippet", "message", "suggested_fix")
    groups = shown.groupBy("doc_id", "display_name").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("violations"))
    return groups.join(order, ["doc_id", "display_name"], "left").select("doc_id", "group_pos", "display_name", F.size("violations").alias("n"), "violations")
