"""The catalogue of review rules: each turns a section's text into an array of findings.

A rule is data: its place in the order, the cleaned text it reads, a pattern, and
expressions for guard, message and fix. All rules of a section are evaluated in one
projection, so a review needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspark.functions import lexicons as lex
from quillspark.functions.spans import SPACE, WORD, B, E, cut, inside_italic, matches

S = SPACE
D = r"\p{Nd}"

@dataclass(frozen=True)
class Text:
    """What guards see of a section: its name, its own text, and spans of its cleaned text: accepted names and links."""

    name: Column
    raw: Column
    known: Column
    links: Column


#: A match: start, end and text, and its rule's term and fix.
Match = dict[str, Column]


@dataclass(frozen=True)
class Rule:
    """Messages and fixes that are plain text are data; functions of the match become branches of one CASE, shared by all rules that name the same function."""

    checker: int
    method: int
    pattern: int
    cls: str
    name: str
    regex: str
    message: Callable[[Match], Column] | str
    fix: Callable[[Match], Column] | str | None = None
    mode: str = "all"
    guard: Callable[[Text, Column, Match], Column] | None = None  # (section, its cleaned text, match)
    part: Callable[[Match], tuple[Column, Column]] | None = None  # start and end of what is reported
    term: str | None = None
    needs: str | None = None  # which of SPANS the guard asks for


def _group(m: Match, regex: str, k: int = 1) -> Column:
    return F.regexp_extract(m["text"], regex, k)


def _before(t: Column, m: Match) -> Column:
    return F.substring(t, F.lit(1), m["start"])


def _after(t: Column, m: Match) -> Column:
    return F.substring(t, m["end"] + 1, F.length(t))


def _say(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def _any(words) -> str:
    return "|".join(r"\Q" + w + r"\E" if not w.replace(" ", "").isalnum() else w for w in words)


# --- abbreviations ---------------------------------------------------------------------------

NOT_W = rf"(?=[^{WORD}]|$)"


def _abbreviations() -> list[Rule]:
    c = "AbbreviationChecker"
    out = [
        Rule(0, 0, 0, c, "check_eg_and_ie", rf"(?iu){B}e\.?{S}*g\.?{NOT_W}", "Avoid 'e.g.' in body text; use 'for example' instead", "for example,"),
        Rule(0, 0, 1, c, "check_eg_and_ie", rf"(?iu){B}i\.?{S}*e\.?{NOT_W}", "Avoid 'i.e.' in body text; use 'that is' instead", "that is,"),
    ]
    formats = (
        (rf"{B}etc{E}(?!\.)", "Use 'etc.' with period", "etc."),
        (rf"{B}in{S}+litt{E}(?!\.)", "Use 'in litt.' not 'in litt', if referring to in published literature", "in litt."),
        (rf"{B}(?:pers\.{S}*comm{E}(?!\.)|pers{S}+comm\.?{NOT_W})", "Use 'pers. comm.' format", "pers. comm."),
        (rf"{B}(?:pers\.{S}*obs{E}(?!\.)|pers{S}+obs\.?{NOT_W})", "Use 'pers. obs.' format", "pers. obs."),
        (rf"{B}Prof{E}(?!\.)", "Use 'Prof.' with period", "Prof."),
    )
    out += [Rule(0, 1, k, c, "check_abbreviation_formats", f"(?iu){p}", say, fix) for k, (p, say, fix) in enumerate(formats)]

    def unlike(text: Text, t: Column, m: Match) -> Column:
        """Not in italics, or with a period between the words. (Italic tags are still in this text, and offsets are its own.)"""
        return ~inside_italic(t, m["start"], m["end"]) | _italic_fragment(t, m).contains(".")

    for k, term in enumerate(lex.LATIN_TERMS):
        core = term.replace(" ", rf"(?:\.{S}*|{S}+)")
        say = f"Latin term '{term}' must be italicized and not contain periods"
        out.append(Rule(0, 2, k, c, "check_latin_terms_without_period", rf"(?iu){B}{core}(?=[.!?,;:]?(?:[^{WORD}]|$))", say, f"Italicized: {term}", "italics", unlike))
    out.append(et_al(0, 3))
    for k, title in enumerate(("Dr", "Mr", "Mrs", "Ms")):
        out.append(Rule(0, 4, k, c, "check_title_abbreviations", rf"(?iu){B}{title}\.{NOT_W}", f"Use '{title}' without period (UK style)", title))
    return out


def _italic_fragment(t: Column, m: Match) -> Column:
    """The italic piece around a match, with one mark of punctuation after it, without its tags."""
    head = F.regexp_extract(_before(t, m), r"(?s)^.*(<(?:i|em)>.*?)$", 1)
    closing = F.when(head.startswith("<i>"), F.lit("</i>")).otherwise(F.lit("</em>"))
    after = _after(t, m)
    at = F.instr(after, closing)
    end = at + F.length(closing) - 1
    mark = F.substring(after, end + 1, F.lit(1))
    tail = F.when((head == "") | (at == 0), F.lit("")).otherwise(F.concat(F.substring(after, F.lit(1), end), F.when(mark.rlike("^[.!?,;:]$"), mark).otherwise(F.lit(""))))
    return F.regexp_replace(F.concat(head, m["text"], tail), "(?i)</?(?:i|em)>", "")


def et_al(checker: int, method: int) -> Rule:
    """Shared by the bodies, the bibliography and the tables: the finding names its first owner."""
    core = rf"et(?:\.{S}*|{S}+)al"

    def unlike(text: Text, t: Column, m: Match) -> Column:
        good = m["text"].rlike(rf"(?iu)^et{S}+al\.$")
        tags = matches(text.raw, r"(?i)</?(?:i|em|b|strong|sup|sub)>")
        to = lambda p: F.aggregate(tags, p, lambda a, x: F.when(x["start"] <= a, a + x["end"] - x["start"]).otherwise(a))
        term = F.length(F.regexp_extract(m["text"], rf"(?iu)^{core}", 0))
        return ~(good & inside_italic(text.raw, to(m["start"]), to(m["start"] + term - 1) + 1))

    return Rule(checker, method, 0, "AbbreviationChecker", "check_et_al", rf"(?iu){B}{core}\.?{NOT_W}", "Use italicized 'et al.'", "Italicized: et al.", guard=unlike)


# --- dates -----------------------------------------------------------------------------------


def _dates() -> list[Rule]:
    c = "DateChecker"
    months = "|".join([*lex.MONTHS, *(m if m == "May" else rf"{m}\.?" for m in lex.MONTH_SHORT)])
    whole = rf"(?iu)^({D}{{1,2}})(?:st|nd|rd|th){S}+(?:of{S}+)?(.*)$"
    days = {m.lower(): str(d) for m, d in zip(lex.MONTHS, lex.MONTH_DAYS, strict=True)}
    days |= {m.lower(): days[next(x.lower() for x in lex.MONTHS if x.startswith(m[:3]))] for m in lex.MONTH_SHORT}
    day, month = (lambda m: _group(m, whole, 1)), (lambda m: _group(m, whole, 2))
    key = lambda m: F.lower(F.rtrim(month(m), F.lit(".")))
    most = lambda m: _lookup(days, key(m)).cast("int")
    valid = lambda m: day(m).cast("int").between(F.lit(1), most(m))
    leap = lambda m: key(m).isin("february", "feb") & (day(m).cast("int") == 29)

    def say(m: Match) -> Column:
        return (
            F.when(valid(m), _say("Avoid ordinal dates; use '", day(m), " ", month(m), "' instead of '", m["text"], "'"))
            .when(leap(m), _say("Check for leap year: '", m["text"], "' is only valid in a leap year"))
            .otherwise(_say("Invalid calendar date: '", m["text"], "' is not valid for ", month(m), " (maximum ", most(m).cast("string"), " days)"))
        )

    fix = lambda m: F.when(valid(m), _say(day(m), " ", month(m)))
    out = [Rule(1, 0, 0, c, "check_ordinal_dates", rf"(?iu){B}{D}{{1,2}}(?:st|nd|rd|th){S}+(?:of{S}+)?(?:{months}){NOT_W}", say, fix)]

    suffix = lambda n: f"{n}{'th' if 10 < n < 20 else {1: 'st', 2: 'nd', 3: 'rd'}.get(n % 10, 'th')}"
    words = {w: suffix(n) for n, w in enumerate(lex.ORDINALS, 1)}
    by_length = sorted(words, key=len, reverse=True)  # the longest word first; ties in order
    word = lambda m: F.lower(F.regexp_replace(F.regexp_replace(m["text"], rf"(?iu){S}+century$", ""), rf"{S}+", "-"))
    century = lambda m: _say(_lookup(words, word(m)), " century")
    say_century = lambda m: _say("Use '", century(m), "' instead of '", m["text"], "'")
    alone = lambda text, t, m: ~_before(t, m).rlike(rf"(?iu){B}twenty{S}+$")  # noqa: E731  inside "twenty first" the shorter word is not on its own
    for k, w in enumerate(by_length):
        one = w.replace("-", rf"(?:-|{S}+)")
        out.append(Rule(1, 1, k, c, "check_century_format", rf"(?iu)(?<![{WORD}-]){one}{S}+century{E}", say_century, century, guard=alone if w == "first" else None))
    decade = lambda m: _say(F.substring(m["text"], 1, 4), "s")
    out.append(Rule(1, 2, 0, c, "check_decade_format", rf"{D}{{4}}(?:'|{S})+s{E}", lambda m: _say("Use '", decade(m), "' for decades (no apostrophe or space)"), decade))
    return out


# --- formatting (without the rules that need a document's taxonomy) --------------------------


def _formatting() -> list[Rule]:
    def wrong(text: Text, t: Column, m: Match) -> Column:
        flat = F.regexp_replace(m["text"], rf"{S}+", " ")
        first = F.concat(F.upper(F.substring(m["fix"], 1, 1)), F.substring(m["fix"], 2, 100))
        starts = (m["start"] == 0) | cut(t, m["start"] - 2, m["start"]).isin(". ", "? ", ": ")
        return ~((flat == m["fix"]) | ((flat == first) & starts))

    say = lambda m: _say("Use lowercase: '", m["fix"], "' not '", m["text"], "'")
    terms = ("extent of occurrence", "area of occupancy")
    return [Rule(2, 2, k, "FormattingChecker", "check_eoo_aoo_capitalization", rf"(?iu){B}{x.replace(' ', S + '+')}{E}", say, x, guard=wrong) for k, x in enumerate(terms)]


# --- geography -------------------------------------------------------------------------------


def known_names(t: Column) -> Column:
    """Where accepted names are."""
    return matches(t, rf"(?iu){B}(?:{_any(sorted(lex.KNOWN_NAMES, key=len, reverse=True))})(?![{WORD}])")


def within_known(text: Text, m: Match) -> Column:
    """Strictly inside an accepted name."""
    return F.exists(text.known, lambda k: (k["start"] <= m["start"]) & (m["end"] <= k["end"]) & ~((k["start"] == m["start"]) & (k["end"] == m["end"])))


def _geography() -> list[Rule]:
    c, out = "GeographyChecker", []
    for k, (bad, good) in enumerate(lex.COUNTRY_CORRECTIONS.items()):

        def wrong(text: Text, t: Column, m: Column, good: str = good) -> Column:
            return (F.lower(m["text"]) != good.lower()) & ~within_known(text, m)

        say = lambda m, good=good: _say(f"Use ISO 3166 country name: '{good}' instead of '", m["text"], "'")
        out.append(Rule(3, 0, k, c, "check_country_names", rf"(?iu){B}{_any([bad])}{E}", say, good, guard=wrong, needs="known_names"))
    directions = "|".join(lex.DIRECTIONS)

    def proper(text: Text, t: Column, m: Match) -> Column:
        allowed = [n.lower() for n in lex.KNOWN_NAMES] + list(lex.COUNTRY_CORRECTIONS)
        return ~((m["start"] == 0) | _before(t, m).endswith(". ") | F.lower(m["text"]).isin(*allowed) | within_known(text, m))

    split = rf"(?s)^({directions})(?![a-z])(.*)$"
    fix = lambda m: _say(F.lower(_group(m, split, 1)), _group(m, split, 2))
    regex = rf"{B}(?:{directions})(?:{S}*&{S}*[A-Z][A-Za-z-]+)?(?:{S}+[A-Z][A-Za-z-]+){{1,3}}(?:(?<=[{WORD}])(?![{WORD}])|(?<=-)(?=[{WORD}]))"
    say = lambda m: _say("'", m["text"], "' should be lower case (unless it is a proper region name)")
    out.append(Rule(3, 1, 0, c, "check_directional_capitalization", regex, say, fix, guard=proper, needs="known_names"))
    return out


# --- category terms --------------------------------------------------------------------------


def _terms() -> list[Rule]:
    c = "IUCNTermsChecker"
    out = [
        Rule(4, 0, 0, c, "check_the_iucn", rf"(?iu){B}the{S}+IUCN{E}", "Use 'IUCN' not 'the IUCN'", "IUCN"),
        Rule(4, 1, 0, c, "check_CE_abbreviation", rf"(?iu){B}CE{E}", "Use 'CR' not 'CE' for Critically Endangered", "CR"),
    ]

    def part_of_another(t: Column, m: Match) -> Column:
        """In Critically Endangered, Extinct in the Wild, or ex situ."""
        return (
            ((m["fix"] == "Endangered") & _before(t, m).rlike(rf"(?iu)critically{S}+$"))
            | ((m["fix"] == "Extinct") & _after(t, m).rlike(rf"(?iu)^{S}+in{S}+the{S}+wild{E}"))
            | ((m["fix"] == "EX") & _after(t, m).rlike(rf"(?iu)^{S}+situ{E}"))
        )

    cased = lambda text, t, m: (m["text"] != m["fix"]) & ~part_of_another(t, m)
    for k, (name, code) in enumerate(lex.CATEGORIES):
        out.append(Rule(4, 2, k, c, "check_category_full_name_capitalization", rf"(?iu){B}{name}{E}", f"Red List category should be capitalized: '{name}'", name, guard=cased))
        out.append(Rule(4, 3, k, c, "check_category_abbreviation_capitalization", rf"(?iu)(?<![{WORD}-]){code}(?![{WORD}-])", f"Red List category abbreviation should be capitalized: '{code}'", code, guard=cased))
    near = lambda text, t, m: F.lower(cut(t, F.greatest(F.lit(0), m["start"] - 5), m["start"])) != "near "
    out.append(Rule(4, 4, 0, c, "check_threatened_case", rf"(?<=[a-z]{S})Threatened{E}", "Use lowercase 'threatened' when referring to CR/EN/VU species collectively", "threatened", guard=near))
    return out


# --- numbers ---------------------------------------------------------------------------------


def rounded(n: Column) -> Column:
    return ((n >= 1_000_000_000) & (n % 10_000_000 == 0)) | ((n >= 1_000_000) & (n % 10_000 == 0))


def _in_words(digits: Column) -> Column:
    """1250000 -> 1.25 million."""
    n = digits.cast("decimal(38,0)")
    unit = F.when(n >= 1_000_000_000, F.lit(1e9)).otherwise(F.lit(1e6))
    text = F.format_string("%.2f", n.cast("double") / unit)
    text = F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")
    return _say(text, F.when(n >= 1_000_000_000, F.lit(" billion")).otherwise(F.lit(" million")))


def _grouped(digits: Column) -> Column:
    """Thousands by commas, leading zeros gone, however long."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.regexp_replace(short, r"(?<=[0-9])(?=(?:[0-9]{3})+$)", ",")


def link_spans(t: Column) -> Column:
    return matches(t, r"(?iu)(?:https?://\S+|doi:\s*10\.[0-9]{4,9}/\S+|10\.[0-9]{4,9}/\S+)")


#: Spans of a section's cleaned text that guards ask for.
SPANS = {"known_names": known_names, "link_spans": link_spans}


def _numbers() -> list[Rule]:
    c = "NumberChecker"
    units = "|".join(u.replace(" ", r"\ ") for u in sorted(lex.UNITS, key=len, reverse=True))

    def small(text: Text, t: Column, m: Match) -> Column:
        before, after = cut(t, F.greatest(F.lit(0), m["start"] - 10), m["start"]), cut(t, m["end"], m["end"] + 20)
        return ~(
            before.rlike(r"[\p{Nd},.\-–—]$")
            | after.rlike(r"^[\p{Nd},.\-–—]")
            | after.rlike(rf"^{S}*[%°]")
            | after.rlike(rf"(?iu)^{S}*(?:{units})(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))")
            | after.rlike(rf"^{S}*[-–—]{S}*{D}")
            | before.rlike(rf"{D}{S}*[-–—]{S}*$")
            | after.rlike(rf"^{S}*(?:{'|'.join(lex.MONTHS)})")
        )

    word = lambda m: F.element_at(F.array(*map(F.lit, lex.NUMBER_WORDS)), m["text"].cast("int"))
    say = lambda m: _say("Numbers 1-9 should be written out: '", m["text"], "' should be '", word(m), "'")
    out = [Rule(5, 0, 0, c, "check_small_numbers", rf"{B}[1-9]{E}", say, word, guard=small)]

    split = r"^([0-9,]+)(\.?)([0-9]*)$"
    whole = lambda m: F.replace(_group(m, split, 1), F.lit(","), F.lit(""))
    point = lambda m: _group(m, split, 2) == "."

    def standard(m: Match) -> Column:
        n = F.when(F.length(whole(m)) >= 4, _grouped(whole(m))).otherwise(whole(m))
        return F.when(point(m), _say(n, ".", _group(m, split, 3))).otherwise(n)

    def unlike(text: Text, t: Column, m: Match) -> Column:
        n, comma = whole(m).try_cast("decimal(38,0)"), _group(m, split, 1).contains(",")
        return ~(
            F.exists(text.links, lambda k: (k["start"] <= m["start"]) & (m["end"] <= k["end"]))
            | (cut(t, F.greatest(F.lit(0), m["start"] - 1), m["start"]) == "#")
            | (~point(m) & F.coalesce(n.between(1800, 2100), F.lit(False)))
            | (~point(m) & ~comma & F.coalesce(rounded(n), F.lit(False)))
            | ((F.length(whole(m)) < 4) & ~comma)
            | (standard(m) == m["text"])
        )

    say = lambda m: _say("Use standard comma placement for numbers: '", m["text"], "' should be '", standard(m), "'")
    out.append(Rule(5, 1, 0, c, "check_large_numbers", rf"{B}[0-9](?:[0-9,]*[0-9])?(?:\.[0-9]+)?{E}", say, standard, guard=unlike, needs="link_spans"))

    digits = rf"{D}+$"
    number = lambda m: (m["end"] - F.length(F.regexp_extract(m["text"], digits, 0)), m["end"])

    def begins(text: Text, t: Column, m: Match) -> Column:
        at = number(m)[0]
        before = F.lower(cut(t, F.greatest(F.lit(0), at - 16), at))
        return ~(before.endswith("et al. ") | before.rlike(rf"c\.{S}+$") | before.rlike(rf"comm\.{S}+$"))

    out.append(Rule(5, 2, 0, c, "check_sentence_start", rf"(?:^|[.!?]{S}+){D}+{E}", "Do not start sentences with numerals; write the number out or rephrase", None, guard=begins, part=number))
    say = lambda m: _say("For rounded numbers >= 1 million, use 'X million/billion': '", m["text"], "' could be '", _in_words(m["text"]), "'")
    big = lambda text, t, m: F.coalesce(rounded(m["text"].try_cast("decimal(38,0)")), F.lit(False))
    out.append(Rule(5, 3, 0, c, "check_very_large_numbers", rf"{B}[0-9]{{7,}}{E}", say, lambda m: _in_words(m["text"]), guard=big))
    return out


# --- punctuation -----------------------------------------------------------------------------


def range_dashes(checker: int, method: int) -> Rule:
    split = rf"^({D}{{1,4}}){S}*[-–]{S}*({D}{{1,4}})$"

    def wrong(text: Text, t: Column, m: Match) -> Column:
        head = F.regexp_extract(_before(t, m), r"[\p{Nd}\-–]*$", 0)
        chain = F.concat(head, m["text"], F.regexp_extract(_after(t, m), r"^[\p{Nd}\-–]*", 0))
        parts = F.split(chain, "[-–]", -1)
        long = F.size(F.filter(parts, lambda p: F.length(p) == 4))
        short = F.size(F.filter(parts, lambda p: F.length(p).between(1, 2)))
        date = chain.rlike(rf"^{D}{{1,4}}(?:[-–]{D}{{1,4}}){{2}}$") & (long == 1) & (short == 2)
        phone = cut(t, m["start"], m["end"] + 5).rlike(rf"^{D}{{3}}-{D}{{3}}-{D}{{4}}{E}")
        return ~(phone | date | _after(t, m).startswith("=") | m["text"].rlike(rf"^{D}+–{D}+$"))

    fix = lambda m: _say(_group(m, split, 1), "–", _group(m, split, 2))
    return Rule(checker, method, 0, "PunctuationChecker", "check_range_dashes", rf"{B}{D}{{1,4}}{S}*[-–]{S}*{D}{{1,4}}{E}", "Use an unspaced en dash (–) for numeric ranges", fix, "scripts", wrong)


def _punctuation() -> list[Rule]:
    c = "PunctuationChecker"
    out = [range_dashes(6, 0)]
    starts = lambda t, m: (m["start"] == 0) | _before(t, m).rlike(rf"[.!?]{S}+$")
    # Python's strip() and the last two characters before the phrase
    led = lambda t, m: F.regexp_replace(cut(t, F.greatest(F.lit(0), m["start"] - 2), m["start"]), rf"{S}+$", "").endswith(",")
    followed = lambda t, m: _after(t, m).startswith(",")
    regex = rf"(?iu){B}for example{E}"
    says = (
        ("'for example' should be followed by a comma", "for example,", lambda x, t, m: (starts(t, m) | led(t, m)) & ~followed(t, m)),
        ("'for example' should be enclosed by commas, no preceeding comma if sentence or paragraph start", None, lambda x, t, m: ~starts(t, m) & ~led(t, m) & ~followed(t, m)),
        ("'for example' should be preceded by a comma", None, lambda x, t, m: ~starts(t, m) & ~led(t, m) & followed(t, m)),
    )
    out += [Rule(6, 1, 0, c, "check_for_example_commas", regex, say, fix, guard=guard) for say, fix, guard in says]
    for k, (mark, name) in enumerate(((":", "colon"), (";", "semicolon"))):
        out.append(Rule(6, 2 + k, 0, c, f"check_{name}_spacing", rf"{S}+{mark}", f"Do not put a space before a {name}", mark))
    return out


# --- references, scientific names, spelling, symbols -----------------------------------------


def _references() -> list[Rule]:
    split = rf"(?s)^\((.*),{S}*({D}{{4}})\)$"
    strip = lambda x: F.regexp_replace(x, rf"^{S}+|{S}+$", "")
    fix = lambda m: _say("(", strip(_group(m, split, 1)), " ", _group(m, split, 2), ")")
    return [Rule(7, 0, 0, "ReferenceChecker", "check_citation_comma", rf"\([^()]*?,{S}*{D}{{4}}\)", lambda m: _say("No comma between author and date: '", fix(m), "'"), fix)]


def _scientific() -> list[Rule]:
    c, name = "ScientificNameChecker", "check_species_abbreviations"
    return [
        Rule(8, 0, 0, c, name, rf"{B}spp(?!\.){E}", "Use 'spp.' (with period) for multiple species", "spp."),
        Rule(8, 0, 1, c, name, rf"{B}sp(?![p.{WORD}])", "Use 'sp.' (with period) for single unspecified species", "sp."),
    ]


def _as_cased(fix: Column, m: Match) -> Column:
    t = m["text"]
    first = F.substring(t, 1, 1)
    return F.when((t == F.upper(t)) & (t != F.lower(t)), F.upper(fix)).when(first != F.lower(first), F.concat(F.upper(F.substring(fix, 1, 1)), F.substring(fix, 2, 100))).otherwise(fix)


def _spelling() -> list[Rule]:
    out = []
    for k, (table, say) in enumerate(((lex.UK_SPELLING, "Use UK spelling '"), (lex.IZE_SPELLING, "IUCN prefers ize spelling '"))):
        fix = lambda m, table=table: _as_cased(_lookup(table, F.lower(m["text"])), m)
        text = lambda m, fix=fix, say=say: _say(say, fix(m), "' instead of '", m["text"], "'")
        out.append(Rule(9, 0, k, "SpellingChecker", "check_text", rf"(?iu){B}(?:{'|'.join(table)}){E}", text, fix))
    return out


def _symbols() -> list[Rule]:
    c = "SymbolChecker"
    elsewhere = lambda text, t, m: ~F.lower(text.name).contains("assessment information")
    no_range = lambda text, t, m: ~_before(t, m).rlike(rf"{D}(?:\.{D}+)?{S}*[-–—]{S}*$")
    number = rf"{D}+(?:\.{D}+)?"
    value = lambda m: _group(m, rf"^{number}", 0)
    letter = lambda m: F.upper(F.substring(m["text"], -1, 1))
    out = [
        Rule(10, 0, 0, c, "check_ampersand_usage", "&", "Use 'and' not '&'", "and", guard=elsewhere),
        Rule(10, 1, 0, c, "check_area_units", rf"(?iu){B}sq{S}*km{E}", "Use 'km²' not 'sqkm' or 'sq km'", "km²", "scripts"),
    ]
    for k, u in enumerate(("km", "m", "cm", "mm"), 1):
        out.append(Rule(10, 1, k, c, "check_area_units", rf"{B}{u}2{E}", f"Use '{u}²' not '{u}2'", f"{u}²", "scripts"))
    compass = lambda m: _say(value(m), "°", letter(m))
    celsius = lambda m: _say(value(m), "°C")
    degree = lambda f: lambda m: _say("Use degree symbol: '", f(m), "'")
    out.append(Rule(10, 2, 0, c, "check_degree_text", rf"(?iu){number}{S}*degrees?{E}{S}*[NSEW]{E}", degree(compass), compass))
    out.append(Rule(10, 2, 1, c, "check_degree_text", rf"(?iu){number}{S}*degrees?{E}{S}*(?:Celsius|C){E}", degree(celsius), celsius))
    spaced = lambda text, t, m: no_range(text, t, m) & (m["text"] != compass(m))
    out.append(Rule(10, 3, 0, c, "check_degree_symbol_spacing", rf"(?iu){number}{S}*°{S}*[NSEWC]{E}", lambda m: _say("No spaces around degree symbol: '", compass(m), "'"), compass, guard=spaced))
    percent = lambda m: _say(value(m), "%")
    say_percent = lambda m: _say("Use '%' symbol: '", percent(m), "'")
    for k, words in enumerate((rf"{S}*percent", rf"{S}+per{S}+cent")):
        out.append(Rule(10, 4, k, c, "check_percentage", rf"(?iu)(?<![\p{{Nd}}.]){number}{words}{E}", say_percent, percent))
    whole = lambda m: _group(m, rf"^{D}+", 0)
    apart = lambda m: _say(whole(m), " ", _group(m, r"[a-z]+$", 0))
    out.append(Rule(10, 5, 0, c, "check_percentage_symbol_spacing", rf"{D}+{S}+%", "No space before '%'", lambda m: _say(whole(m), "%"), guard=no_range))
    out.append(Rule(10, 5, 1, c, "check_percentage_symbol_spacing", rf"{D}+(?:km|ha|kg|m|cm|mm|ml|l){E}", lambda m: _say("Add space between number and unit: '", apart(m), "'"), apart, guard=no_range))
    return out


BODY: tuple[Rule, ...] = (*_abbreviations(), *_dates(), *_formatting(), *_geography(), *_terms(), *_numbers(), *_punctuation(), *_references(), *_scientific(), *_spelling(), *_symbols())


def _authors_only(text: Text, t: Column, m: Match) -> Column:
    """Before the first year."""
    return ~_before(t, m).rlike(rf"{B}{D}{{4}}{E}")


BIBLIOGRAPHY: tuple[Rule, ...] = (
    Rule(0, 0, 0, "BibliographyChecker", "check_ampersand_usage", "&", "Use 'and' not '&' in bibliography author entries", "and", guard=_authors_only),
    et_al(0, 1),
    range_dashes(0, 2),
)
TABLE: tuple[Rule, ...] = (et_al(0, 0),)



def needles(rule: Rule) -> tuple[tuple[str, ...], bool]:
    """(texts of which each match holds one, in lower case; whether it holds a digit): cheap to look for before the pattern is. Neither: look for the pattern."""
    fix = rule.fix.lower() if isinstance(rule.fix, str) else ""
    k = rule.pattern
    by_name = {
        "check_abbreviation_formats": lambda: (("etc", "litt", "comm", "obs", "prof")[k],),
        "check_latin_terms_without_period": lambda: (lex.LATIN_TERMS[k].split()[-1],),
        "check_title_abbreviations": lambda: (f"{fix}.",),
        "check_century_format": lambda: ("century",),
        "check_eoo_aoo_capitalization": lambda: (fix.split()[-1],),
        "check_country_names": lambda: (list(lex.COUNTRY_CORRECTIONS)[k],),
        "check_the_iucn": lambda: ("iucn",),
        "check_CE_abbreviation": lambda: ("ce",),
        "check_category_full_name_capitalization": lambda: (fix.split()[-1],),
        "check_category_abbreviation_capitalization": lambda: (fix,),
        "check_threatened_case": lambda: ("threatened",),
        "check_for_example_commas": lambda: ("for example",),
        "check_colon_spacing": lambda: (":",),
        "check_semicolon_spacing": lambda: (";",),
        "check_species_abbreviations": lambda: ("sp",),
        "check_text": lambda: tuple((lex.UK_SPELLING, lex.IZE_SPELLING)[k]),
        "check_ampersand_usage": lambda: ("&",),
        "check_area_units": lambda: (("sq", "km2", "m2", "cm2", "mm2")[k],),
        "check_degree_text": lambda: ("degree",),
        "check_degree_symbol_spacing": lambda: ("°",),
        "check_percentage": lambda: ("cent",),
    }
    digits = ("check_ordinal_dates", "check_decade_format", "check_small_numbers", "check_large_numbers", "check_sentence_start", "check_very_large_numbers", "check_range_dashes", "check_citation_comma", "check_percentage_symbol_spacing")
    return (by_name[rule.name]() if rule.name in by_name else ()), rule.name in digits


ROUTES = {"body": BODY, "bibliography": BIBLIOGRAPHY, "table": TABLE}


def by_method(*names: str) -> tuple[Rule, ...]:
    """The body's rules of these methods (Class.method)."""
    return tuple(r for r in BODY if f"{r.cls}.{r.name}" in names)
