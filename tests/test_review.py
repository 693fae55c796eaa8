"""Rules, routing, offsets and state, against hand-written results and Python's re."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import spans
from quillspark.operators import review

SCHEMA = "doc_id long, pos int, section_key string, text string"


@pytest.fixture(scope="module")
def found(spark):
    texts = [
        "e.g. and I.E. etc in litt pers comm pers. obs Prof and Dr. Who",
        "in situ <i>ex situ</i> <i>ad. hoc</i> et al <i>et al.</i> et al.",
        "3rd of March, 30th Feb. 29th February 31st April 12th may",
        "first century Twenty First Century twenty-first century 1990's 1980s",
        "Extent of Occurrence. Extent of occurrence here EXTENT OF OCCURRENCE",
        "america North America vietnam East Timor in Holland, Congo-Kinshasa",
        "from Northern Peru to North Korea. Southern Coast of South Africa",
        "the IUCN CE critically endangered Endangered extinct in the wild ex situ En lc Near Threatened is Threatened",
        "There are 7 trees, 5 km, 3-4, 6 May and 1.5. 8 birds c. 9",
        "12345 and 1,2345 in 1999 doi:10.1234/56789 #12345 1250000 0.12345 2000000000 999",
        "5-10 3 – 4 5–6 1-2-2003 123-456-7890 7-8= x",
        "For example this, for example that; it is for example, so. For example, yes",
        "a : b ;c (Smith, 2001) (Smith 2001) spp sp sp. spp.",
        "COLOR Color color colour organised Organising rigorous",
        "a & b 5 sq km 6 km2 7 m2 5 degrees N 6 degrees Celsius 7 ° s 8°N 10 percent 4 per cent 10 % 5km 5-6 %",
    ]
    rows = [(i, 0, "Doc > Part [paragraph 1]", t) for i, t in enumerate(texts)]
    out: dict = {}
    for r in review.review(spark.createDataFrame(rows, SCHEMA)).orderBy(*review.ORDER).collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["matched_text"]
        assert r["section_name"] == "Doc > Part"
        out.setdefault((r["doc_id"], r["rule_method"].split(".")[1]), []).append((r["matched_text"], r["suggested_fix"]))
    return out


CASES = [
    (0, "check_eg_and_ie", [("e.g.", "for example,"), ("I.E.", "that is,")]),
    (0, "check_abbreviation_formats", [("etc", "etc."), ("in litt", "in litt."), ("pers comm", "pers. comm."), ("pers. obs", "pers. obs."), ("Prof", "Prof.")]),
    (0, "check_title_abbreviations", [("Dr.", "Dr")]),
    (1, "check_latin_terms_without_period", [("in situ", "Italicized: in situ"), ("ad. hoc", "Italicized: ad hoc")]),
    (1, "check_et_al", [("et al", "Italicized: et al."), ("et al.", "Italicized: et al.")]),
    (2, "check_ordinal_dates", [("3rd of March", "3 March"), ("30th Feb.", None), ("29th February", None), ("31st April", None), ("12th may", "12 may")]),
    (3, "check_century_format", [("Twenty First Century", "21st century"), ("twenty-first century", "21st century"), ("first century", "1st century")]),
    (3, "check_decade_format", [("1990's", "1990s")]),
    (4, "check_eoo_aoo_capitalization", [("Extent of Occurrence", "extent of occurrence"), ("EXTENT OF OCCURRENCE", "extent of occurrence")]),
    (5, "check_country_names", [("vietnam", "Viet Nam"), ("Congo-Kinshasa", "DRC"), ("Holland", "Netherlands"), ("america", "United States"), ("East Timor", "Timor-Leste")]),
    (6, "check_directional_capitalization", [("Northern Peru", "northern Peru")]),
    (7, "check_the_iucn", [("the IUCN", "IUCN")]),
    (7, "check_CE_abbreviation", [("CE", "CR")]),
    (7, "check_category_full_name_capitalization", [("critically endangered", "Critically Endangered"), ("extinct in the wild", "Extinct in the Wild")]),
    (7, "check_category_abbreviation_capitalization", [("En", "EN"), ("lc", "LC")]),
    (7, "check_threatened_case", [("Threatened", "threatened")]),
    (8, "check_small_numbers", [("7", "seven"), ("8", "eight"), ("9", "nine")]),
    (8, "check_sentence_start", [("8", None)]),
    (9, "check_large_numbers", [("12345", "12,345"), ("1,2345", "12,345")]),
    (9, "check_very_large_numbers", [("1250000", "1.25 million"), ("2000000000", "2 billion")]),
    (10, "check_range_dashes", [("5-10", "5–10"), ("3 – 4", "3–4")]),
    (11, "check_for_example_commas", [("For example", "for example,"), ("for example", "for example,"), ("for example", None)]),
    (12, "check_colon_spacing", [(" :", ":")]),
    (12, "check_semicolon_spacing", [(" ;", ";")]),
    (12, "check_citation_comma", [("(Smith, 2001)", "(Smith 2001)")]),
    (12, "check_species_abbreviations", [("spp", "spp."), ("sp", "sp.")]),
    (13, "check_text", [("COLOR", "COLOUR"), ("Color", "Colour"), ("color", "colour"), ("organised", "organized"), ("Organising", "Organizing")]),
    (14, "check_ampersand_usage", [("&", "and")]),
    (14, "check_area_units", [("sq km", "km²"), ("km2", "km²"), ("m2", "m²")]),
    (14, "check_degree_text", [("5 degrees N", "5°N"), ("6 degrees Celsius", "6°C")]),
    (14, "check_degree_symbol_spacing", [("7 ° s", "7°S")]),
    (14, "check_percentage", [("10 percent", "10%"), ("4 per cent", "4%")]),
    (14, "check_percentage_symbol_spacing", [("10 %", "10%"), ("5km", "5 km")]),
]


@pytest.mark.parametrize(("doc", "method", "want"), CASES, ids=[f"{d}-{m}" for d, m, _ in CASES])
def test_rule(found, doc, method, want):
    assert found.get((doc, method), []) == want


def test_routes_offsets_and_state(spark):
    rows = [
        (1, 0, "T > A [paragraph 1]", "PLANTAE - TRACHEOPHYTA - LILIOPSIDA - ASPARAGALES - AMARYLLIDACEAE - Primus - secundus"),
        (1, 1, "T > B [paragraph 1]", "The <i>PRIMUS</i> secundus <em>secundus</em> in <i>Plantae</i> amaryllidaceae"),
        (1, 2, "T [table 1] [row 1]", "x et al | & Primus"),
        (1, 3, "T > Bibliography [paragraph 1]", "A & B, 2001 & more 5-6"),
        (1, 4, "T > C [paragraph 1]", " \n"),
        (2, 0, "T > B [paragraph 1]", "PRIMUS before any ladder"),
        (3, 0, "T > B [paragraph 1]", "one <b>two</b> co<b>l</b>or six seven"),
    ]
    got = review.review(spark.createDataFrame(rows, SCHEMA)).orderBy(*review.ORDER).collect()
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["pos"]), []).append((r["rule_method"].split(".")[1], r["matched_text"]))
    assert by[1, 1] == [
        ("check_genus_and_species", "<i>PRIMUS</i>"), ("check_genus_and_species", "secundus"),
        ("check_higher_order_taxonomy_formatting", "amaryllidaceae"), ("check_higher_order_taxonomy_formatting", "<i>Plantae</i>"),
    ]
    assert by[1, 2] == [("check_et_al", "et al")]
    assert by[1, 3] == [("check_ampersand_usage", "&"), ("check_range_dashes", "5-6")]
    assert (1, 0) not in by and (1, 4) not in by and (2, 0) not in by
    (color,) = [r for r in got if r["doc_id"] == 3]
    assert color["matched_text"] == "co<b>l</b>or" and color["matched_snippet"] == "one <b>two</b> co<b>l</b>or six seven"
    cleaned = review.clean_up(spark.createDataFrame([color])).first()
    assert cleaned["matched_text"] == "color" and cleaned["matched_snippet"] == "one two color six seven"
    s = spark.createDataFrame(rows, SCHEMA)
    groups = review.grouped(review.review(s), s).where("doc_id = 1").orderBy("group_pos").collect()
    assert [(g["display_name"], g["n"]) for g in groups] == [("T > B", 4), ("T", 1), ("T > Bibliography", 2)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab <>/i1é²\n", max_size=40), min_size=1, max_size=8))
def test_spans_like_python(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    m = spans.matches(F.col("t"), r"a+1?")
    tags = spans.matches(F.col("t"), spans.TAGS["all"])
    rows = df.select("t", m.alias("m"), spans.clean(F.col("t")).alias("c"), tags.alias("tags")).collect()
    for r in rows:
        assert [(x["start"], x["end"], x["text"]) for x in r["m"]] == [(x.start(), x.end(), x[0]) for x in re.finditer(r"a+1?", r["t"])]
        assert r["c"] == re.sub(r"(?i)</?(?:i|em|b|strong|sup|sub)>", "", r["t"])


def test_empty(spark):
    s = spark.createDataFrame([], SCHEMA)
    assert review.review(s).count() == 0 and review.grouped(review.review(s), s).count() == 0
