"""Registered queries over the tables of a folder, and the SQL that checks them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import lexicons as lex
from quillspark.operators import answers, draft, evaluation, records, replies, retrieval, review, rules, tasks, thresholds
from quillspark.plans import fixtures as fx
from quillspark.session import ship, spread
from quillspark.sources import files, html, tree
from quillspark.streaming import events as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return keep


# --- rules: findings per document ------------------------------------------------------------

#: DuckDB's patterns have no lookarounds: every mark is doubled, so that two matches never share one.
W = r"\p{L}\p{N}_"
X = f"[^{W}]"
DOUBLED = f"' ' || regexp_replace(t, '({X})', '\\1\\1', 'g') || ' '"
PLAIN = "t"
BODY_SQL = f"SELECT doc_id, regexp_replace(text, '</?(i|em|b|strong|sup|sub)>', '', 'gi') AS t FROM {fx.SECTIONS_SQL} WHERE NOT regexp_matches(section_key, '(?i)\\[table\\s+\\d+\\]') AND NOT contains(lower(section_key), 'bibliography') AND trim(text) <> ''"


#: Italic tags and what they enclose taken out as well.
UPRIGHT = f"' ' || regexp_replace(regexp_replace(t, '<(i|em)>[^<]*</(i|em)>', ' ', 'gi'), '({X})', '\\1\\1', 'g') || ' '"
ITALICS_SQL = BODY_SQL.replace("</?(i|em|b|strong|sup|sub)>", "</?(b|strong|sup|sub)>")


def _rule_sql(*counts: tuple[str, str], body: str = BODY_SQL, less: tuple[tuple[str, str], ...] = ()) -> str:
    """Findings per document: matches of `counts` without those of `less`."""
    found = lambda text, pattern: f"len(regexp_extract_all({text}, '{pattern.replace(chr(39), chr(39) * 2)}'))"
    n = " - ".join([" + ".join(found(*c) for c in counts), *(found(*c) for c in less)])
    return f"SELECT doc_id, CAST(sum({n}) AS BIGINT) AS n FROM ({body}) GROUP BY doc_id HAVING sum({n}) > 0"


def _values_sql(pattern: str, test: str) -> str:
    """Matches' first group under a test of its value x."""
    n = f"sum(len(list_filter(regexp_extract_all({DOUBLED}, '{pattern}', 1), lambda x: {test})))"
    return f"SELECT doc_id, CAST({n} AS BIGINT) AS n FROM ({BODY_SQL}) GROUP BY doc_id HAVING {n} > 0"


_months = "|".join([*lex.MONTHS, *(m if m == "May" else rf"{m}\.*" for m in lex.MONTH_SHORT)])
_latin = "|".join(w.replace(" ", r"(?:\.\.\s*|\s+)") for w in lex.LATIN_TERMS)
_ordinals = "|".join(w.replace("-", r"(?:--|\s+)") for w in sorted(lex.ORDINALS, key=len, reverse=True))
_names = tuple((DOUBLED, f"(?i){X}" + "".join(f"({X}){{2}}" if not re.match(r"\w", c) else c for c in bad) + X) for bad in lex.COUNTRY_CORRECTIONS)
_range = "(extent of occurrence|area of occupancy)".replace(" ", r"\s+")
_upper = "(Extent of occurrence|Area of occupancy)".replace(" ", r"\s+")

_words = "|".join(lex.UK_SPELLING) + "|" + "|".join(lex.IZE_SPELLING)
RULES: dict[str, tuple[tuple[str, ...], str | None]] = {
    "rule_ampersand": (("SymbolChecker.check_ampersand_usage",), _rule_sql((PLAIN, "&"), body=BODY_SQL + " AND NOT contains(lower(section_key), 'assessment information')")),
    "rule_article_before_name": (("IUCNTermsChecker.check_the_iucn",), _rule_sql((DOUBLED, rf"(?i){X}the\s+iucn{X}"))),
    "rule_wrong_code": (("IUCNTermsChecker.check_CE_abbreviation",), _rule_sql((DOUBLED, rf"(?i){X}ce{X}"))),
    "rule_spelling": (("SpellingChecker.check_text",), _rule_sql((DOUBLED, rf"(?i){X}({_words}){X}"))),
    "rule_percentage": (("SymbolChecker.check_percentage",), _rule_sql((DOUBLED, rf"(?i)\d\s*percent{X}"), (DOUBLED, rf"(?i)\d\s+per\s+cent{X}"))),
    "rule_area_units": (("SymbolChecker.check_area_units",), _rule_sql((DOUBLED, rf"(?i){X}sq\s*km{X}"), *((DOUBLED, f"{X}{u}2{X}") for u in ("km", "m", "cm", "mm")))),
    "rule_colon_semicolon": (("PunctuationChecker.check_colon_spacing", "PunctuationChecker.check_semicolon_spacing"), _rule_sql((PLAIN, r"\s+:"), (PLAIN, r"\s+;"))),
    "rule_citation_comma": (("ReferenceChecker.check_citation_comma",), _rule_sql((PLAIN, r"\([^()]*?,\s*\d{4}\)"))),
    "rule_decade": (("DateChecker.check_decade_format",), _rule_sql((DOUBLED, rf"\d{{4}}['\s]+s{X}"))),
    "rule_species_abbreviation": (("ScientificNameChecker.check_species_abbreviations",), _rule_sql((DOUBLED, rf"{X}spp[^{W}.]"), (DOUBLED, rf"{X}sp[^{W}.]"))),
    "rule_titles": (("AbbreviationChecker.check_title_abbreviations",), _rule_sql((DOUBLED, rf"(?i){X}(Dr|Mr|Mrs|Ms)\.\.{X}"))),
    "rule_abbreviations": (("AbbreviationChecker.check_eg_and_ie", "AbbreviationChecker.check_abbreviation_formats"), _rule_sql(*((DOUBLED, rf"(?i){X}{a}(?:\.\.)?\s*{b}{X}") for a, b in ("eg", "ie")), *((DOUBLED, f"(?i){X}{w}[^{W}.]") for w in ("etc", r"in\s+litt", "Prof")), *((DOUBLED, rf"(?i){X}pers(?:\.\.\s*{w}[^{W}.]|\s+{w}{X})") for w in ("comm", "obs")))),
    "rule_latin_terms": (("AbbreviationChecker.check_latin_terms_without_period",), _rule_sql((UPRIGHT, f"(?i){X}(?:{_latin}){X}"), body=ITALICS_SQL)),
    "rule_et_al": (("AbbreviationChecker.check_et_al",), _rule_sql((DOUBLED, rf"(?i){X}et(?:\.\.\s*|\s+)al{X}"))),
    "rule_ordinal_dates": (("DateChecker.check_ordinal_dates",), _rule_sql((DOUBLED, rf"(?i){X}\d{{1,2}}(?:st|nd|rd|th)\s+(?:of\s+)?(?:{_months}){X}"))),
    "rule_century": (("DateChecker.check_century_format",), _rule_sql((DOUBLED, rf"(?i)[^{W}-](?:{_ordinals})\s+century{X}"))),
    "rule_range_terms": (("FormattingChecker.check_eoo_aoo_capitalization",), _rule_sql((DOUBLED, f"(?i){X}{_range}{X}"), less=((DOUBLED, f"{X}{_range}{X}"), (DOUBLED, rf"(?:^|[.?:][.?:]\s)\s{_upper}{X}")))),
    "rule_country_names": (("GeographyChecker.check_country_names",), _rule_sql(*_names)),
    "rule_direction_caps": (("GeographyChecker.check_directional_capitalization",), None),
    "rule_category_caps": (("IUCNTermsChecker.check_category_full_name_capitalization", "IUCNTermsChecker.check_category_abbreviation_capitalization", "IUCNTermsChecker.check_threatened_case"), None),
    "rule_small_numbers": (("NumberChecker.check_small_numbers",), None),
    "rule_large_numbers": (("NumberChecker.check_large_numbers",), None),
    "rule_sentence_start": (("NumberChecker.check_sentence_start",), _rule_sql((DOUBLED, rf"(?:^ |[.!?]\s+)\d+{X}"), less=((DOUBLED, rf"(?i)(?:et\s+al|c|comm)\.\.\s+\d+{X}"),))),
    "rule_very_large_numbers": (("NumberChecker.check_very_large_numbers",), _values_sql(f"{X}([0-9]{{7,}}){X}", "coalesce((try_cast(x AS HUGEINT) >= 1000000000 AND try_cast(x AS HUGEINT) % 10000000 = 0) OR (try_cast(x AS HUGEINT) >= 1000000 AND try_cast(x AS HUGEINT) % 10000 = 0), false)")),
    "rule_range_dash": (("PunctuationChecker.check_range_dashes",), None),
    "rule_for_example": (("PunctuationChecker.check_for_example_commas",), _rule_sql((DOUBLED, rf"(?i){X}for\s\sexample{X}"), less=((DOUBLED, r"(?i)(?:^ |[.!?]\s+|,,(?:\s\s)?)for\s\sexample,"),))),
    "rule_degree": (("SymbolChecker.check_degree_text", "SymbolChecker.check_degree_symbol_spacing"), _rule_sql((DOUBLED, rf"(?i)\d\s*degrees?\s+(?:N|S|E|W|Celsius|C){X}"), (DOUBLED, rf"(?i)\d\s*°°\s*[NSEWC]{X}"), less=((DOUBLED, rf"\d°°[NSEWC]{X}"),))),
    "rule_percent_spacing": (("SymbolChecker.check_percentage_symbol_spacing",), _rule_sql((DOUBLED, r"\d\s+%"), (DOUBLED, rf"\d(?:km|ha|kg|m|cm|mm|ml|l){X}"))),
}


def _rule_query(methods: tuple[str, ...]) -> Query:
    return lambda spark, sf_dir: review.check(fx.sections(spark, sf_dir), rules.by_method(*methods)).groupBy("doc_id").agg(F.count("*").alias("n"))


for _name, (_methods, _oracle) in RULES.items():
    register(_name, _oracle)(_rule_query(_methods))


# --- reports ---------------------------------------------------------------------------------


@register("review_violations")
def review_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.clean_up(review.review(fx.sections(spark, sf_dir)))


@register("review_by_rule")
def review_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review(fx.sections(spark, sf_dir)).groupBy("rule_class", "rule_method").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@register("review_grouped")
def review_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.sections(spark, sf_dir)
    return review.grouped(review.clean_up(review.review(s)), s).drop("violations")


@register("section_routes", f"SELECT CASE WHEN regexp_matches(section_key, '(?i)\\[table\\s+\\d+\\]') THEN 'table' WHEN contains(lower(section_key), 'bibliography') THEN 'bibliography' ELSE 'body' END AS route, count(*) AS n FROM {fx.SECTIONS_SQL} WHERE trim(text) <> '' GROUP BY 1")
def section_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.routed(fx.sections(spark, sf_dir)).groupBy("route").agg(F.count("*").alias("n"))


@register("clean_markup", f"SELECT doc_id, pos, length(regexp_replace(text, '</?(i|em|b|strong|sup|sub)>', '', 'gi')) AS n FROM {fx.SECTIONS_SQL}")
def clean_markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.sections(spark, sf_dir)
    return s.select("doc_id", "pos", F.length(F.regexp_replace("text", review.STYLE, "")).cast("long").alias("n"))


_LADDER = "list_filter(list_transform(string_split(text, ' - '), lambda x: trim(x)), lambda x: x <> '')"


@register(
    "taxonomy_carry_forward",
    f"""WITH s AS (SELECT doc_id, pos, {_LADDER} AS p FROM {fx.SECTIONS_SQL} WHERE trim(text) <> '' AND NOT contains(section_key, '[table') AND NOT contains(lower(section_key), 'bibliography')),
    l AS (SELECT doc_id, pos, CASE WHEN len(p) >= 6 AND len(list_filter(p, lambda x: regexp_full_match(x, '[A-Z][A-Z]+'))) >= 4 THEN p[len(p) - 1] END AS g, CASE WHEN len(p) >= 6 AND len(list_filter(p, lambda x: regexp_full_match(x, '[A-Z][A-Z]+'))) >= 4 THEN lower(p[len(p)]) END AS sp FROM s)
    SELECT doc_id, pos, last_value(upper(g[1]) || lower(g[2:]) IGNORE NULLS) OVER w AS genus, last_value(sp IGNORE NULLS) OVER w AS species FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def taxonomy_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = review.taxonomy(review.routed(fx.sections(spark, sf_dir)))
    return s.where("route = 'body'").select("doc_id", "pos", "genus", "species")


@register("review_taxonomy")
def review_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.check_taxonomy(fx.sections(spark, sf_dir)).select("doc_id", "pos", "start", "end", "rule_method", "matched_text", "suggested_fix")


# --- documents and records -------------------------------------------------------------------


@register("html_blocks")
def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.blocks(spread(_table(spark, sf_dir, "pages").select("page_id", "html"))).select("doc_id", "h1", "h2", "node", "block_pos", "type", "text")


@register("html_sections")
def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.sections(html.blocks(spread(_table(spark, sf_dir, "pages").select("page_id", "html"))), html_fallback=True)


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as layout blocks, ten a page."""
    lines = spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source_file"), F.posexplode(F.split("text", "\n")).alias("i", "text"))
    return lines.select("source_file", (F.floor(F.col("i") / 10) + 1).cast("int").alias("page"), "text", F.array(F.lit(0.0), (F.col("i") % 10).cast("double")).alias("bbox"), F.lit(10.0).alias("font_size"), F.lit(False).alias("is_bold"), F.lit(10.0).alias("body_font"))


_LAYOUT_SQL = "(SELECT 'd' || doc_id || '.pdf' AS source_file, (i - 1) // 10 + 1 AS page, (i - 1) % 10 AS y, l[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))"
_KEY_SQL = "regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '\\bpage\\s+\\d+\\b', 'page', 'g'), '\\d+', '#', 'g')"


@register(
    "record_repeated_edges",
    f"""WITH b AS (SELECT source_file, page, {_KEY_SQL} AS key, row_number() OVER (PARTITION BY source_file, page ORDER BY y) AS r, count(*) OVER (PARTITION BY source_file, page) AS n FROM {_LAYOUT_SQL}),
    p AS (SELECT source_file, count(DISTINCT page) AS pages FROM b GROUP BY 1 HAVING count(DISTINCT page) > 1)
    SELECT source_file, key FROM b JOIN p USING (source_file) WHERE length(key) >= 6 GROUP BY source_file, key, pages HAVING sum((r <= 2)::INT + (r > n - 2)::INT) * 1.0 / pages >= 0.6""",
)
def record_repeated_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.repeated_edges(_layout(spark, sf_dir))


@register("record_merge_blocks")
def record_merge_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.merge_blocks(_layout(spark, sf_dir))


@register("record_chunks")
def record_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.chunks(_records(spark, sf_dir)).select("chunk_id", "doc_id", "page", "text", "search_text")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: one in five a table, one in five a table row."""
    kind = F.when(F.col("doc_id") % 5 == 1, "table").when(F.col("doc_id") % 5 == 2, "table_row").otherwise("text")
    d = spread(_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return d.select(
        F.format_string("r%08d", "doc_id").alias("doc_id"), F.col("source").alias("source_file"), (F.col("doc_id") % 7).cast("int").alias("page"), kind.alias("block_type"),
        F.concat(F.lit("Source: x\nContent:\n"), F.col("text")).alias("text"), F.col("text").alias("raw_text"), F.col("lang").alias("section_title"), F.array("source", "lang").alias("section_path"),
        F.concat(F.lit("t"), (F.col("doc_id") % 3).cast("string")).alias("table_id"), F.concat(F.lit("Table "), (F.col("doc_id") % 3 + 1).cast("string")).alias("table_title"),
        F.when(kind == "table_row", (F.col("doc_id") % 11).cast("int")).alias("row_id"), F.lit(None).cast("string").alias("parent_id"), F.lit(1.0).alias("priority"),
    )


_KIND_SQL = "CASE doc_id % 5 WHEN 1 THEN 'table' WHEN 2 THEN 'table_row' ELSE 'text' END"


@register(
    "record_drop_overlaps",
    f"""WITH r AS (SELECT format('r{{:08d}}', doc_id) AS doc_id, source AS source_file, doc_id % 7 AS page, {_KIND_SQL} AS kind, text, {_KEY_SQL} AS key FROM documents),
    t AS (SELECT DISTINCT source_file, page, true AS has FROM r WHERE kind <> 'text'),
    f AS (SELECT r.* FROM r LEFT JOIN t USING (source_file, page) WHERE NOT (coalesce(has, false) AND kind = 'text' AND (contains(lower(text), 'table 1') OR contains(lower(text), 'table 2') OR contains(lower(text), 'table 3'))))
    SELECT doc_id, source_file, kind AS block_type FROM f QUALIFY row_number() OVER (PARTITION BY source_file, page, key ORDER BY CASE kind WHEN 'table_row' THEN 3 WHEN 'table' THEN 2 ELSE 1 END DESC, doc_id) = 1""",
)
def record_drop_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.drop_overlaps(_records(spark, sf_dir)).select("doc_id", "source_file", "block_type")


@register(
    "record_parents",
    "SELECT source AS source_file, 't' || (doc_id % 3) AS table_id, 'Table ' || (doc_id % 3 + 1) AS table_title, length(trim(text)) AS n FROM documents WHERE doc_id % 5 = 1 QUALIFY row_number() OVER (PARTITION BY source, doc_id % 3 ORDER BY doc_id) = 1",
)
def record_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.parents(_records(spark, sf_dir)).select("source_file", "table_id", "table_title", F.length("text").cast("long").alias("n"))


# --- retrieval -------------------------------------------------------------------------------


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _records(spark, sf_dir)
    # of a null id the record's has "null" in place of digits
    return r.select(F.substring("doc_id", 2, 20).try_cast("long").alias("chunk_id"), F.col("raw_text").alias("search_text"), *(c for c in r.columns if c != "doc_id"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


_TOKENS = "list_transform(regexp_extract_all({}, '[A-Za-z0-9][A-Za-z0-9()\\[\\].,/%:+\\-_–—]*'), lambda x: lower(x))"
BM25_SQL = f"""docs AS (SELECT doc_id AS chunk_id, {_TOKENS.format("text")} AS t FROM documents),
    post AS (SELECT term, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(t) AS dl, unnest(t) AS term FROM docs) GROUP BY 1, 2),
    df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    fig AS (SELECT count(*) AS n_docs, sum(len(t)) / count(*) AS avgdl FROM docs),
    ask AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOKENS.format("text")}) AS term FROM benchmark) GROUP BY 1, 2),
    scored AS (SELECT query_id, chunk_id, sum(times * ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS s FROM ask JOIN df USING (term) JOIN post USING (term), fig GROUP BY 1, 2),
    bm AS (SELECT query_id, chunk_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, chunk_id) AS r FROM scored WHERE s > 0)"""


@register("bm25_topk", f"WITH {BM25_SQL} SELECT query_id, chunk_id, round(s, 6) AS score FROM bm WHERE r <= 20")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    return retrieval.bm25(_questions(spark, sf_dir), retrieval.index(corpus)).select("query_id", "chunk_id", F.round("bm25_score", 6).alias("score"))


@register("token_coverage", f"WITH {BM25_SQL}, q AS (SELECT item_id AS query_id, list_distinct({_TOKENS.format('text')}) AS qt FROM benchmark) SELECT query_id, chunk_id, round(len(list_intersect(qt, t)) / len(qt), 6) AS coverage FROM bm JOIN q USING (query_id) JOIN docs USING (chunk_id) WHERE r <= 20")
def token_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, asked = _corpus(spark, sf_dir), _questions(spark, sf_dir)
    found = retrieval.bm25(asked, retrieval.index(corpus)).join(corpus.select("chunk_id", "search_text"), "chunk_id").join(asked, "query_id")
    return found.select("query_id", "chunk_id", F.round(retrieval.coverage(F.col("text"), F.col("search_text")), 6).alias("coverage"))


_DENSE = "SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, 1 / (1 + list_sum(list_transform(range(1, len(v.embedding) + 1), lambda i: (v.embedding[i]::FLOAT - q.embedding[i]::FLOAT)::DOUBLE ** 2))) AS s FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0"


@register("dense_topk", f"SELECT query_id, chunk_id, round(s, 5) AS score FROM ({_DENSE}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) <= 24")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    found = retrieval.dense(v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v.select(F.col("vec_id").alias("chunk_id"), "embedding"))
    return found.select("query_id", "chunk_id", F.round("dense_score", 5).alias("score"))


@register("dedupe_per_source_cap", f"WITH {BM25_SQL}, c AS (SELECT query_id, chunk_id, r, source, doc_id % 7 AS page, {_KIND_SQL} AS kind, doc_id % 3 AS tab, CASE WHEN doc_id % 5 = 2 THEN doc_id % 11 END AS row_id FROM bm JOIN documents ON chunk_id = doc_id WHERE r <= 20), d AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, source, page, kind, tab, row_id ORDER BY r) = 1) SELECT query_id, chunk_id FROM d QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY r) <= 2")
def dedupe_per_source_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = _corpus(spark, sf_dir)
    found = retrieval.bm25(_questions(spark, sf_dir), retrieval.index(corpus)).withColumn("rerank_score", -F.col("sparse_rank").cast("double"))
    return retrieval.dedupe_and_cap(found.join(corpus, "chunk_id"), 2).select("query_id", "chunk_id")


@register("retrieval_answer")
def retrieval_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, asked = _corpus(spark, sf_dir), _questions(spark, sf_dir).unionByName(fx.frame(spark, tuple((100 + k, t) for k, t in fx.QUESTIONS), "query_id long, text string"))
    v = _table(spark, sf_dir, "embeddings")
    asked_vectors = retrieval.subqueries(asked).join(v.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id").select("query_id", "sub", "embedding")
    out = retrieval.answer(asked, corpus, records.parents(_records(spark, sf_dir)), v.select(F.col("vec_id").alias("chunk_id"), "embedding"), asked_vectors)
    return out.select("query_id", "result", "chunk_id", "forced_for_coverage", F.round("rerank_score", 6).alias("rerank_score"), F.length("parent_text").alias("parent_chars"))


@register("query_expansion")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.subqueries(_asked(spark, sf_dir))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture's questions, and every document and benchmark item as one."""
    d = spread(_table(spark, sf_dir, "documents").select((F.col("doc_id") + 1000).alias("query_id"), "text"))
    b = _table(spark, sf_dir, "benchmark").select((-F.col("item_id") - 1).cast("long").alias("query_id"), "text")
    return d.union(b).union(fx.frame(spark, fx.QUESTIONS, "query_id long, text string")).where("text is not null")


_ASKED_SQL = f"(SELECT * FROM (SELECT doc_id + 1000 AS query_id, text FROM documents UNION ALL SELECT -item_id - 1, text FROM benchmark UNION ALL SELECT * FROM {fx.values(fx.QUESTIONS, 'query_id, text')}) WHERE text IS NOT NULL)"
_THRESHOLD = (
    "regexp_matches(q, 'threshold|cutoff|cut-off|criterion [a-e]|b1|b2|d1|d2|extinction probability|qualif') "
    "OR (regexp_matches(q, 'aoo|eoo|locations|mature individuals') AND regexp_matches(q, 'threshold|cutoff|criterion|qualif'))"
)


@register(
    "threshold_criterion",
    f"""SELECT query_id, {_THRESHOLD} AS asks, CASE WHEN regexp_matches(q, '\\bcriterion\\s*[a-e]\\b') THEN upper(regexp_extract(q, '\\bcriterion\\s*([a-e])\\b', 1)) WHEN regexp_matches(q, '\\b[a-e][12]\\b') THEN upper(regexp_extract(q, '\\b([a-e])[12]\\b', 1))
    WHEN regexp_matches(q, 'aoo|eoo|locations') THEN 'B' WHEN contains(q, 'mature individuals') THEN 'D' WHEN contains(q, 'extinction probability') THEN 'E' END AS criterion FROM (SELECT query_id, lower(text) AS q FROM {_ASKED_SQL})""",
)
def threshold_criterion(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _asked(spark, sf_dir)
    return q.select("query_id", thresholds.is_threshold_query(F.col("text")).alias("asks"), thresholds.criterion(F.col("text")).alias("criterion"))


@register("threshold_lookup")
def threshold_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _asked(spark, sf_dir).select("query_id", thresholds.answer(F.col("text")).alias("answer"))


@register("answer_prompts")
def answer_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus, asked = _corpus(spark, sf_dir), fx.frame(spark, fx.QUESTIONS, "query_id int, text string")
    s = fx.frame(spark, fx.SECTIONS, "doc_id long, pos int, section_key string, text string").where("doc_id = -1")
    hits = draft.retrieve(asked.withColumn("doc_id", F.lit(-1).cast("long")), draft.store(s))
    return answers.prompts(asked, retrieval.answer(asked, corpus, records.parents(_records(spark, sf_dir))), hits)


@register("feedback_rows")
def feedback_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.sections(spark, sf_dir)
    return files.feedback_rows(review.grouped(review.clean_up(review.review(s)), s))


@register("draft_topk")
def draft_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.frame(spark, fx.SECTIONS, "doc_id long, pos int, section_key string, text string")
    asked = fx.frame(spark, fx.QUESTIONS, "query_id int, text string").crossJoin(s.select("doc_id").distinct())  # each question of each draft
    return draft.retrieve(asked, draft.store(s))


# --- model tasks, evaluation, streams --------------------------------------------------------


@register(
    "task_plan",
    f"""WITH r AS (SELECT * FROM {fx.values(fx.TASK_RULES, "name, scope")}), p AS (SELECT * FROM {fx.values(fx.PARTS, "doc_id, pos, title")}), d AS (SELECT DISTINCT doc_id FROM p),
    w AS (SELECT doc_id, name, 0 AS task, (SELECT count(*) FROM p WHERE p.doc_id = d.doc_id AND (scope = 'full_document' OR contains(lower(scope), ' all,') OR list_contains(string_split(replace(lower(substr(scope, 19)), ' ', ''), ','), replace(lower(title), ' ', '')))) AS n FROM d, r WHERE scope <> 'section_type:*')
    SELECT doc_id, name AS rule_name, task, n FROM w UNION ALL SELECT doc_id, name, pos, 1 FROM p, r WHERE scope = 'section_type:*'""",
)
def task_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tasks.plan(fx.frame(spark, fx.TASK_RULES, "name string, scope string"), fx.frame(spark, fx.PARTS, "doc_id string, pos int, title string"))
    return t.select("doc_id", "rule_name", "task", F.size("section_paths").cast("long").alias("n"))


@register(
    "rule_metrics_summary",
    "SELECT event_type, count(*) AS rules_attempted, count(*) FILTER (value > 50) AS rules_succeeded, count(*) FILTER (NOT coalesce(value > 50, false)) AS rules_failed, CAST(sum(user_id) AS BIGINT) AS total_input_tokens, CAST(sum(event_id % 7) AS BIGINT) AS total_output_tokens, CAST(sum(user_id + event_id % 7) AS BIGINT) AS total_tokens, bool_or(event_id % 2 = 0) AS token_estimation_used, CAST(count(*) FILTER (value > 50) AS BIGINT) AS total_findings FROM events GROUP BY 1",
)
def rule_metrics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    r = e.select("event_type", F.when(F.coalesce(F.col("value") > 50, F.lit(False)), "success").otherwise("error").alias("status"), F.col("user_id").alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"), F.when(F.col("event_id") % 2 == 0, "estimated").otherwise("provider").alias("token_source"), F.array(F.lit(1)).alias("findings"))
    return tasks.summarize(r, "event_type")


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn as a model's reply, its content in one of the shapes that providers use."""
    c = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    part = lambda c, key: F.struct(c.alias(key))
    tail = F.concat(F.lit(',"reasoning_details":[{"type":"reasoning.summary","summary":'), F.to_json(F.struct(F.col("text").alias("x"))), F.lit('},{"type":"reasoning.encrypted"}]'))
    content = F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(F.col("text").alias("content"))))
    content = content.when(F.col("turn") % 4 == 1, F.to_json(F.struct(F.array(part(F.col("text"), "text"), part(F.lit("  end "), "text")).alias("content"))))
    content = content.when(F.col("turn") % 4 == 2, F.to_json(F.struct(F.struct(F.lit(" ").alias("text"), F.array(part(F.col("text"), "summary")).alias("content")).alias("content")))).otherwise(F.lit('{"content":[]}'))
    message = F.concat(F.expr("substring(c, 1, length(c) - 1)"), F.when(F.col("turn") % 3 == 0, F.lit(',"reasoning":" why "')).when(F.col("turn") % 3 == 1, F.replace(tail, F.lit('{"x":'), F.lit('{"text":'))).otherwise(F.lit("")), F.lit("}"))
    usage = F.concat(F.lit('{"prompt_tokens":'), F.when(F.col("turn") % 2 == 0, (F.col("turn") + 0.5).cast("string")).otherwise(F.concat(F.lit('"'), F.col("turn").cast("string"), F.lit('"'))), F.lit(',"completion_tokens":null}'))
    return c.withColumn("c", content).select("conv_id", "turn", F.concat(F.lit('{"choices":[{"message":'), message, F.lit('}],"usage":'), usage, F.lit("}")).alias("reply"))


_STRIP_SQL = "nullif(regexp_replace({}, '^\\s+|\\s+$', '', 'g'), '')"


@register(
    "reply_columns",
    f"""WITH s AS (SELECT conv_id, turn, {_STRIP_SQL.format("coalesce(text, '')")} AS t FROM conversations),
    p AS (SELECT *, CASE turn % 4 WHEN 0 THEN t WHEN 1 THEN concat_ws(chr(10), t, 'end') WHEN 2 THEN t END AS output, CASE turn % 3 WHEN 0 THEN 'why' WHEN 1 THEN concat_ws(chr(10) || chr(10), 'Summary: ' || t, '[Encrypted reasoning block]') END AS thinking FROM s)
    SELECT conv_id, turn, output, thinking, CASE WHEN output IS NULL AND thinking IS NULL THEN 'OpenAI client returned an empty completion payload' END AS error, CAST(CASE WHEN turn % 2 = 0 THEN round_even(turn + 0.5, 0) ELSE turn END AS BIGINT) AS input_tokens, CAST(NULL AS BIGINT) AS output_tokens FROM p""",
)
def reply_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, reply = _replies(spark, sf_dir), F.col("reply")
    return r.withColumn("p", replies.parts(reply)).select("conv_id", "turn", "p.output", "p.thinking", "p.error", replies.token_count(reply, "prompt_tokens").alias("input_tokens"), replies.token_count(reply, "completion_tokens").alias("output_tokens"))


@register(
    "request_payloads",
    """SELECT page_id, length(CASE WHEN page_id % 2 = 0 THEN '{"model":"m","max_tokens":4096,"system":"s","messages":[{"role":"user","content":' ELSE '{"model":"m","max_tokens":4096,"messages":[{"role":"system","content":"s"},{"role":"user","content":' END || to_json(url) || '}]}') AS n, replace(replace(url, '/', '_'), ':', '_') AS slug FROM pages WHERE url IS NOT NULL""",
)
def request_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = F.when(F.col("page_id") % 2 == 0, "anthropic").otherwise("openrouter")
    p = _table(spark, sf_dir, "pages").where("url is not null")
    return p.select("page_id", F.length(replies.payload(provider, F.lit("m"), F.lit("s"), F.col("url"))).cast("long").alias("n"), replies.slug(F.col("url")).alias("slug"))


@register(
    "friendly_errors",
    f"SELECT event_id, CASE WHEN contains(e, '503') OR contains(e, '502') THEN '{replies.UNAVAILABLE}' WHEN contains(e, '429') THEN '{replies.LIMITED}' ELSE nullif(e, '') END AS message FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'status ' || event_id END AS e FROM events)",
)
def friendly_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    error = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit("status "), F.col("event_id").cast("string")))
    return _table(spark, sf_dir, "events").select("event_id", replies.friendly(error).alias("message"))


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as rule results: an order a document, a line status a model."""
    line = _table(spark, sf_dir, "lineitem")
    ok = F.col("l_returnflag") != "R"
    return line.select(
        F.col("l_orderkey").cast("string").alias("doc_id"), F.lit("p").alias("provider"), F.concat(F.lit("a/b:"), F.col("l_linestatus")).alias("model"), F.col("l_returnflag").alias("rule_name"), F.col("l_linenumber").cast("int").alias("task"),
        F.when(ok, "success").otherwise("error").alias("status"), F.when(~ok, F.lit("x")).alias("error"), F.array_repeat(F.lit(1), (F.col("l_linenumber") % 3).cast("int")).alias("findings"),
        F.col("l_linenumber").cast("long").alias("input_tokens"), F.lit(2).cast("long").alias("output_tokens"), F.lit("provider").alias("token_source"), F.lit(0.5).alias("duration_seconds"),
    )


_RUNS_SQL = """SELECT CAST(l_orderkey AS VARCHAR) AS doc_id, 'a/b:' || l_linestatus AS model, count(*) AS rules_attempted, count(*) FILTER (l_returnflag = 'R') AS rules_failed, CAST(sum(l_linenumber) AS BIGINT) AS total_input_tokens, 2 * count(*) AS total_output_tokens, CAST(coalesce(sum(l_linenumber % 3) FILTER (l_returnflag <> 'R'), 0) AS BIGINT) AS total_findings FROM lineitem GROUP BY 1, 2"""


@register("grid_runs", f"SELECT doc_id, model, rules_attempted, rules_failed, total_findings, CASE WHEN rules_failed = 0 THEN 'success' ELSE 'error' END AS status, rules_failed AS errors, doc_id || '/p__' || replace(replace(model, '/', '_'), ':', '_') || '_meta.json' AS meta_path FROM ({_RUNS_SQL})")
def grid_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.grid_runs(_graded(spark, sf_dir)).select("doc_id", "model", "rules_attempted", "rules_failed", "total_findings", "status", F.size("errors").cast("long").alias("errors"), "meta_path")


@register(
    "grid_summary",
    f"SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT model) AS models, count(*) AS runs_attempted, count(*) FILTER (rules_failed = 0) AS runs_succeeded, count(*) FILTER (rules_failed > 0) AS runs_failed, CAST(sum(rules_attempted) AS BIGINT) AS rules_attempted, CAST(sum(rules_attempted - rules_failed) AS BIGINT) AS rules_succeeded, CAST(sum(rules_failed) AS BIGINT) AS rules_failed, CAST(sum(total_input_tokens) AS BIGINT) AS total_input_tokens, CAST(sum(total_output_tokens) AS BIGINT) AS total_output_tokens, CAST(sum(total_input_tokens + total_output_tokens) AS BIGINT) AS total_tokens, CAST(sum(total_findings) AS BIGINT) AS total_findings, false AS token_estimation_used FROM ({_RUNS_SQL})",
)
def grid_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tasks.grid_summary(tasks.grid_runs(_graded(spark, sf_dir)))


_BIGRAMS = "SELECT doc_id, b, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(list_zip(t[1:len(t) - 1], t[2:]), lambda x: x[1] || ' ' || x[2])) AS b FROM (SELECT doc_id, regexp_extract_all(lower({}), '[a-z0-9]+') AS t FROM documents) WHERE len(t) > 1) GROUP BY 1, 2"


@register(
    "eval_bigram_f1",
    f"""WITH e AS ({_BIGRAMS.format("text")}), g AS ({_BIGRAMS.format("regexp_replace(text, '[0-9]+', '', 'g')")}), s AS (SELECT doc_id, sum(least(coalesce(e.n, 0), coalesce(g.n, 0))) AS same, coalesce(sum(e.n), 0) AS want, coalesce(sum(g.n), 0) AS have FROM e FULL JOIN g USING (doc_id, b) GROUP BY doc_id)
    SELECT doc_id, round(CASE WHEN have > 0 THEN same / have ELSE 0 END, 9) AS "precision", round(CASE WHEN want > 0 THEN same / want ELSE 0 END, 9) AS recall FROM s""",
)
def eval_bigram_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    out = evaluation.overlap(d.select("doc_id", "text"), d.select("doc_id", F.regexp_replace("text", "[0-9]+", "").alias("text")))
    return out.select("doc_id", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@register("eval_distribution", "WITH e AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), g AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1) SELECT round(1 - sum(abs(coalesce(e.n, 0) - coalesce(g.n, 0))) / sum(e.n), 9) AS score FROM e FULL JOIN g USING (lang)")
def eval_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _table(spark, sf_dir, "documents")
    count = lambda x: x.groupBy("lang").agg(F.count("*").alias("n"))
    return evaluation.distribution_score(count(d), count(d.join(_table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")), "lang").select(F.round("score", 9).alias("score"))


@register("events_tumbling", "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.tumbling(_table(spark, sf_dir, "events"))


@register(
    "events_session",
    "WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k",
)
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream.sessions(_table(spark, sf_dir, "events"))
