"""Retrieval records from layout blocks and tables, and the chunked corpus from records."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sizes and shapes that the records depend on.
MIN_CHARS, MAX_CHARS, LEAST_CHARS, EDGE_SHARE = 220, 1200, 40, 0.6
NUMBERED = r"^(\d+(?:\.\d+)*)\s+(.+)$"
CHUNK, OVERLAP, TABLE_CHUNK, TABLE_OVERLAP = 800, 100, 2400, 200
SEPARATORS = ("\n\n", "\n", "Page ", ". ", " ", "")
SCHEMAS = (
    "required information purpose guidance notes", "required information specific condition purpose guidance notes",
    "specific condition purpose guidance notes", "recommended supporting information specific condition purpose guidance notes",
)


def clean_text(c: Column) -> Column:
    c = F.translate(c, "\x00‐–—\xad", " ---")
    return F.trim(F.regexp_replace(F.replace(c, F.lit("•"), F.lit(" • ")), r"(?U)\s+", " "))


def repeat_key(c: Column) -> Column:
    """Text that is equal on pages that differ in their numbers."""
    c = F.regexp_replace(F.lower(clean_text(c)), r"\bpage\s+\d+\b", "page")
    return F.regexp_replace(c, r"\d+", "#")


def words(c: Column) -> Column:
    return F.size(F.filter(F.split(c, " "), lambda w: w != ""))


def is_heading(text: Column, font: Column, bold: Column, body_font: Column) -> Column:
    t = clean_text(text)
    shape = t.rlike(NUMBERED) | ((font >= body_font * 1.22) & (words(t) <= 16)) | (bold & (words(t) <= 12) & ~t.rlike("[.;:]$"))
    capitals = (t == F.upper(t)) & (t != F.lower(t)) & words(t).between(2, 10)
    return (t != "") & (F.length(t) <= 160) & (shape | capitals)


def repeated_edges(blocks: DataFrame) -> DataFrame:
    """(source_file, key): texts among the first or last two blocks of most pages. On pages with few blocks one counts twice."""
    key = repeat_key(F.col("text"))
    page = Window.partitionBy("source_file", "page")
    order = [F.col("bbox")[1], F.col("bbox")[0], F.col("text")]
    b = blocks.withColumn("key", key).withColumn("from_top", F.row_number().over(page.orderBy(*order))).withColumn("size", F.count("*").over(page))
    edges = b.withColumn("times", (F.col("from_top") <= 2).cast("int") + (F.col("from_top") > F.col("size") - 2).cast("int")).where("times > 0 and length(key) >= 6")
    pages = blocks.groupBy("source_file").agg(F.countDistinct("page").alias("pages")).where("pages > 1")
    seen = edges.groupBy("source_file", "key").agg(F.sum("times").alias("times"))
    return seen.join(pages, "source_file").where(F.col("times") / F.col("pages") >= EDGE_SHARE).select("source_file", "key")


MERGED = "source_file string, doc_id string, page int, raw_text string, section_path array<string>, kind string"


def merge_blocks(blocks: DataFrame) -> DataFrame:
    """Text records of each document: blocks in reading order, cut at headings, page ends and MAX_CHARS; rows of kind `page` hold each page's heading path.

    The fold over a document's blocks carries a heading path across pages, so a document is one group; groups are as large as their longest document.
    """
    kept = blocks.withColumn("key", repeat_key(F.col("text"))).join(repeated_edges(blocks), ["source_file", "key"], "left_anti")
    kept = kept.select("source_file", "page", F.col("bbox")[1].alias("y"), F.col("bbox")[0].alias("x"), "text", clean_text(F.col("text")).alias("clean"), is_heading(F.col("text"), F.col("font_size"), F.col("is_bold"), F.col("body_font")).alias("heading"))

    def fold(b: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        source, path, n = b["source_file"].iloc[0], [], 0
        stem = source.rpartition("/")[2].rpartition(".")[0] or source
        for page, rows in b.sort_values(["page", "y", "x"], kind="stable").groupby("page", sort=True):
            waiting: list[str] = []
            head = list(path)

            def flush() -> None:
                nonlocal n
                text = " ".join(" ".join(waiting).split())
                waiting.clear()
                if len(text) >= LEAST_CHARS:
                    n += 1
                    out.append((source, f"{stem}::text::{n:05d}", page, text, list(path) or None, "text"))

            for text, heading in zip(rows["clean"], rows["heading"], strict=True):
                if heading:
                    flush()
                    number = re.match(NUMBERED, text)
                    path = [*path[: number[1].count(".") if number else 0], text]
                    head = list(path)
                    continue
                if waiting and len(" ".join([*waiting, text])) > MAX_CHARS and len(" ".join(waiting)) >= MIN_CHARS:
                    flush()
                waiting.append(text)
            flush()
            out.append((source, None, page, None, head or list(path) or None, "page"))
        return pd.DataFrame(out, columns=[c.split()[0] for c in MERGED.split(", ")])

    return kept.groupBy("source_file").applyInPandas(fold, MERGED)


def contextualized(raw: Column, source: Column, page: Column, path: Column, kind: Column, title: Column) -> Column:
    line = lambda name, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{name}: "), c))
    return F.concat_ws("\n", F.concat(F.lit("Source: "), source), F.concat(F.lit("Page: "), page.cast("string")), F.concat(F.lit("Block type: "), kind), line("Section path", F.array_join(path, " > ")), line("Table title", title), F.lit("Content:"), strip(raw))


def section_path_as_of(pages: DataFrame, paths: DataFrame) -> DataFrame:
    """Each (source_file, page) with its own heading path, or the nearest earlier page's."""
    known = paths.select("source_file", "page", F.when(F.size("section_path") > 0, F.col("section_path")).alias("section_path"))
    every = pages.select("source_file", "page").distinct().join(known, ["source_file", "page"], "full_outer")
    so_far = Window.partitionBy("source_file").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return every.withColumn("section_path", F.last("section_path", ignorenulls=True).over(so_far)).join(pages.select("source_file", "page").distinct(), ["source_file", "page"])


def table_records(tables: DataFrame) -> DataFrame:
    """Records of tables (source_file, page, table_no, section_path, cells): one for the table, one for each row below its header."""
    cells = F.filter(F.transform("cells", lambda r: F.transform(r, lambda c: clean_text(F.coalesce(c, F.lit(""))))), lambda r: F.exists(r, lambda c: c != ""))
    t = tables.withColumn("cells", cells).where("size(cells) >= 2")
    width = F.aggregate("cells", F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    pad = lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.lit(0), F.col("width") - F.size(r))))
    t = t.withColumn("width", width).withColumn("cells", F.transform("cells", pad))
    t = t.withColumn("headers", F.transform(F.col("cells")[0], lambda c, i: F.when(c == "", F.concat(F.lit("column_"), (i + 1).cast("string"))).otherwise(c)))
    stem = F.regexp_replace("source_file", r"^.*/|\.[^.]*$", "")
    table_id = F.concat(stem, F.lit("::table::"), F.format_string("%03d", F.col("table_no")))
    title = F.coalesce(F.element_at("section_path", -1), F.concat(F.lit("Table with headers: "), F.array_join(F.slice("headers", 1, 4), " | ")))
    t = t.withColumn("table_id", table_id).withColumn("table_title", title)
    pairs = lambda r: F.array_join(F.zip_with("headers", r, lambda h, v: F.concat(h, F.lit(": "), v)), " | ")
    body = F.transform(F.slice("cells", 2, 1_000_000), lambda r, i: F.struct((i + 1).alias("row_id"), pairs(r).alias("raw"), F.lit("table_row").alias("kind"), F.lit(1.3).alias("priority")))
    whole = F.struct(F.lit(None).cast("int").alias("row_id"), F.array_join(F.transform("cells", lambda r: F.array_join(r, " | ")), "\n").alias("raw"), F.lit("table").alias("kind"), F.lit(1.0).alias("priority"))
    rows = t.select("source_file", "page", "section_path", "table_id", "table_title", F.explode(F.concat(F.array(whole), body)).alias("r"))
    doc_id = F.concat("table_id", F.when(F.col("r.row_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("::row::"), F.format_string("%03d", F.col("r.row_id")))))
    return rows.select(
        doc_id.alias("doc_id"), "source_file", "page", F.col("r.kind").alias("block_type"),
        contextualized(F.col("r.raw"), F.col("source_file"), F.col("page"), F.col("section_path"), F.col("r.kind"), F.col("table_title")).alias("text"), F.col("r.raw").alias("raw_text"),
        F.element_at("section_path", -1).alias("section_title"), "section_path", "table_id", "table_title", F.col("r.row_id").alias("row_id"),
        F.when(F.col("r.kind") == "table_row", F.col("table_id")).alias("parent_id"), F.col("r.priority").alias("priority"),
    )


def drop_overlaps(records: DataFrame) -> DataFrame:
    """Without text that repeats a page's tables, and one record for equal text on a page: rows before tables before text, then the first."""
    kind, raw, section = F.col("block_type"), F.lower("raw_text"), F.lower(F.coalesce("section_title", F.lit("")))
    pages = records.where(kind.isin("table", "table_row")).select("source_file", "page").distinct().withColumn("has_table", F.lit(True))
    says = raw.contains("table 1") | raw.contains("table 2") | raw.contains("table 3") | section.contains(SCHEMAS[0]) | section.contains(SCHEMAS[2])
    rows = records.join(pages, ["source_file", "page"], "left").where(~(F.coalesce("has_table", F.lit(False)) & (kind == "text") & says)).drop("has_table")
    rank = F.when(kind == "table_row", 3).when(kind == "table", 2).when(kind == "text", 1).otherwise(0)
    best = Window.partitionBy("source_file", "page", repeat_key(F.col("raw_text"))).orderBy(rank.desc(), "doc_id")
    return rows.withColumn("nth", F.row_number().over(best)).where("nth = 1").drop("nth")


def supporting_table(page_text: Column) -> Column:
    t = F.lower(clean_text(page_text))
    required, recommended = t.contains("required supporting information"), t.contains("recommended supporting information")
    return F.when(t.contains("table 1") & required, "Table 1").when(t.contains("table 2") & required, "Table 2").when(t.contains("table 3") & recommended, "Table 3")


def has_flattened_schema(page_text: Column) -> Column:
    t = F.lower(clean_text(page_text))
    return t.contains(SCHEMAS[0]) | t.contains(SCHEMAS[1]) | t.contains(SCHEMAS[2]) | t.contains(SCHEMAS[3])


def enumerated(page_text: Column) -> Column:
    """Array of (number, entry) of a numbered list with two entries or more; short ones left out."""
    t = clean_text(page_text)
    parts = F.filter(F.split(t, r"(?<!\d)(?=\d{1,2}\.\s+)"), lambda p: p.rlike(r"^\d{1,2}\.\s+"))
    entries = F.filter(F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\d+)", 1).cast("int").alias("number"), F.trim(p).alias("entry"))), lambda e: F.length(e["entry"]) >= 25)
    return F.when(F.size(parts) >= 2, entries).otherwise(F.array().cast("array<struct<number:int,entry:string>>"))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


# Titles and columns of the supporting information tables.
SUPPORT_TITLES = {
    "Table 1": "Table 1: Required supporting information for all assessments",
    "Table 2": "Table 2: Required supporting information under specific conditions",
    "Table 3": "Table 3: Recommended supporting information",
}
SUPPORT_COLUMNS = {
    "Table 1": "Required Information | Purpose | Guidance | Notes",
    "Table 2": "Required Information | Specific Condition | Purpose | Guidance | Notes",
    "Table 3": "Recommended Supporting Information | Specific Condition | Purpose | Guidance | Notes",
}


def supporting_rows(pages: DataFrame) -> DataFrame:
    """Records of supporting information tables whose layout was lost, from page texts (source_file, page, text): the table that a page names holds until another is named; its numbered entries become rows under a made-up parent."""
    so_far = Window.partitionBy("source_file").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    p = pages.withColumn("table_name", F.last(supporting_table(F.col("text")), ignorenulls=True).over(so_far)).where("table_name is not null")
    e = p.select("source_file", "page", "table_name", F.posexplode(enumerated(F.col("text"))).alias("i", "e")).select("source_file", "page", "table_name", "i", "e.number", "e.entry")
    e = e.withColumn("row_id", F.row_number().over(Window.partitionBy("source_file", "table_name").orderBy("page", "i")))
    of = lambda table: F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), F.col("table_name"))
    line = F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" | Entry "), F.col("number").cast("string"), F.lit(": "), F.col("entry"))
    whole = e.groupBy("source_file", "table_name").agg(F.min("page").alias("page"), F.transform(F.array_sort(F.collect_list(F.struct("row_id", line.alias("x")))), lambda s: s["x"]).alias("lines"))
    whole = whole.select("source_file", "page", "table_name", F.lit(None).cast("int").alias("row_id"), F.lit(None).cast("int").alias("number"), F.lit("table").alias("block_type"), F.lit(1.1).alias("priority"), F.array_join(F.concat(F.array(of(SUPPORT_TITLES), F.concat(F.lit("Schema: "), of(SUPPORT_COLUMNS))), "lines"), "\n").alias("raw_text"))
    rows = e.select("source_file", "page", "table_name", "row_id", "number", F.lit("table_row").alias("block_type"), F.lit(1.55).alias("priority"), F.concat(F.lit("Entry "), F.col("number").cast("string"), F.lit(": "), F.col("entry")).alias("raw_text"))
    out = whole.unionByName(rows).withColumn("table_id", F.lower(F.replace(F.col("table_name"), F.lit(" "), F.lit("_")))).withColumn("table_title", of(SUPPORT_TITLES))
    return out.withColumn("metadata", F.struct(F.lit(True).alias("fallback"), "table_name", of(SUPPORT_COLUMNS).alias("schema"), F.col("number").alias("entry_number"))).drop("number", "table_name")


def display_text(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    body = strip(F.regexp_extract(t, r"(?s)^.*?Content:(.*)\z", 1))
    return F.when(t.contains("Content:") & (body != ""), body).otherwise(t)


def search_text(piece: Column) -> Column:
    """Labelled lines of a chunk; lines without a value are left out."""
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c.cast("string"))
    col = lambda c: F.col(c).cast("string")
    lines = F.array(
        line("Source file", col("source_file")), line("Section title", col("section_title")), line("Section path", col("section_path_str")),
        line("Table title", col("table_title")), line("Block type", col("block_type")), line("Page", col("page")), line("Content", piece),
    )
    return F.array_join(F.filter(lines, lambda x: x.isNotNull() & ~x.rlike(r"(: None|: )$")), "\n")


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most `size` where the text can be cut, by the first separator that it has, each beginning with up to `overlap` of what came before."""
    sep = next((s for s in separators if s == "" or s in text), "")
    rest = separators[separators.index(sep) + 1 :]
    parts = list(text) if sep == "" else [p if k == 0 else sep + p for k, p in enumerate(text.split(sep))]
    out: list[str] = []
    window: list[str] = []
    length = 0

    def emit() -> None:
        if piece := "".join(window).strip():
            out.append(piece)

    for part in (p for p in parts if p):
        if len(part) > size and rest:
            emit()
            window, length = [], 0
            out += split_text(part, size, overlap, rest)
            continue
        if window and length + len(part) > size:
            emit()
            while window and (length > overlap or length + len(part) > size):
                length -= len(window.pop(0))
        window.append(part)
        length += len(part)
    emit()
    return out


def chunks(records: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """The corpus: rows whole, tables and texts in overlapping pieces, with their search text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pieces = [
                [text] if kind == "table_row" else split_text(text, TABLE_CHUNK if kind == "table" else size, TABLE_OVERLAP if kind == "table" else overlap)
                for text, kind in zip(b["body"], b["block_type"], strict=True)
            ]
            yield pd.DataFrame({"key": b["key"], "pieces": pieces})

    r = records.where(strip(F.coalesce("text", F.lit(""))) != "").withColumn("block_type", F.coalesce("block_type", F.lit("text"))).withColumn("body", display_text(F.col("text")))
    r = r.withColumn("section_path_str", F.array_join("section_path", " > "))
    cut = r.select(F.col("doc_id").alias("key"), "body", "block_type").mapInPandas(run, "key string, pieces array<string>").select("key", F.posexplode("pieces").alias("nth", "piece"))
    c = cut.join(r, F.col("key") == F.col("doc_id")).withColumn("priority", F.coalesce("priority", F.lit(1.0)))
    return c.select(
        F.concat("doc_id", F.lit("::"), F.col("nth").cast("string")).alias("chunk_id"), F.col("piece").alias("text"), search_text(F.col("piece")).alias("search_text"), "doc_id", "source_file",
        "page", "block_type", "table_id", "table_title", "row_id", "parent_id", "section_title", F.col("section_path_str").alias("section_path"), "priority",
    )


def parents(records: DataFrame) -> DataFrame:
    """The first table record of each (source_file, table_id), by doc_id."""
    rows = records.where("block_type = 'table' and source_file <> ''").withColumn("table_id", F.coalesce("table_id", F.lit("None")))
    first = F.row_number().over(Window.partitionBy("source_file", "table_id").orderBy("doc_id"))
    return rows.withColumn("nth", first).where("nth = 1").select("source_file", "table_id", "table_title", "page", display_text(F.col("text")).alias("text"), "section_title")


def build_summary(records: DataFrame, corpus: DataFrame, size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row: records, chunks, table rows, and those of tables that were put together from running text."""
    row, made = F.col("block_type") == "table_row", F.coalesce(F.col("metadata.fallback"), F.lit(False)) if "metadata" in records.columns else F.lit(False)
    r = records.agg(
        F.count("*").alias("raw_record_count"), F.count_if(row).alias("table_row_count"), F.count_if(row & made).alias("fallback_table_row_count"),
        F.count_if((F.col("block_type") == "table") & made).alias("synthetic_parent_count"),
    )
    figures = corpus.agg(F.count("*").alias("chunk_count"), F.lit(size).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"))
    return r.crossJoin(F.broadcast(figures))  # one row each
