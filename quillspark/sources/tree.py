"""Block rows to report sections, and the JSON tree to block rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.schemas import ITEMS

BLOCK = f"struct<type:string,text:string,text_rich:string,signature:string,items:{ITEMS},rows:array<array<string>>,rows_rich:array<array<string>>,data:map<string,array<string>>>"
LEAF = f"struct<title:string,level:int,path:array<string>,blocks:array<{BLOCK}>>"
CHILD = f"struct<title:string,level:int,path:array<string>,blocks:array<{BLOCK}>,children:array<{LEAF}>>"
TREE = f"title string, level int, path array<string>, blocks array<{BLOCK}>, children array<{CHILD}>"


def blocks_of_trees(trees: DataFrame) -> DataFrame:
    """Block rows of (doc_id, tree columns): root, then each child before its own children."""
    node = lambda h1, h2, at, blocks: F.struct(h1.alias("h1"), h2.alias("h2"), at.alias("at"), blocks.alias("blocks"))
    none = F.lit(None).cast("string")
    root = F.array(node(none, none, F.array(F.lit(-1), F.lit(-1)), F.col("blocks")))

    def of_child(c: Column, i: Column) -> Column:
        h1 = F.when(c["level"] == 1, c["title"])
        h2 = F.when(c["level"] == 1, none).otherwise(c["title"])
        own = F.array(node(h1, h2, F.array(i, F.lit(-1)), c["blocks"]))
        below = F.transform(F.coalesce(c["children"], F.array().cast(f"array<{LEAF}>")), lambda g, j: node(h1, g["title"], F.array(i, j), g["blocks"]))
        return F.concat(own, below)

    nodes = F.concat(root, F.flatten(F.transform(F.coalesce("children", F.array().cast(f"array<{CHILD}>")), of_child)))
    rows = trees.select("doc_id", F.col("title").alias("doc_title"), F.posexplode(nodes).alias("node", "n"))
    rows = rows.select("doc_id", "doc_title", "n.h1", "n.h2", "node", F.posexplode("n.blocks").alias("block_pos", "b"))
    return rows.select("doc_id", "doc_title", "h1", "h2", "node", "block_pos", "b.type", "b.text", "b.text_rich", "b.signature", "b.items", "b.rows", "b.rows_rich", F.col("b.data").alias("style"))


def _text(c: Column) -> Column:
    return F.trim(F.replace(F.coalesce(c, F.lit("")), F.lit("\xa0"), F.lit(" ")))


def _path() -> Column:
    """Titles from the document's down, blank ones left out."""
    return F.array_join(F.filter(F.array("doc_title", "h1", "h2"), lambda x: x.isNotNull() & (x != "")), " > ")


def _numbered(blocks: DataFrame, shown: Column) -> DataFrame:
    """Blocks that show something, numbered by type within their node."""
    kind = F.lower(F.trim(F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("block"))))
    same = Window.partitionBy("doc_id", "node", "kind").orderBy("block_pos")
    return blocks.withColumn("kind", kind).where(shown).withColumn("nth", F.row_number().over(same)).withColumn("key", F.concat(_path(), F.lit(" ["), F.col("kind"), F.lit(" "), F.col("nth"), F.lit("]")))


def sections(blocks: DataFrame, html_fallback: bool = False) -> DataFrame:
    """(doc_id, pos, section_key, text): a section per paragraph and per table row, rich text.

    HTML has no rich text and shows nothing here unless html_fallback takes its plain
    text. A key that comes again keeps its first place and takes the later text.
    """
    rich = F.coalesce("text_rich", "text") if html_fallback else F.col("text_rich")
    rows = F.coalesce("rows_rich", "rows") if html_fallback else F.col("rows_rich")
    cells = lambda r: F.filter(F.transform(r, _text), lambda x: x != "")
    lines = F.filter(F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.array_join(cells(r), " | ")), lambda x: x != "")
    b = blocks.withColumn("paragraph", F.when(F.col("type") == "paragraph", _text(rich)).otherwise(F.lit(""))).withColumn("lines", F.when(F.col("type") == "table", lines).otherwise(F.array().cast("array<string>")))
    b = _numbered(b, (F.col("paragraph") != "") | (F.size("lines") > 0))
    row = F.transform("lines", lambda x, i: F.struct(F.concat("key", F.lit(" [row "), (i + 1).cast("string"), F.lit("]")).alias("section_key"), x.alias("text"), i.alias("i")))
    one = F.array(F.struct(F.col("key").alias("section_key"), F.col("paragraph").alias("text"), F.lit(0).alias("i")))
    s = b.select("doc_id", "node", "block_pos", F.explode(F.when(F.col("kind") == "table", row).otherwise(one)).alias("s")).select("doc_id", F.struct("node", "block_pos", "s.i").alias("at"), "s.section_key", "s.text")
    s = s.groupBy("doc_id", "section_key").agg(F.min("at").alias("at"), F.max_by("text", "at").alias("text"))
    return s.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1).select("doc_id", "pos", "section_key", "text")


def section_html(blocks: DataFrame) -> DataFrame:
    """(doc_id, pos, section_path, html): paragraphs and tables of each heading path as HTML, fragments of a repeated path joined."""
    rich = F.trim(F.coalesce("text_rich", F.lit("")))
    low = F.lower(rich)
    paragraph = F.when((F.col("type") == "paragraph") & (rich != ""), F.when(low.startswith("<p") & low.endswith("</p>"), rich).otherwise(F.concat(F.lit("<p>"), rich, F.lit("</p>"))))
    cell = lambda c: F.trim(F.coalesce(c, F.lit("")))
    full = F.filter(F.coalesce("rows_rich", F.array().cast("array<array<string>>")), lambda r: F.exists(r, lambda c: cell(c) != ""))
    lines = F.transform(full, lambda r: F.concat(F.lit("  <tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), cell(c), F.lit("</td>"))), ""), F.lit("</tr>")))
    table = F.when((F.col("type") == "table") & (F.size(lines) > 0), F.concat(F.lit("<table>\n"), F.array_join(lines, "\n"), F.lit("\n</table>")))
    b = blocks.withColumn("html", F.coalesce(paragraph, table)).where("html is not null")
    path = F.coalesce(F.nullif(_path(), F.lit("")), F.lit("Assessment"))
    s = b.groupBy("doc_id", path.alias("section_path")).agg(F.min(F.struct("node", "block_pos")).alias("at"), F.array_sort(F.collect_list(F.struct("node", "block_pos", "html"))).alias("parts"))
    s = s.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("at")) - 1)
    return s.select("doc_id", "pos", "section_path", F.array_join(F.transform("parts", lambda p: p["html"]), "\n").alias("html"))
