"""DOCX documents to block and comment rows, with zipfile and ElementTree.

Paragraphs and tables of the body in order; "Heading 1" and "Heading 2" make the tree
(a repeated title goes on with the first node); runs of equal format are wrapped in
tags; list items of one numbering form one list.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import html
from quillspark.sources.nodes import Tree
from quillspark.sources.schemas import BLOCKS, COMMENTS

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
Format = tuple[bool, bool, str | None]


def _flag(holder: ElementTree.Element | None, name: str) -> bool | None:
    e = holder.find(W + name) if holder is not None else None
    return None if e is None else e.get(W + "val", "1").lower() not in ("0", "false", "off", "none")


def wrap(text: str, fmt: Format) -> str:
    bold, italic, vertical = fmt
    for tag, on in (({"superscript": "sup", "subscript": "sub"}.get(vertical), vertical), ("i", italic), ("b", bold)):
        if on and tag:
            text = f"<{tag}>{text}</{tag}>"
    return text


@dataclass
class Docx:
    body: list[ElementTree.Element]
    names: dict[str, str]
    looks: dict[str, tuple[bool | None, bool | None]]
    comments: ElementTree.Element | None

    @classmethod
    def load(cls, content: bytes) -> Docx:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            parts = {n: ElementTree.fromstring(z.read(n)) for n in ("word/document.xml", "word/styles.xml", "word/comments.xml") if n in z.namelist()}
        names, looks = {}, {}
        for s in parts.get("word/styles.xml", ElementTree.Element("none")).iter(W + "style"):
            key, name = s.get(W + "styleId", ""), s.find(W + "name")
            names[key] = name.get(W + "val", "") if name is not None else key
            looks[key] = _flag(s.find(W + "rPr"), "b"), _flag(s.find(W + "rPr"), "i")
        body = parts["word/document.xml"].find(W + "body")
        return cls([e for e in body if e.tag in (W + "p", W + "tbl")] if body is not None else [], names, looks, parts.get("word/comments.xml"))

    def style_id(self, p: ElementTree.Element) -> str:
        e = p.find(f"{W}pPr/{W}pStyle")
        return e.get(W + "val", "") if e is not None else "Normal"

    def style(self, p: ElementTree.Element) -> str:
        key = self.style_id(p)
        return self.names.get(key, key).strip()

    def level(self, p: ElementTree.Element) -> int | None:
        return {"heading1": 1, "heading2": 2}.get(self.style(p).replace(" ", "").lower())

    def run_text(self, r: ElementTree.Element) -> str:
        out = []
        for e in r:
            out.append({W + "t": e.text or "", W + "tab": "\t", W + "br": "\n", W + "cr": "\n"}.get(e.tag, ""))
        return "".join(out)

    def text(self, p: ElementTree.Element) -> str:
        return "".join(self.run_text(r) for r in p.iter(W + "r"))

    def look(self, p: ElementTree.Element, r: ElementTree.Element) -> Format:
        """The run's own property, else its style's, else its paragraph style's."""
        pr = r.find(W + "rPr")
        style = pr.find(W + "rStyle") if pr is not None else None
        levels = [self.looks.get(style.get(W + "val", ""), (None, None)) if style is not None else (None, None), self.looks.get(self.style_id(p), (None, None))]
        own = _flag(pr, "b"), _flag(pr, "i")
        bold, italic = (next((x for x in (own[k], levels[0][k], levels[1][k]) if x is not None), False) for k in (0, 1))
        vert = pr.find(W + "vertAlign") if pr is not None else None
        value = vert.get(W + "val") if vert is not None else None
        return bold, italic, value if value in ("superscript", "subscript") else None

    def islands(self, p: ElementTree.Element) -> list[tuple[Format, str]]:
        """Neighbouring runs of one format as one."""
        out: list[tuple[Format, str]] = []
        for r in p.findall(W + "r"):
            if text := self.run_text(r):
                fmt = self.look(p, r)
                if out and out[-1][0] == fmt:
                    out[-1] = fmt, out[-1][1] + text
                else:
                    out.append((fmt, text))
        return out

    def rich(self, p: ElementTree.Element) -> str:
        return "".join(wrap(t, f) for f, t in self.islands(p)).strip()

    def numbering(self, p: ElementTree.Element) -> str | None:
        num = p.find(f"{W}pPr/{W}numPr")
        if num is None:
            return None
        value = lambda n: e.get(W + "val") if (e := num.find(W + n)) is not None else None
        return f"numId={value('numId')}|ilvl={value('ilvl')}|style={self.style(p)}"

    def cells(self, table: ElementTree.Element) -> list[list[list[ElementTree.Element]]]:
        return [[c.findall(W + "p") for c in row.findall(W + "tc")] for row in table.findall(W + "tr")]


def parse(content: bytes, title: str) -> Tree:
    doc, tree = Docx.load(content), Tree(title, merge=True)
    last: tuple[str, dict] | None = None
    for e in doc.body:
        if e.tag == W + "tbl":
            last = None
            cells = doc.cells(e)
            lines = lambda ps, f: "\n".join(t for p in ps if (t := f(p).strip()))
            tree.add(type="table", rows=[[lines(c, doc.text) for c in row] for row in cells], rows_rich=[[lines(c, doc.rich) for c in row] for row in cells])
            continue
        if level := doc.level(e):
            last = None
            tree.heading(doc.text(e), level)
            continue
        text = doc.text(e).strip()
        if not text:
            continue
        islands = [(f, t.replace("\xa0", " ")) for f, t in doc.islands(e)]
        tree.at.note({"bold": [t for f, t in islands if f[0]], "italic": [t for f, t in islands if f[1]]})
        sign = doc.numbering(e)
        if sign is None:
            last = None
            tree.add(type="paragraph", text=text, text_rich=doc.rich(e))
            continue
        item = {"text": text, "text_rich": doc.rich(e), "style": doc.style(e)}
        if last is None or last[0] != sign:
            block = {"type": "list", "signature": sign, "items": []}
            tree.at.blocks.append(block)
            last = sign, block
        last[1]["items"].append(item)
    return tree


@dataclass
class _Anchor:
    path: list[str] = field(default_factory=list)
    text: list[str] = field(default_factory=list)
    rich: list[str] = field(default_factory=list)
    context: list[str] = field(default_factory=list)
    context_rich: list[str] = field(default_factory=list)


def comments(content: bytes) -> list[dict]:
    """Comments with the text that they are anchored to, over as many paragraphs as the anchor covers, and up to six paragraphs of context."""
    doc = Docx.load(content)
    if doc.comments is None:
        return []
    meta = {c.get(W + "id"): c for c in doc.comments.findall(W + "comment") if c.get(W + "id") is not None}
    anchors = {k: _Anchor() for k in meta}
    path: list[str] = []
    open_: list[str] = []
    paragraphs = [p for e in doc.body for p in ([e] if e.tag == W + "p" else [p for row in doc.cells(e) for cell in row for p in cell])]
    for p in paragraphs:
        if level := doc.level(p):
            if title := doc.text(p).strip():
                path = [title] if level == 1 else [*path[:1], title]
            continue
        touched = set(open_)
        for e in p:
            key = e.get(W + "id")
            if e.tag == W + "commentRangeStart" and key in anchors:
                open_.append(key)
                touched.add(key)
                anchors[key].path = anchors[key].path or list(path)
            elif e.tag == W + "commentRangeEnd" and key in anchors:
                touched.add(key)
                if key in open_:
                    open_.remove(key)
            elif e.tag == W + "r" and (text := "".join(t.text or "" for t in e.iter(W + "t"))):
                vert = next((v.get(W + "val") for v in e.iter(W + "vertAlign")), None)
                fmt = (bool(_flag(e.find(W + "rPr"), "b")), bool(_flag(e.find(W + "rPr"), "i")), vert if vert in ("superscript", "subscript") else None)
                for k in dict.fromkeys(open_):
                    anchors[k].path = anchors[k].path or list(path)
                    anchors[k].text.append(text)
                    anchors[k].rich.append(wrap(text, fmt))
        for k in touched:
            for kept, text in ((anchors[k].context, doc.text(p).strip()), (anchors[k].context_rich, doc.rich(p))):
                if text and len(kept) < 6:
                    kept.append(text)
    return [
        {
            "id": k, "author": c.get(W + "author"), "date": c.get(W + "date"), "text": "".join(t.text or "" for t in c.iter(W + "t")).strip(),
            "anchor_heading_path": a.path, "anchor_text": "".join(a.text).strip(), "anchor_text_rich": "".join(a.rich).strip(),
            "anchor_context": " ".join(a.context).strip(), "anchor_context_rich": " ".join(a.context_rich).strip(),
        }
        for (k, c), a in zip(meta.items(), anchors.values(), strict=True)
    ]


def _parse_any(path: str, content: bytes) -> list[dict]:
    kind, name = path.lower().rpartition(".")[2], html.stem(path)
    if kind == "docx":
        return parse(content, name).rows(path)
    if kind in ("html", "htm"):
        return html.parse(content.decode("utf-8", "ignore"), name).rows(path)
    raise ValueError(f"unsupported file type: {kind}")


def blocks(files: DataFrame) -> DataFrame:
    """Block rows of (path, content); a file that fails becomes a row with its error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[dict] = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += _parse_any(path, bytes(content))
                except Exception as e:  # noqa: BLE001 - errors are data
                    rows.append({"doc_id": path, "doc_title": html.stem(path), "error": f"{type(e).__name__}: {e}"[:500]})
            yield html.frame(rows)

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def comment_rows(files: DataFrame) -> DataFrame:
    """Comment rows of (path, content); files without comments, or that are no DOCX, have none."""
    names = [c.split()[0] for c in COMMENTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[dict] = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [{"doc_id": path, **c} for c in comments(bytes(content))] if path.lower().endswith(".docx") else []
                except (zipfile.BadZipFile, ElementTree.ParseError, KeyError):
                    continue
            yield pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names)

    return files.select("path", "content").mapInPandas(run, COMMENTS)


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Block rows of all DOCX and HTML files under a folder."""
    return blocks(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower("path").rlike(r"\.(docx|html|htm)$")))


def batch_summary(parsed: DataFrame) -> DataFrame:
    """total, parsed, failed and the errors of a batch."""
    by = parsed.groupBy("doc_id").agg(F.max("error").alias("error"))
    failures = F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.struct(F.col("doc_id").alias("file"), "error"))))
    return by.agg(F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("parsed"), F.count_if(F.col("error").isNotNull()).alias("failed"), failures.alias("errors"))
