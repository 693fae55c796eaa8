"""HTML documents to block rows, with the standard library's parser.

Headings h1 and h2, paragraphs, lists and tables count, in document order; a
paragraph inside a cell or list item is found on its own as well. No rich text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources.nodes import Tree
from quillspark.sources.schemas import BLOCK_NAMES, BLOCKS

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
WANTED = ("h1", "h2", "p", "ul", "ol", "table")


@dataclass
class Element:
    name: str
    attrs: dict[str, str]
    parts: list[Element | str] = field(default_factory=list)

    def strings(self) -> Iterator[str]:
        stack = [iter(self.parts)]
        while stack:
            x = next(stack[-1], None)
            if x is None:
                stack.pop()
            elif isinstance(x, str):
                if x.strip():
                    yield x.strip()
            else:
                stack.append(iter(x.parts))

    def text(self) -> str:
        return " ".join(" ".join(self.strings()).split())

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            e = stack.pop()
            if e is not self:
                yield e
            stack += [x for x in reversed(e.parts) if not isinstance(x, str)]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.open[-1].parts.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1].name not in ("script", "style"):
            self.open[-1].parts.append(data)


def _styles(e: Element) -> dict[str, list[str]]:
    """Bold and italic snippets inside an element: by tag, by the data label class, by inline style."""
    out: dict[str, list[str]] = {"bold": [], "italic": []}
    for x in e.walk():
        style = x.attrs.get("style", "").lower()
        if x.name in ("b", "strong") or "dataLabel" in x.attrs.get("class", "").split() or re.search(r"font-weight\s*:\s*(bold|[789]00)", style):
            out["bold"].append(x.text())
        if x.name in ("i", "em") or re.search(r"font-style\s*:\s*italic", style):
            out["italic"].append(x.text())
    return out


def parse(html: str, title: str) -> Tree:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    tree = Tree(title, merge=False)
    for e in builder.root.walk():
        if e.name not in WANTED:
            continue
        if e.name in ("h1", "h2"):
            tree.heading(e.text(), int(e.name[1]))
        elif e.name == "p":
            if text := e.text():
                tree.at.note(_styles(e))
                tree.add(type="paragraph", text=text)
        elif e.name == "table":
            tree.at.note(_styles(e))
            rows = [[c.text() for c in tr.walk() if c.name in ("th", "td")] for tr in e.walk() if tr.name == "tr"]
            if rows := [r for r in rows if r]:
                tree.add(type="table", rows=rows)
        else:
            items = [x for x in e.parts if not isinstance(x, str) and x.name == "li"]
            for x in items:
                tree.at.note(_styles(x))
            texts = [{"text": t, "text_rich": None, "style": f"HTML:{e.name}/li"} for x in items if (t := x.text())]
            if texts:
                tree.add(type="list", signature=f"HTML:{e.name}", items=texts)
    return tree


def frame(rows: list[dict]) -> pd.DataFrame:
    """Of BLOCKS; what a block lacks stays null (pandas would make a missing number a float)."""
    cols = {n: pd.Series([r.get(n) for r in rows], dtype=object) for n in BLOCK_NAMES}
    return pd.DataFrame(cols | {n: cols[n].astype("Int32") for n in ("node", "block_pos")})


def blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", title: Column | None = None) -> DataFrame:
    """Block rows of every page; one that fails becomes a row with its error, the others go on."""
    title = F.col(id_col).cast("string") if title is None else title

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[dict] = []
            for key, name, html in zip(b["doc_id"], b["title"], b["html"], strict=True):
                try:
                    rows += parse(html or "", name or "").rows(key)
                except Exception as e:  # noqa: BLE001 - errors are data
                    rows.append({"doc_id": key, "doc_title": name, "error": f"{type(e).__name__}: {e}"[:500]})
            yield frame(rows)

    return pages.select(F.col(id_col).cast("string").alias("doc_id"), title.alias("title"), F.col(html_col).alias("html")).mapInPandas(run, BLOCKS)


def stem(path: str) -> str:
    return PurePosixPath(path).stem
