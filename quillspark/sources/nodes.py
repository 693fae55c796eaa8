"""The heading tree that both document parsers fill."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass
class Node:
    h1: str | None
    h2: str | None
    blocks: list[dict[str, Any]] = field(default_factory=list)
    children: list[Node] = field(default_factory=list)
    style: dict[str, list[str]] = field(default_factory=lambda: {"bold": [], "italic": []})

    def note(self, found: dict[str, list[str]]) -> None:
        for kind, snippets in found.items():
            self.style[kind] += [s for s in dict.fromkeys(x.strip() for x in snippets) if s and s not in self.style[kind]]


class Tree:
    """merge: a heading whose title its parent already has goes on with that node."""

    def __init__(self, title: str, merge: bool):
        self.title, self.merge = title, merge
        self.root = self.at = Node(None, None)
        self.h1: Node | None = None

    def heading(self, title: str, level: int) -> None:
        title = title.strip()
        if not title:
            return
        parent = self.root if level == 1 or self.h1 is None else self.h1
        key = (title, None) if level == 1 else (self.h1.h1 if self.h1 else None, title)
        same = [n for n in parent.children if (n.h1, n.h2) == key] if self.merge else []
        node = same[0] if same else Node(*key)
        if not same:
            parent.children.append(node)
        if level == 1:
            self.h1 = node
        self.at = node

    def add(self, **block: Any) -> None:
        self.at.blocks.append(block)

    def rows(self, doc_id: str) -> list[dict[str, Any]]:
        out: list[dict[str, Any]] = []
        stack, k = [self.root], 0
        while stack:
            node = stack.pop()
            blocks = node.blocks + ([{"type": "style", "style": node.style}] if any(node.style.values()) else [])
            out += [{"doc_id": doc_id, "doc_title": self.title, "h1": node.h1, "h2": node.h2, "node": k, "block_pos": i, **b} for i, b in enumerate(blocks)]
            stack += reversed(node.children)
            k += 1
        return out
