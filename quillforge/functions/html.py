"""An article page to Markdown, in Arrow batches, on the standard library's parser."""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

from ..batches import bound_active

# What of a page is left out, as (tag, class); an empty one fits all.
DROPPED = (
    ("script", ""), ("style", ""), ("img", ""), ("h1", "ltx_title_document"), ("", "ltx_authors"), ("", "ltx_note_frontmatter"),
    ("section", "ltx_bibliography"), ("", "ltx_page_navbar"), ("", "ltx_TOC"),
)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Tags whose end may be left out: one that is open last ends where a tag of its list begins.
_IMPLIED = {
    "p": frozenset("p div section article figure figcaption table ul ol dl blockquote pre header footer main nav aside h1 h2 h3 h4 h5 h6 hr".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]),
}
_BLOCKS = frozenset("p div section article figure figcaption table ul ol blockquote pre header footer main nav aside dl dt dd".split())


@dataclass
class Node:
    tag: str
    attrs: dict[str, str]
    children: list = field(default_factory=list)

    @property
    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def raw(self) -> str:
        """All text below, as it stands."""
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack += reversed(node.children)
        return "".join(out)


class _Tree(HTMLParser):
    """A page as nodes. Open tags are counted by name, so that stray ends cost nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("", {})
        self.open = [self.root]
        self.counts: Counter[str] = Counter()

    def handle_starttag(self, tag, attrs):
        while tag in _IMPLIED.get(self.open[-1].tag, ()):
            self.counts[self.open.pop().tag] -= 1
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)
            self.counts[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        if not self.counts[tag]:
            return
        while True:
            ended = self.open.pop().tag
            self.counts[ended] -= 1
            if ended == tag:
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _dropped(node: Node) -> bool:
    return any((not tag or node.tag == tag) and (not cls or cls in node.classes) for tag, cls in DROPPED)


def _source(math: Node) -> str:
    return math.attrs.get("alttext", "").strip()


def _inline(text: str) -> str:
    return re.sub(r"\s+", " ", text)


class Rope:
    """Pieces of text in order. Joining two moves the shorter one's pieces, so deep pages aren't copied level by level."""

    def __init__(self, *pieces: str):
        self.pieces = deque(p for p in pieces if p)

    def __str__(self) -> str:
        return "".join(self.pieces)

    def followed(self, other: Rope) -> Rope:
        if len(other.pieces) > len(self.pieces):
            other.pieces.extendleft(reversed(self.pieces))
            return other
        self.pieces.extend(other.pieces)
        return self

    def stripped(self) -> tuple[str, str]:
        """Take the white space off both ends; what was taken."""
        left, right = [], []
        while self.pieces:
            first = self.pieces.popleft()
            rest = first.lstrip()
            left.append(first[: len(first) - len(rest)])
            if rest:
                self.pieces.appendleft(rest)
                break
        while self.pieces:
            last = self.pieces.pop()
            rest = last.rstrip()
            right.append(last[len(rest) :])
            if rest:
                self.pieces.append(rest)
                break
        return "".join(left), "".join(reversed(right))

    def around(self, left: str, right: str) -> Rope:
        if left:
            self.pieces.appendleft(left)
        if right:
            self.pieces.append(right)
        return self


_MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "code": "`", "kbd": "`", "samp": "`"}


def _leaf(node: Node | str) -> Rope | None:
    """What is known without the children; None where they must be put together first."""
    if isinstance(node, str):
        return Rope(_inline(node))
    if _dropped(node):
        return Rope()
    if node.tag == "math":
        fence = "$$" if node.attrs.get("display") == "block" else "$"
        return Rope(f"{fence}{_source(node)}{fence}")
    if node.tag == "table" and {"ltx_equation", "ltx_equationgroup"} & set(node.classes):
        formulas = [_source(m) for m in node.walk() if m.tag == "math"]
        return Rope("\n\n" + " ".join(f"$${f}$$" for f in formulas if f) + "\n\n")
    if node.tag == "pre":
        return Rope("\n\n```\n" + node.raw().strip("\n") + "\n```\n\n")
    if node.tag == "br":
        return Rope("  \n")
    if node.tag == "hr":
        return Rope("\n\n---\n\n")
    return None


def _wrapped(node: Node, inner: Rope, rows: list[list[str]]) -> Rope:
    """A node's text from that of its children; ``rows`` are the finished rows of a table."""
    if node.tag == "table":
        return Rope("\n\n" + _table(rows) + "\n\n")
    if re.fullmatch("h[1-6]", node.tag):
        title = _inline(str(inner)).strip()
        return Rope(f"\n\n{'#' * int(node.tag[1])} {title}\n\n") if title else Rope()
    if node.tag in _MARKS:
        left, right = inner.stripped()
        mark = _MARKS[node.tag] if inner.pieces else ""
        return inner.around(left + mark, mark + right)
    if node.tag == "li":
        inner.stripped()
        return inner.around("\n* ", "")
    if node.tag == "blockquote":
        inner.stripped()
        return Rope("\n\n" + "\n".join(f"> {x}".rstrip() for x in str(inner).split("\n")) + "\n\n")
    if node.tag in _BLOCKS:
        inner.stripped()
        return inner.around("\n\n", "\n\n")
    return inner


@dataclass
class _Frame:
    node: Node
    left: Iterator
    inner: Rope = field(default_factory=Rope)
    rows: list[list[str]] = field(default_factory=list)  # of a table
    cells: list[str] = field(default_factory=list)  # of a row


def _plain(root: Node) -> str:
    """Markdown of all that is below a node, whatever its depth."""
    stack = [_Frame(root, iter(root.children))]
    while True:
        frame = stack[-1]
        child = next(frame.left, None)
        if child is not None:
            made = _leaf(child)
            if made is None:
                stack.append(_Frame(child, iter(child.children)))
            else:
                frame.inner = frame.inner.followed(made)
            continue
        stack.pop()
        if not stack:
            return str(frame.inner)
        node, parent = frame.node, stack[-1]
        if node.tag in ("td", "th") and parent.node.tag == "tr":
            parent.cells.append(_inline(str(frame.inner)).strip())
        elif node.tag == "tr" and (table := next((f for f in reversed(stack) if f.node.tag == "table"), None)) is not None:
            table.rows.append(frame.cells)
        else:
            parent.inner = parent.inner.followed(_wrapped(node, frame.inner, frame.rows))


def _table(rows: list[list[str]]) -> str:
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def to_markdown(html: str | None, title: str | None, article_class: str = "ltx_document") -> str | None:
    """``# title`` and the article's body; null where the page has no article of that class."""
    if html is None:
        return None
    article = next((n for n in tree(html).walk() if n.tag == "article" and (not article_class or article_class in n.classes)), None)
    if article is None:
        return None
    body = _plain(article)
    body = "\n".join(line.rstrip() for line in body.split("\n"))
    body = re.sub(r"\n{3,}", "\n\n", body)
    return f"# {(title or '').strip()}\n\n{body.strip()}\n"


def html_to_markdown(html: Column, title: Column, article_class: str = "ltx_document") -> Column:
    @pandas_udf("string")
    def run(pages: pd.Series, titles: pd.Series) -> pd.Series:
        return pd.Series([to_markdown(h, t, article_class) for h, t in zip(pages, titles, strict=True)], dtype=object)

    bound_active()
    return run(html, title)
