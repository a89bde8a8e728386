"""Operator 7: text of web pages by layout-aware rendering.

A tree builder reads a page's tags, adds the end tags that HTML implies (a block closes an open
paragraph, an item the item before it, a cell the cell before it ...) and drops what is not
shown.  The renderer then emits all visible text: paragraphs and headings apart by a blank line, other
blocks on lines of their own, list items behind a mark and indented, table cells padded to
columns, preformatted text as it stands.

Both walk with their own stacks, so depth is bounded by memory alone; each page is one row, so
nothing is gathered across rows.

Not shown: head, title, script, style, template, noscript and embedded media; elements with ``hidden``, or with an
inline style ``display:none`` or ``visibility:hidden``; hidden inputs; closed details but for their
summary; closed dialogs.  Defined cases: NULL or empty pages give an empty text; unclosed tags
end with the page; an unmatched ``<`` is text; unmatched end tags are ignored; unknown tags are inline.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of the HTML standard by their role in layout.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset(("audio canvas datalist embed head iframe math meta link noembed noframes noscript object rp script select style svg "
                    "template title video").split())
APART = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 ol p pre table ul".split())
BLOCK = APART | frozenset(("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup "
                           "hr html legend li main menu nav option optgroup search section summary tbody td tfoot th thead tr").split())
CLOSES_P = frozenset(("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
                      "h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul").split())
LISTS = frozenset("ol ul menu dir".split())
#: A start tag ends the nearest of these, unless one of the scope lies between.
IMPLIED = {
    "li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "optgroup"}), "optgroup": ({"optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "body": ({"head"}, set()),
}
P_SCOPE = frozenset("table td th caption button object".split())

_TAG = re.compile(r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*+>|(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>))", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children = tag, attrs, []


def attributes(text: str) -> dict[str, str]:
    if not text.strip("/> \t\r\n"):
        return {}
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(text.rstrip(">")):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def visible(node: Node) -> bool:
    if node.tag in UNSEEN:
        return False
    a = node.attrs
    if not a:
        return node.tag != "dialog"
    if "hidden" in a and a["hidden"].lower() != "until-found" or _HIDING.search(a.get("style", "")):
        return False
    return not (node.tag == "dialog" and "open" not in a)


def build(page: str) -> Node:
    """The tree of a page."""
    root = Node("#root", {})
    stack = [root]
    opened: Counter = Counter()  # open elements by tag: most searches end here, however deep the page is

    def end(upto: int) -> None:
        for node in stack[upto:]:
            opened[node.tag] -= 1
        del stack[upto:]

    def nearest(names, scope=frozenset()) -> int:
        if not any(opened[n] for n in names):
            return 0
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                return i
            if stack[i].tag in scope:
                return 0
        return 0

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            stack[-1].children.append(unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(unescape(page[at:m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag not in ("body", "html") and (i := nearest({tag}, frozenset() if tag == "table" else {"table"} if tag not in IMPLIED and tag not in ("td", "th") else frozenset())):
                end(i)
            continue
        if tag in CLOSES_P and (i := nearest({"p"}, P_SCOPE)):
            end(i)
        if tag in IMPLIED and (i := nearest(*IMPLIED[tag])):
            end(i)
        if stack[-1].tag == "head" and tag not in UNSEEN and tag not in ("base", "html"):
            end(len(stack) - 1)
        if tag in ("html", "body") and nearest({tag}):
            continue
        node = Node(tag, attributes(m[3]))
        stack[-1].children.append(node)
        if tag in VOID or m[3].endswith("/>") and tag in ("svg", "path", "math"):
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            node.children.append(unescape(page[at:close.start()]) if tag in ("textarea", "title") else page[at:close.start()])
            at = close.end()
        else:
            stack.append(node)
            opened[tag] += 1
    return root


class _Page:
    """Lines made so far; ``gap`` blank lines are due before the next text (None before any)."""

    def __init__(self):
        self.lines: list[str] = []
        self.text: list[str] = []  # of the line at hand
        self.space = False
        self.gap: int | None = None
        self.indent: list[str] = []
        self.mark = ""

    def add(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self.text.append(first)
            for line in rest:
                self.flush(True)
                self.text.append(line)
            return
        words = _SPACE.sub(" ", text)
        if words.startswith(" "):
            self.space = True
            words = words[1:]
        if not words:
            return
        if self.space and self.text:
            self.text.append(" ")
        self.space = words.endswith(" ")
        self.text.append(words[:-1] if self.space else words)

    def flush(self, keep_blank: bool = False) -> None:
        """Ends the line at hand."""
        line, self.text, self.space = "".join(self.text), [], False
        if not line and not keep_blank:
            return
        if self.gap and self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        lead = "".join(self.indent)
        if self.mark:
            lead, self.mark = lead[:len(lead) - len(self.mark)] + self.mark, ""
        self.lines.append((lead + line).rstrip())

    def block(self, blank: int) -> None:
        self.flush()
        self.gap = max(self.gap or 0, blank)


def render(root: Node, tables: int = 0) -> str:
    """The visible text below a node."""
    page = _Page()
    stack: list[tuple[Node, Iterator, bool]] = [(root, iter(root.children), False)]
    lists: list[list] = []  # kind and last number of the open lists
    pre = 0
    while stack:
        node, rest, opened = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            tag = node.tag
            if opened:
                if tag in LISTS:
                    page.flush()
                    lists.pop()
                page.block(_blank(tag, lists))
                if tag == "li" or tag == "dd" or tag == "blockquote":
                    page.indent.pop()
                    page.mark = ""
                elif tag == "pre":
                    pre -= 1
            continue
        if isinstance(child, str):
            page.add(child, pre > 0)
            continue
        tag = child.tag
        if tag == "br":
            page.flush(True)
            continue
        if not visible(child) or tag == "input" and child.attrs.get("type", "").lower() == "hidden":
            continue
        if tag == "input":
            page.add(f" {child.attrs.get('value', '')} ", False)
            continue
        if tag in VOID and tag != "hr":
            continue
        if tag == "table" and tables < 20:
            page.block(1)
            for line in table_lines(child, tables + 1):
                page.text.append(line)
                page.flush(True)
            page.block(1)
            continue
        inner = child.children
        if tag == "details" and "open" not in child.attrs:
            inner = [x for x in inner if isinstance(x, Node) and x.tag == "summary"]
        opened = tag in BLOCK
        if opened:
            page.block(_blank(tag, lists))
            if tag in LISTS:
                lists.append([tag, _number(child.attrs.get("start"), 1) - 1])
            elif tag == "li":
                page.mark = "- "
                if lists and lists[-1][0] == "ol":
                    lists[-1][1] = _number(child.attrs.get("value"), lists[-1][1] + 1)
                    page.mark = f"{lists[-1][1]}. "
                page.indent.append(" " * len(page.mark))
            elif tag == "dd":
                page.indent.append("    ")
            elif tag == "blockquote":
                page.indent.append("  ")
            elif tag == "pre":
                pre += 1
                if inner and isinstance(inner[0], str) and inner[0].startswith("\n"):
                    inner = [inner[0][1:], *inner[1:]]
        stack.append((child, iter(inner), opened))
    page.flush()
    return "\n".join(page.lines).strip("\n")


def _blank(tag: str, lists: list) -> int:
    """Blank lines around a block; inside lists there are none."""
    return 1 if tag in APART and not lists else 0


def _number(text: str | None, default: int) -> int:
    return int(text) if text and re.fullmatch(r"-?\d{1,9}", text.strip()) else default


def table_lines(table: Node, depth: int) -> Iterator[str]:
    """A table's rows with cells padded to their columns; captions come first.  Text outside of cells precedes the rows, as browsers show it."""
    rows: list[list[str]] = []
    loose: list[str] = []
    todo = list(reversed(table.children))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                loose.append(_SPACE.sub(" ", x.strip()))
        elif not visible(x):
            continue
        elif x.tag in ("td", "th"):
            if not rows:
                rows.append([])
            text = _SPACE.sub(" ", render(x, depth)).strip()
            rows[-1] += [text, *[""] * (min(max(_number(x.attrs.get("colspan"), 1), 1), 1000) - 1)]
        elif x.tag == "tr":
            rows.append([])
            todo += reversed(x.children)
        elif x.tag in ("thead", "tbody", "tfoot", "colgroup"):
            todo += reversed(x.children)
        elif text := _SPACE.sub(" ", render(_alone(x), depth)).strip():
            loose.append(text)
    yield from loose
    widths: list[int] = []
    for row in rows:
        for i, cell in enumerate(row):
            if i == len(widths):
                widths.append(0)
            widths[i] = max(widths[i], len(cell))
    for row in rows:
        if any(row):
            yield "  ".join(cell.ljust(w) for cell, w in zip(row, widths)).rstrip()


def _alone(node: Node) -> Node:
    root = Node("#root", {})
    root.children.append(node)
    return root


def page_text(page: str | None) -> str:
    return render(build(page)) if page else ""


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """``keep`` and ``text``, the visible text of each page."""

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            text = pa.array([page_text(x) for x in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], names=[*b.schema.names[:-1], "text"])

    kept = pages.select(*[F.col(f"`{c}`") for c in keep])
    return pages.select(*kept.columns, F.col(f"`{html}`").cast("string").alias("text")).mapInArrow(rows, kept.withColumn("text", F.lit("")).schema)
