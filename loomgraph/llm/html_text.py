"""Operator 5: visible text of HTML pages by layout-aware rendering."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.common import small_batches, table

# Element categories of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head title script style template noscript iframe noembed noframes audio video canvas datalist input area rp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table "
    "tbody td tfoot th thead tr ul xmp caption".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol menu dl table figure fieldset".split())
#: Start tags that end an open element: (what ends, what stops the search).
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th", "caption", "colgroup"), ("table",)),
    "td": (("td", "th", "caption"), ("tr", "table")),
    "th": (("td", "th", "caption"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"), ("table",)),
    "rt": (("rt", "rp"), ("ruby",)),
    "rp": (("rt", "rp"), ("ruby",)),
}
#: Start tags that end an open paragraph.
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre search section summary table ul xmp li dt dd".split()
)
#: Elements that an end tag from inside doesn't reach beyond.
SCOPE = frozenset("html table td th caption template object".split())

_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|(?<!=)[\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>?", re.S
)
_OPENING = re.compile(r"<[A-Za-z/!?]")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\s*(?:!important\s*)?(?:;|$)", re.I)
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|hidden|collapse)\s*(?:!important\s*)?(?=;|$)", re.I)
#: Levels of indentation shown, and the widest column that others are aligned beside.
_LEVELS, _WIDEST = 40, 120
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def parse(source: str) -> Node:
    """The element tree with implied tags: unclosed paragraphs, list items, rows and cells end where
    the standard ends them, rows and cells outside of their parents get them, stray end tags are dropped."""
    root = Node("html", {})
    stack = [root]
    opened: dict[str, int] = {"html": 1}
    at, n = 0, len(source)

    def push(tag: str, attributes: dict[str, str]) -> None:
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1

    def pop_to(depth: int) -> None:
        while len(stack) > depth:
            opened[stack.pop().tag] -= 1

    def find(tags: tuple[str, ...], stops) -> int:
        """Depth of the outermost of tags above the nearest stop, or 0; outside of tables the nearest."""
        found = 0
        if any(opened.get(t) for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    found = k
                    if "table" not in stops:
                        break
                elif stack[k].tag in stops:
                    break
        return found

    def text(value: str) -> None:
        if value:
            if stack[-1].tag == "head" and value.strip(" \t\n\r\f"):
                pop_to(len(stack) - 1)  # text implies the body
            stack[-1].children.append(html.unescape(value) if "&" in value else value)

    while at < n:
        begin = _OPENING.search(source, at)
        if not begin:
            text(source[at:])
            break
        text(source[at : begin.start()])
        m = _TAG.match(source, begin.start())
        if not m:
            break  # a tag that never ends shows nothing
        at, tag = m.end(), (m.group(2) or "").lower()
        if not tag:
            continue
        if m.group(1):
            if tag == "p" and not find(("p",), SCOPE):
                stack[-1].children.append(Node("p", {}))
                continue
            if tag == "br":
                push("br", {})
            elif re.fullmatch("h[1-6]", tag):
                if depth := find(("h1", "h2", "h3", "h4", "h5", "h6"), SCOPE):
                    pop_to(depth)
            elif opened.get(tag) and tag not in ("html", "body"):
                stops = SCOPE - {tag} if tag not in ("table", "tr", "tbody", "thead", "tfoot") else frozenset(["table"]) - {tag}
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        pop_to(k)
                        break
                    if stack[k].tag in stops or (tag not in BLOCK and stack[k].tag in BLOCK):
                        break
            continue
        attributes = {}
        for a in _ATTRIBUTE.finditer(m.group(3)):
            attributes.setdefault(a.group(1).lower(), html.unescape(a.group(2) or a.group(3) or a.group(4) or ""))
        if tag in ("html", "body", "head") and opened.get(tag):
            continue
        if opened.get("head") and tag not in ("title", "meta", "link", "base", "style", "script", "noscript", "template", "head"):
            if depth := find(("head",), ("template",)):
                pop_to(depth)
        if tag in CLOSES and (depth := find(*CLOSES[tag])):
            pop_to(depth)
        if tag in CLOSES_P and (depth := find(("p",), SCOPE)):
            pop_to(depth)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            push("tr", {})
        push(tag, attributes)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I).search(source, at)
            body = source[at : end.start() if end else n]
            if tag in ("title", "textarea"):
                text(body)
            elif tag == "xmp" and body:
                stack[-1].children.append(body)
            at = end.end() if end else n
            pop_to(len(stack) - 1)
    return root


def shown(node: Node) -> bool:
    """Whether an element is rendered at all."""
    a = node.attributes
    if node.tag in HIDDEN or "hidden" in a or (node.tag == "dialog" and "open" not in a):
        return False
    return not (a.get("style") and _NOT_SHOWN.search(a["style"]))


def visible(node: Node, inherited: bool) -> bool:
    """Whether an element's own text can be seen: the last visibility of its style, else that of its parent."""
    style = node.attributes.get("style")
    found = _VISIBILITY.findall(style) if style else []
    return found[-1].lower() == "visible" if found else inherited


def _shows_again(node: Node) -> bool:
    """Whether something inside a hidden element is visible."""
    todo = list(node.children)
    while todo:
        one = todo.pop()
        if isinstance(one, Node):
            if visible(one, False):
                return True
            todo += one.children
    return False


class _Flow:
    """Lines of one block context: the page, or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.blank = False  # a blank line is due before the next text
        self.indent: list[str] = []
        self.marker = ""
        self.space = False

    def text(self, value: str, kept: bool) -> None:
        if kept:
            rows = value.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            for k, row in enumerate(rows):
                if k:
                    self.line(True)
                if row:
                    self.parts.append(row)
            return
        words = _SPACES.sub(" ", value)
        if self.parts and not self.space and words[:1] == " ":
            self.space = True
        core = words.strip(" ")
        if core:
            self.parts.append(" " + core if self.space and self.parts else core)
            self.space = words[-1] == " "

    def line(self, forced: bool = False) -> None:
        """End the line; a forced end makes an empty line where there is no text."""
        content = "".join(self.parts).rstrip()
        if content or forced:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            lead = "".join(self.indent[-_LEVELS:])
            if self.marker:
                lead = lead[: len(lead) - len(self.marker)] + self.marker
                self.marker = ""
            self.lines.append((lead + content).rstrip())
        self.parts, self.space = [], False

    def block(self, lines: list[str]) -> None:
        self.line()
        for row in lines:
            self.parts = [row]
            self.line(True)

    def gap(self) -> None:
        self.line()
        self.blank = True

    def done(self) -> list[str]:
        self.line()
        return self.lines


def _aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells (lines, columns, rows spanned) as text columns of equal width, two blanks apart."""
    grid: list[dict[int, list[str]]] = []
    taken: dict[tuple[int, int], bool] = {}
    widths: dict[int, int] = {}
    for r, row in enumerate(rows):
        at, line = 0, {}
        for lines, columns, down in row:
            while (r, at) in taken:
                at += 1
            line[at] = lines
            for c in range(at, at + columns):
                for d in range(1, min(down, len(rows) - r)):
                    taken[r + d, c] = True
            if columns == 1:
                widths[at] = min(_WIDEST, max([widths.get(at, 0), *map(len, lines)]))
            at += columns
        grid.append(line)
    out = []
    for line in grid:
        if not line:
            continue
        last = max(line)
        for k in range(max([1, *map(len, line.values())])):
            text = ""
            start = 0
            for c in range(last + 1):
                if c in line:
                    cell = line[c][k] if k < len(line[c]) else ""
                    text = text.ljust(start) + cell if len(text) <= start else text + "  " + cell
                start += widths.get(c, 0) + 2
            out.append(text.rstrip())
    return [x for x in out if x]


def _span(node: Node, name: str) -> int:
    value = node.attributes.get(name, "1")
    return min(max(int(value), 1), 1000) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def render(root: Node) -> str:
    """Text of all shown nodes, walked without recursion."""
    flow = _Flow()
    flows, tables = [], []  # enclosing flows; rows of the open tables
    counters: list[int | None] = []
    kept = 0
    seen = [True]  # of the open elements, whether their text is visible
    todo: list = [root]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            if not seen[-1]:
                continue
            if tables and tables[-1][1] is flow:
                if node.strip():  # text of a table outside of its cells comes before it
                    tables[-1][2].text(node, False)
                continue
            flow.text(node, kept > 0)
            continue
        if isinstance(node, Node):
            tag = node.tag
            if tag == "br":
                flow.line(True)
                continue
            if not shown(node) or tag in VOID:
                if tag == "hr" and shown(node):
                    flow.gap()
                continue
            now = visible(node, seen[-1])
            if seen[-1] and not now and not _shows_again(node):
                continue
            seen.append(now)
            todo.append((node, tag))
            todo.extend(reversed(node.children))
            if tag == "table":
                flow.gap()
                inner = _Flow()
                tables.append(([], inner, flow))
                flows.append(flow)
                flow = inner
            elif tag == "tr" and tables and tables[-1][1] is flow:
                tables[-1][0].append([])
            elif tag in ("td", "th") and tables and tables[-1][1] is flow:
                if not tables[-1][0]:
                    tables[-1][0].append([])
                flows.append(flow)
                flow = _Flow()
            elif tag == "caption" and tables and tables[-1][1] is flow:
                flows.append(flow)
                flow = tables[-1][2]
                flow.line()
            elif tag in BLOCK:
                flow.gap() if tag in SPACED and not (tag in ("ul", "ol", "menu") and counters) else flow.line()
                if tag in ("ul", "menu", "dir"):
                    counters.append(None)
                elif tag == "ol":
                    start = node.attributes.get("start", "1")
                    counters.append(int(start) if re.fullmatch(r"-?[0-9]{1,9}", start, re.A) else 1)
                elif tag == "li":
                    mark = "- "
                    if counters and counters[-1] is not None:
                        value = node.attributes.get("value", "")
                        if re.fullmatch(r"-?[0-9]{1,9}", value, re.A):
                            counters[-1] = int(value)
                        mark = f"{counters[-1]}. "
                        counters[-1] += 1
                    flow.indent.append(" " * len(mark))
                    flow.marker = mark
                elif tag in ("blockquote", "dd"):
                    flow.indent.append("  ")
                elif tag in ("pre", "xmp"):
                    kept += 1
            elif tag == "q":
                flow.text('"', True)
            continue
        node, tag = node
        seen.pop()
        if tag == "table":
            rows, _, outer = tables.pop()
            flow = flows.pop()
            outer.block(_aligned(rows))
            outer.gap()
        elif tag in ("td", "th") and tables and flows and flows[-1] is tables[-1][1]:
            cell = flow.done()
            flow = flows.pop()
            tables[-1][0][-1].append((cell, _span(node, "colspan"), _span(node, "rowspan")))
        elif tag == "caption" and tables and flows and flows[-1] is tables[-1][1]:
            flow.line()
            flow = flows.pop()
        elif tag == "tr" and tables and tables[-1][1] is flow:
            pass
        elif tag in BLOCK:
            if tag in ("pre", "xmp"):
                kept -= 1
                flow.parts = flow.parts if "".join(flow.parts).strip() else []
            flow.gap() if tag in SPACED and not (tag in ("ul", "ol", "menu") and len(counters) > 1) else flow.line()
            if tag in ("ul", "menu", "dir", "ol"):
                counters.pop()
            elif tag == "li":
                flow.indent.pop()
                flow.marker = ""
            elif tag in ("blockquote", "dd"):
                flow.indent.pop()
        elif tag == "q":
            flow.text('"', True)
    lines = flow.done()
    return "\n".join(lines).strip("\n")


def extract(source: str | None) -> str:
    """The visible text of one page."""
    return render(parse(source.replace("\0", "�"))) if source else ""


def extract_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """Replace html_col by text_col: the visible text of each page.

    A tree with implied tags is built and rendered: hidden elements, comments and scripts show nothing; blocks
    stand on lines of their own, paragraphs and headings apart; lists have markers and indents; cells of
    a table are padded to columns; preformatted text keeps its spaces. No text is ever cut, but beyond 40 levels
    the innermost 40 indents are shown, and cells wider than 120 characters no longer move the columns beside them.

    Defined cases: null and empty pages give the empty text; pages of any length and nesting are
    rendered whole, without recursion; plain text is a page; repeated rows render alike; an empty
    table gives an empty result; all other columns stay, and text_col must not name one of them.
    """
    if text_col != html_col and text_col in pages.columns:
        raise ValueError(f"{text_col} is a column already")
    schema = T.StructType([f for f in pages.schema.fields if f.name != html_col] + [T.StructField(text_col, T.StringType())])
    at = pages.columns.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                texts = pa.array([extract(x) for x in part.column(at).to_pylist()], pa.large_string())
                yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(part.columns) if i != at), texts], schema.names)

    return small_batches(pages).mapInArrow(run, schema)


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    found = extract_text(table(spark, sf_dir, "pages").select("page_id", "html"))
    return found.select("page_id", "text", F.length("text").cast("long").alias("n_chars"))
