"""HTML extraction: a tree builder with implied tags, then a layout-aware rendering of all visible text.

The builder keeps the positions of the open elements by name, so a tag costs
what it closes, however many elements are open.  Cells of a table stand in
columns, those that span rows or columns as well; inner tables and lists of a
cell are one line with " / " between their lines.  The values of form controls
(input, select, textarea) aren't text of the page and aren't shown.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.llm.common import arrow_map, table

# Fixed values of HTML: elements without content, with raw text, those that start a block, and those never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul".split())
HIDDEN = frozenset("area audio base canvas datalist embed head iframe input link meta noembed noframes noscript object param script select source style "
                   "svg template textarea title track video".split())
#: Blocks with an empty line before and after.
SPACED = frozenset("article blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre section table ul".split())
#: A start tag of the key closes an open element of the values, unless one of the stops lies between.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"),
          "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th", "thead", "tbody", "tfoot"),
          "tbody": ("tr", "td", "th", "thead", "tbody", "tfoot"), "tfoot": ("tr", "td", "th", "thead", "tbody", "tfoot"), "body": ("head",)}
#: A start tag of another element ends an open head (its end tag may be omitted).
HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())
#: Elements of other vocabularies, in which "/>" ends an element, and those whose content is HTML again.
FOREIGN = frozenset(("math", "svg"))
HTML_INSIDE = frozenset("annotation-xml desc foreignobject mi mn mo ms mtext title".split())
STOPS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "option": ("select",), "optgroup": ("select",)}
#: A start tag of these closes an open paragraph.
ENDS_P = BLOCK - {"body", "html", "caption", "dd", "dt", "li", "legend"} | {"dd", "dt", "li"}

# A quoted value starts after "=" only; quotes elsewhere in a tag are plain characters.
_TOKEN = re.compile(r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)"""
                    r"""((?:[\s/]+|[^\s/>][^\s/>=]*(?:\s*=\s*(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s>"'][^\s>]*)?)?+)*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"?|'[^']*'?|[^\s>"'][^\s>]*)?)?""")
_NO_SHOW = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
_SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "foreign", "name")

    def __init__(self, name: str, attrs: dict | None = None, foreign: bool = False):
        self.name, self.attrs, self.foreign, self.children = name, attrs or {}, foreign, []


def _attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(raw) if raw and not raw.isspace() else ():
        value = value[1:].removesuffix(value[0]) if value[:1] in ("'", '"') else value
        out.setdefault(name.lower(), html.unescape(value))
    return out


def _self_closed(raw: str) -> bool:
    """Ends with a slash that isn't the end of an attribute's value."""
    return raw.endswith("/") and all(m.end() < len(raw) for m in _ATTR.finditer(raw))


class _Open:
    """The open elements, and the positions of those of each name."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.name, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, n: int) -> None:
        """Closes all but the outer ``n`` elements."""
        while len(self.stack) > n:
            self.at[self.stack.pop().name].pop()

    def last(self, names) -> int:
        """Position of the innermost open element of these names, or 0."""
        return max((at[-1] for name in names if (at := self.at.get(name))), default=0)

    def close(self, names, stops) -> None:
        """Closes up to and with the outermost of ``names`` inside the nearest stop; of a single name the innermost."""
        stop = self.last(stops)
        if len(names) == 1:
            found = [self.last(names)]
        else:
            found = [at[k] for name in names if (at := self.at.get(name)) and (k := bisect_right(at, stop)) < len(at)]
        if found and min(found) > stop:
            self.cut(min(found))


def parse(source: str) -> Node:
    """A tree for any input: omitted end tags are implied, stray end tags ignored, open elements closed at the end."""
    root = Node("html")
    opened, at = _Open(root), 0
    stack = opened.stack

    def text(s: str) -> None:
        if s:
            s = html.unescape(s) if "&" in s else s
            if stack[-1].name == "head" and s.strip(" \t\n\r\f"):
                opened.cut(len(stack) - 1)
            stack[-1].children.append(s)

    while True:
        m = _TOKEN.search(source, at)
        text(source[at:m.start()] if m else source[at:])
        if not m:
            return root
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "p" and not opened.at.get("p"):
                stack[-1].children.append(Node("p"))
            barrier = {"td", "th", "table", "caption"} - {name} if name not in ("table", "tr", "thead", "tbody", "tfoot", "body", "html") else {"table"} - {name}
            if opened.last((name,)) > opened.last(barrier):
                opened.cut(opened.last((name,)))
            continue
        if name == "html":
            root.attrs = _attrs(m[3]) | root.attrs
            continue
        if stack[-1].name == "head" and name not in HEAD:
            opened.cut(len(stack) - 1)
        if name in CLOSES:
            opened.close(CLOSES[name], STOPS.get(name, ("table",)))
        if name in ENDS_P:
            opened.close(("p",), ("table", "td", "th", "caption", "button"))
        if name in ("td", "th") and stack[-1].name in ("table", "thead", "tbody", "tfoot"):
            stack[-1].children.append(row := Node("tr"))
            opened.push(row)
        node = Node(name, _attrs(m[3]), name in FOREIGN or (stack[-1].foreign and stack[-1].name not in HTML_INSIDE))
        stack[-1].children.append(node)
        if node.foreign and _self_closed(m[3]):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(source, at)
            body, at = source[at:end.start() if end else len(source)], end.end() if end else len(source)
            if name in ("textarea", "title"):
                body = html.unescape(body)
            node.children.append(body)
        elif name not in VOID:
            opened.push(node)


def visible(node: Node) -> bool:
    """Not hidden by its element, by the attribute or by an inline style; a closed dialog isn't shown."""
    if node.name in HIDDEN or "hidden" in node.attrs or (node.name == "dialog" and "open" not in node.attrs):
        return False
    return not ("style" in node.attrs and _NO_SHOW.search(node.attrs["style"]))


class _Page:
    """Lines of text with collapsed spaces and at most one empty line between blocks."""

    def __init__(self):
        self.lines, self.line, self.gap, self.space = [], [], 0, False

    def inline(self, s: str) -> None:
        if not s:
            return
        body = _SPACES.sub(" ", s)
        if body[0] == " ":
            self.space, body = True, body[1:]
        if not body:
            return
        if self.space and self.line:
            self.line.append(" ")
        self.space = body[-1] == " "
        self.line.append(body.rstrip(" "))

    def end_line(self) -> None:
        if self.line:
            if self.lines and self.gap:
                self.lines.append("")
            self.lines.append("".join(self.line))
            self.gap = 0
        self.line, self.space = [], False

    def raw(self, lines: list[str]) -> None:
        self.end_line()
        if self.lines and self.gap and lines:
            self.lines.append("")
        self.lines += lines
        self.gap = 0

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, int(spaced))

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


def _plain(node: Node) -> str:
    """Text of a node as it stands, for preformatted blocks."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.name == "br":
            out.append("\n")
        elif x is node or visible(x):
            todo += reversed(x.children)
    return "".join(out)


def _cells(row: Node) -> tuple[list[Node], Node]:
    """The cells of a row at any depth, but not those of inner tables, and a copy of all else that is visible in it."""
    cells, rest = [], Node("caption")
    todo = [(x, rest) for x in reversed(row.children)]
    while todo:
        x, into = todo.pop()
        if isinstance(x, str) or (x.name == "table" and visible(x)):
            into.children.append(x)
        elif visible(x):
            if x.name in ("td", "th"):
                cells.append(x)
            else:
                into.children.append(copy := Node(x.name, x.attrs))
                todo += [(c, copy) for c in reversed(x.children)]
    return cells, rest


def _rows(node: Node) -> list[Node | list]:
    """The rows (lists of cells) and captions of a table in order; not those of inner tables. What lies between a row's cells comes before it."""
    out = []
    for x in node.children:
        if isinstance(x, Node) and visible(x):
            if x.name == "tr":
                cells, rest = _cells(x)
                if any(isinstance(c, Node) or c.strip() for c in rest.children):
                    out.append(rest)
                out.append(cells)
            elif x.name in ("thead", "tbody", "tfoot"):
                out += _rows(x)
            elif x.name not in ("colgroup", "col"):
                out.append(x)
        elif isinstance(x, str) and x.strip():
            out.append(Node("caption"))
            out[-1].children.append(x)
    return out


#: Columns of a table are padded up to this width; wider cells only end with the separator.
COLUMN_WIDTH = 40


#: Largest spans of a cell in columns and rows (fixed values of HTML).
SPANS = {"colspan": 1000, "rowspan": 65534}


def _span(cell: Node, name: str) -> int:
    value = cell.attrs.get(name, "1").strip()
    n = int(value) if value.isdecimal() and value.isascii() and len(value) < 10 else 1
    return min(n, SPANS[name]) if n else (SPANS[name] if name == "rowspan" else 1)  # rowspan 0: to the table's end


def _table(node: Node, depth: int) -> list[str]:
    """Lines of a table; a cell stands in the first column that no cell above reaches down to."""
    grid: list[dict[int, str] | list[str]] = []
    taken: dict[int, int] = {}  # columns that cells above take up, and for how many rows more
    for row in _rows(node):
        if isinstance(row, Node):
            grid.append(render_lines(row, depth + 1))
            continue
        cells, below, column = {}, {}, 0
        for cell in row:
            while column in taken:
                column += 1
            cells[column] = " / ".join(x.strip() for x in render_lines(cell, depth + 1) if x.strip())
            wide, high = _span(cell, "colspan"), _span(cell, "rowspan")
            if high > 1:
                below.update((c, high) for c in range(column, column + wide))
            column += wide
        taken = {c: n - 1 for c, n in [*taken.items(), *below.items()] if n > 1}
        grid.append(cells)
    widths: dict[int, int] = {}
    for row in grid:
        if isinstance(row, dict):
            for i, c in row.items():
                widths[i] = max(widths.get(i, 0), min(len(c), COLUMN_WIDTH))
    out = []
    for row in grid:
        if isinstance(row, list):
            out += row
        elif shown := [i for i, c in row.items() if c]:
            out.append(" | ".join(row.get(i, "").ljust(widths.get(i, 0)) for i in range(max(shown) + 1)).rstrip())
    return out


#: Tables and lists nested deeper than this are rendered as running text, which bounds the recursion.
MAX_DEPTH = 20


def render_lines(node: Node, depth: int = 0) -> list[str]:
    page, lists = _Page(), []
    todo: list = [(node, False)]  # an own stack: depth of the tree is not bounded
    while todo:
        x, leave = todo.pop()
        if isinstance(x, str):
            page.inline(x)
            continue
        name = x.name
        if leave:
            if name in ("ul", "ol", "menu") and lists:
                lists.pop()
            page.block(name in SPACED and not (lists and name in ("ul", "ol", "menu")))
            continue
        if x is not node and not visible(x):
            continue
        if name == "br":
            if page.line:
                page.end_line()
            else:
                page.gap = 1
            continue
        if name == "img":
            page.inline(x.attrs.get("alt", ""))
            continue
        if name == "hr":
            page.block(True)
            continue
        if name == "pre":
            page.block(True)
            page.raw([s.rstrip() for s in _plain(x).strip("\n").split("\n")] if _plain(x).strip() else [])
            page.block(True)
            continue
        if name == "table" and depth < MAX_DEPTH and x is not node:
            page.block(True)
            page.raw(_table(x, depth))
            page.block(True)
            continue
        if name in ("td", "th") and x is not node:
            page.inline(" ")
        if name in BLOCK or name == "tr":
            page.block(name in SPACED and not (lists and name in ("ul", "ol", "menu")))
            if name in ("ul", "ol", "menu"):
                start = x.attrs.get("start", "")
                lists.append([name, int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1])
            elif name == "li":
                kind = lists[-1] if lists else ["ul", 1]
                mark = f"{kind[1]}. " if kind[0] == "ol" else "- "
                kind[1] += 1
                page.line = ["  " * min(max(len(lists) - 1, 0), MAX_DEPTH) + mark.rstrip()]
                page.space = True
            todo.append((x, True))
        todo += [(c, False) for c in reversed(x.children)]
    return page.done()


def render(source: str | None) -> str:
    return "\n".join(render_lines(parse(source))) if source else ""


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text) per row. Null or empty html gives an empty text; markup of any kind gives some text, never an error."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html"))
    kind = dict(rows.dtypes)["page_id"]

    def start():
        return lambda batch: {"page_id": batch.column("page_id"), "text": [render(x.as_py()) for x in batch.column("html")]}

    return arrow_map(rows, f"page_id {kind}, text string", start)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page with its size in characters and lines."""
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "text", F.length("text").cast("bigint").alias("n_chars"),
                      F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("bigint").alias("n_lines"))
