"""Visible text of HTML pages, laid out (operator 1).

A tree builder supplies implied tags; visibility rules drop what a browser
doesn't show; a renderer emits the rest with paragraphs set apart by blank lines,
list markers and indents, and table cells aligned in columns.
"""

from __future__ import annotations

import html
import re
import sys
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Fixed names of HTML elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
UNSHOWN = frozenset("head title script style template noscript iframe noembed noframes object canvas audio video datalist meta link base param source track map rp".split())
#: Elements of other vocabularies, and what inside them isn't shown where it stands.
FOREIGN = frozenset("svg math".split())
FOREIGN_UNSHOWN = frozenset("defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p plaintext pre search section summary table ul xmp".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul dir menu".split())
TABLE_PARTS = frozenset("caption colgroup col thead tbody tfoot tr td th".split())
LISTS = frozenset("ul ol menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag closes these open elements, up to the second set.
CLOSES = {
    "li": ({"li"}, LISTS | {"table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"caption", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
P_SCOPE = frozenset("table td th caption button object html".split())
HEAD_PARTS = frozenset("title script style meta link base template noscript head html".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(>?)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
SPACE = re.compile(r"[ \t\n\f\r]+")
#: Lines of a cell are wrapped at blanks to this width; spans are at most this many columns.
CELL, SPAN = 60, 1000


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def attributes(source: str) -> dict[str, str]:
    if not source.strip(" \t\n\f\r/"):
        return {}
    return {m[1].lower(): html.unescape(next((x for x in m.groups()[1:] if x is not None), "")) for m in reversed(list(ATTRIBUTE.finditer(source)))}


class Open(list):
    """The open elements, the root first, and how many there are of each name."""

    def __init__(self, root: Node):
        super().__init__([root])
        self.count: Counter = Counter()

    def push(self, node: Node) -> None:
        self.append(node)
        self.count[node.tag] += 1

    def cut(self, k: int) -> None:
        while len(self) > k:
            self.count[self.pop().tag] -= 1


def parse(source: str) -> Node:
    """The tree of a page: html, with a head and a body where there is anything for them."""
    root = Node("html")
    stack = Open(root)

    def close(names, scope) -> None:
        while any(stack.count[n] for n in names):
            k = next(k for k in range(len(stack) - 1, -1, -1) if not k or stack[k].tag in scope or stack[k].tag in names)
            if not k or stack[k].tag in scope:
                return
            stack.cut(k)

    def open_(tag: str, attrs: dict[str, str], keep: bool = True) -> Node:
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if keep:
            stack.push(node)
        return node

    def into_body() -> None:
        if len(stack) == 1 or stack[1].tag == "head":
            stack.cut(1)
            if root.children and isinstance(root.children[-1], Node) and root.children[-1].tag == "body":
                stack.push(root.children[-1])
            else:
                open_("body", {})

    def text(data: str) -> None:
        if data:
            if (len(stack) == 1 or len(stack) == 2 and stack[1].tag == "head") and data.strip(" \t\n\f\r"):
                into_body()
            stack[-1].children.append(html.unescape(data) if "&" in data else data)

    at, n = 0, len(source)
    while at < n:
        m = TOKEN.search(source, at)
        if not m:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if not m[4]:  # a stray quote: the tag ends at the next >
            at = source.find(">", at) + 1 or n
        if m[1]:
            if tag == "br":
                open_("br", {}, False)
            elif tag not in ("html", "body"):
                end(stack, tag)
            continue
        attrs = attributes(m[3])
        if tag == "html":
            continue
        if tag == "head":
            if len(stack) == 1 and not root.children:
                open_("head", attrs)
            continue
        if tag == "body":
            had = any(isinstance(c, Node) and c.tag == "body" for c in root.children)
            into_body()
            if not had:
                stack[1].attributes = attrs
            continue
        if len(stack) == 1 or stack[-1].tag == "head":
            if tag not in HEAD_PARTS:
                into_body()
            elif len(stack) == 1 and not any(isinstance(c, Node) and c.tag == "body" for c in root.children):
                open_("head", {})
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in BLOCKS:
            close({"p"}, P_SCOPE)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.cut(len(stack) - 1)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            open_("tr", {})
        foreign = (tag in FOREIGN_UNSHOWN or m[3].endswith("/")) and any(stack.count[x] for x in FOREIGN)
        if foreign and tag in FOREIGN_UNSHOWN:
            attrs["hidden"] = ""
        if tag in VOID or foreign and m[3].endswith("/"):
            open_(tag, attrs, False)
        elif tag in RAW or tag in RCDATA:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
            body = source[at : stop.start() if stop else n]
            node = open_(tag, attrs, False)
            node.children.append(html.unescape(body) if tag in RCDATA else body)
            at = (source.find(">", stop.start()) + 1 or n) if stop else n
        else:
            open_(tag, attrs)
    return root


def end(stack: Open, tag: str) -> None:
    """Close the innermost open element of this name, unless a block or a cell bars an inline or foreign one."""
    if not (any(stack.count[x] for x in HEADINGS) if tag in HEADINGS else stack.count[tag]):
        return
    for k in range(len(stack) - 1, 0, -1):
        name = stack[k].tag
        if name == tag or tag in HEADINGS and name in HEADINGS:
            stack.cut(k)
            return
        if name in ("td", "th", "caption") and tag not in ("table", "tr", "tbody", "thead", "tfoot"):
            return
        if tag not in BLOCKS and tag not in TABLE_PARTS and name in BLOCKS:
            return
        if name == "table" and tag in TABLE_PARTS or name in LISTS and tag == "li":
            return


class Lines:
    """Text laid out so far: finished lines, an open one, and whether a blank line is due."""

    def __init__(self):
        self.lines: list[str] = []
        self.open: list[str] = []
        self.blank = False

    def flush(self) -> bool:
        line = SPACE.sub(" ", "".join(self.open)).strip(" ")
        self.open = []
        if line:
            self.put([line])
        return bool(line)

    def put(self, lines: list[str]) -> None:
        if not lines:
            return
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines += lines

    def edge(self, spaced: bool) -> None:
        self.flush()
        self.blank |= spaced

    def line_break(self) -> None:
        if not self.flush() and self.lines and not self.blank:
            self.lines.append("")


def style_of(node: Node) -> str:
    return SPACE.sub("", node.attributes.get("style", "").lower())


def removed(node: Node) -> bool:
    """Not laid out at all."""
    a, tag = node.attributes, node.tag
    if tag in UNSHOWN or a and ("hidden" in a and a["hidden"].lower() != "until-found" or "display:none" in style_of(node)):
        return True
    return tag == "input" and a.get("type", "").lower() == "hidden" or tag == "dialog" and "open" not in a


def visible(node: Node, shown: bool) -> bool:
    """Whether a node's own text is shown: as its style says, else as its parent's."""
    style = style_of(node) if "style" in node.attributes else ""
    if "visibility:" not in style:
        return shown
    value = style.rpartition("visibility:")[2]
    return shown if value.startswith("inherit") else not value.startswith(("hidden", "collapse"))


def layout(node: Node, out: Lines, shown: bool = True, listed: int = 0) -> None:
    """Lay out a node's children; shown: not under visibility:hidden; listed: lists around."""
    closed = node.tag == "details" and "open" not in node.attributes
    for child in node.children:
        if isinstance(child, str):
            if shown and not closed:
                out.open.append(child)
            continue
        tag = child.tag
        if removed(child) or closed and tag != "summary":
            continue
        seen = visible(child, shown)
        if tag == "br":
            out.line_break()
        elif tag == "wbr" or tag == "img":
            pass
        elif tag == "input":
            if seen and child.attributes.get("type", "text").lower() in ("submit", "button", "reset", "text", "search", "email", "url", "tel", "number"):
                out.open.append(child.attributes.get("value", ""))
        elif tag in ("pre", "listing", "textarea", "plaintext", "xmp"):
            out.edge(tag != "textarea")
            out.put(preformatted(child, seen))
            out.edge(tag != "textarea")
        elif tag == "table":
            out.edge(True)
            out.put(table(child, seen, listed))
            out.edge(True)
        elif tag in LISTS:
            out.edge(not listed)
            items(child, out, seen, listed + 1)
            out.edge(not listed)
        elif tag in ("blockquote", "dd"):
            out.edge(tag == "blockquote")
            out.put(inside(child, seen, listed, "    " if tag == "dd" else "> "))
            out.edge(tag == "blockquote")
        elif tag in ("text", "mtd"):  # labels of drawings and cells of formulas stand apart
            out.open.append(" ")
            layout(child, out, seen, listed)
            out.open.append(" ")
        elif tag in BLOCKS or tag in TABLE_PARTS:
            out.edge(tag in SPACED)
            layout(child, out, seen, listed)
            out.edge(tag in SPACED)
        else:
            layout(child, out, seen, listed)


def inside(node: Node, shown: bool, listed: int, prefix: str = "") -> list[str]:
    part = Lines()
    layout(node, part, shown, listed)
    part.flush()
    while part.lines and not part.lines[-1]:
        part.lines.pop()
    return [(prefix + x).rstrip(" ") for x in part.lines] if prefix else part.lines


def preformatted(node: Node, shown: bool) -> list[str]:
    parts: list[str] = []

    def gather(x: Node, seen: bool) -> None:
        for c in x.children:
            if isinstance(c, str):
                parts.append(c if seen else "")
            elif c.tag == "br":
                parts.append("\n")
            elif not removed(c):
                gather(c, visible(c, seen))

    gather(node, shown)
    lines = "".join(parts).replace("\r\n", "\n").expandtabs(8).split("\n")
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    return lines


def items(node: Node, out: Lines, shown: bool, listed: int) -> None:
    """A list: numbers or bullets, what follows a marker's line indented below it; a hidden item counts but has no marker."""
    start = node.attributes.get("start", "1")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in node.children:
        if isinstance(child, str):
            if shown and child.strip(" \t\n\f\r"):
                out.open.append(child)
            continue
        if removed(child):
            continue
        if child.tag != "li":
            holder = Node("div")
            holder.children = [child]
            layout(holder, out, shown, listed)
            continue
        out.flush()
        marker = "- "
        if node.tag == "ol":
            value = child.attributes.get("value", "")
            number = int(value) if re.fullmatch(r"-?\d{1,9}", value) else number
            marker = f"{number}. "
            number += 1
        seen = visible(child, shown)
        lines = inside(child, seen, listed)
        if not seen:
            out.put(lines)
        elif lines:
            out.put([marker + lines[0], *[(" " * len(marker) + x).rstrip(" ") for x in lines[1:]]])


def span(cell: Node, name: str) -> int:
    value = cell.attributes.get(name, "")
    return min(SPAN, max(1, int(value))) if re.fullmatch(r"\d{1,9}", value) else 1


def wrapped(lines: list[str]) -> list[str]:
    """Lines cut at single blanks to CELL characters or fewer, as far as their words allow."""
    out = []
    for line in lines:
        while len(line) > CELL and "  " not in line.strip(" "):
            indent = len(line) - len(line.lstrip(" "))
            k = line.rfind(" ", indent + 1, CELL + 1)
            k = k if k > 0 else line.find(" ", CELL)
            if k < 0:
                break
            out.append(line[:k])
            line = " " * indent + line[k + 1 :]
        out.append(line)
    return out


def table(node: Node, shown: bool, listed: int) -> list[str]:
    """Caption and rows; head first and foot last; cells in their columns, which are as wide as their widest line.

    Cells are wrapped to CELL; a line that stays longer has the cells behind it on
    the next line, so columns are aligned whatever a cell holds.
    """
    head: list[tuple[Node, bool]] = []
    body: list[tuple[Node, bool]] = []
    foot: list[tuple[Node, bool]] = []
    before: list[str] = []

    def stray(children: list, seen: bool) -> None:
        holder = Node("div")
        holder.children = children
        before.extend(inside(holder, seen, listed))

    def take(x: Node, rows: list[tuple[Node, bool]], seen: bool) -> None:
        """Rows of a table or a part of one; what is neither a row nor a cell goes in front."""
        for child in x.children:
            if isinstance(child, str):
                if child.strip(" \t\n\f\r"):
                    stray([child], seen)
            elif removed(child):
                continue
            elif child.tag == "tr":
                own = visible(child, seen)
                rows.append((child, own))
                stray([c for c in child.children if isinstance(c, str) and c.strip(" \t\n\f\r")], own)
            elif x is node and child.tag in ("thead", "tbody", "tfoot"):
                take(child, {"thead": head, "tfoot": foot}.get(child.tag, body), visible(child, seen))
            elif child.tag not in ("colgroup", "col"):
                stray([child], seen)

    take(node, body, shown)
    grid: list[list[tuple[int, int, list[str]]]] = []
    taken: dict[int, int] = {}  # column -> rows that a cell from above still fills
    for row, seen in head + body + foot:
        cells, column = [], 0
        for cell in row.children:
            if isinstance(cell, str) or removed(cell):
                continue
            while taken.get(column, 0) > 0:
                column += 1
            width, down = span(cell, "colspan"), span(cell, "rowspan")
            cells.append((column, width, wrapped(inside(cell, visible(cell, seen), listed))))
            if down > 1:
                for k in range(column, column + width):
                    taken[k] = down
            column += width
        taken = {k: v - 1 for k, v in taken.items() if v > 1}
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for column, width, lines in cells:
            if width == 1:
                widths[column] = max(widths.get(column, 0), max((len(x) for x in lines if len(x) <= CELL), default=1 if lines else 0))
    starts: dict[int, int] = {}
    at = 0
    for column in sorted(widths):
        starts[column] = at
        at += widths[column] + 2 if widths[column] else 0
    columns = list(starts)
    out = list(before)
    for cells in grid:
        for k in range(max((len(lines) for _, _, lines in cells), default=0)):
            line = ""
            for column, _, lines in cells:
                if k < len(lines) and lines[k]:
                    here = bisect_left(columns, column)
                    indent = starts[columns[here]] if here < len(columns) else at
                    if line and len(line) + 2 > indent:
                        out.append(line)
                        line = ""
                    line = line.ljust(indent) + lines[k]
            out.append(line)
    return out


def depth_of(root: Node) -> int:
    most, todo = 0, [(root, 1)]
    while todo:
        node, depth = todo.pop()
        most = max(most, depth)
        todo += [(c, depth + 1) for c in node.children if isinstance(c, Node)]
    return most


def visible_text(source: str | None) -> str:
    """The visible text of a page; nothing for a null or empty one."""
    if not source:
        return ""
    root = parse(source.replace("\0", "�"))
    limit, needed = sys.getrecursionlimit(), 8 * depth_of(root) + 2000
    if needed > limit:  # frames of Python functions lie on the heap, so depth is no danger
        sys.setrecursionlimit(needed)
    try:
        return "\n".join(inside(root, True, 0))
    finally:
        sys.setrecursionlimit(limit)


def extract_text(pages: DataFrame, key: str = "page_id", source: str = "html") -> DataFrame:
    """(key, text) of each row; null and empty pages give an empty text, repeated rows stay, an empty table gives none.

    Pages of any length and depth are laid out as a whole; other columns, however
    named, are not looked at.
    """
    kind = dict(pages.dtypes)[key]

    def rows(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([visible_text(x.as_py()) for x in batch.column(1)], pa.string())], names=[key, "text"])

    return pages.select(key, F.col(source)).mapInArrow(tidy(rows), f"`{key}` {kind}, text string")
