"""HTML extraction by layout-aware rendering.

A page is read into a tree (implied end tags, void elements, raw text elements, stray end tags), what a browser would
not show is left out, and the rest is rendered as text: blocks on lines of their own, paragraphs and headings set off by
a blank line, list items with markers and indentation, preformatted text as it stands, tables with aligned columns.

One row in, one row out; nothing is shuffled.  Defined results: null or empty html gives empty text and title; a page
without tags is its text; repeated rows are rendered one by one; very long pages are read whole; elements may be nested to any
depth, as nothing here calls itself (the parser keeps a stack, and the renderer is a stack of generators); an empty table gives
an empty one; columns other than id and html are not read, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Generator, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import Boxed, tidy

#: The bounds of the HTML standard for the spans of a cell.
MAX_COLSPAN, MAX_ROWSPAN = 1000, 65534

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title meta link base datalist object audio video canvas svg iframe noembed noframes area map".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4"
    " h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir".split())
CLOSES_P = BLOCK - {"body", "html", "li", "dd", "dt", "legend", "option", "optgroup"} | {"li", "dd", "dt"}
#: An open element that a new one ends, up to an element that guards it.
ENDED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
IN_HEAD = frozenset("base link meta title style script noscript template".split())
TABLE = frozenset("table caption colgroup thead tbody tfoot tr td th".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: End tags do not reach beyond these.
SCOPE = frozenset("table td th caption html".split())

_MARKUP = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(hidden|collapse)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids = tag, attrs, []


def _attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for k, a, b, c in _ATTR.findall(raw):
        out.setdefault(k.lower(), unescape(a or b or c))
    return out


class _Open:
    """The open elements; counts by tag and the place of an open paragraph spare most walks up the stack."""

    def __init__(self, root: Node):
        self.stack, self.count, self.paragraph = [root], Counter(), [0]

    def push(self, node: Node) -> None:
        self.paragraph.append(len(self.stack) if node.tag == "p" else 0 if node.tag in SCOPE or node.tag == "button" else self.paragraph[-1])
        self.stack.append(node)
        self.count[node.tag] += 1

    def cut(self, at: int) -> None:
        """Closes the element at that place and all inside it."""
        for node in self.stack[at:]:
            self.count[node.tag] -= 1
        del self.stack[at:], self.paragraph[at:]

    def end(self, tags: set[str], guards: set[str]) -> None:
        """Closes the elements with one of the tags, up to a guard."""
        while any(self.count[t] for t in tags):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].tag in tags:
                    self.cut(i)
                    break
                if self.stack[i].tag in guards:
                    return
            else:
                return

    def end_tag(self, tag: str) -> None:
        """An inline element's end does not close a block inside it, whose own end is still to come; any heading's end closes
        the open heading."""
        ends = HEADINGS if tag in HEADINGS else {tag}
        if not any(self.count[t] for t in ends):
            return
        inline = tag not in BLOCK and tag not in TABLE
        for i in range(len(self.stack) - 1, 0, -1):
            own = self.stack[i].tag
            if own in ends:
                return self.cut(i)
            if inline and (own in BLOCK or own in TABLE):
                return None
            if own == "table" or (own in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption")):
                return None
        return None


def parse(html: str) -> Node:
    root = Node("#root", {})
    open_, at, n = _Open(root), 0, len(html)
    stack = open_.stack

    def text(s: str) -> None:
        if s:
            if stack[-1].tag == "head" and s.strip():
                open_.cut(len(stack) - 1)
            stack[-1].kids.append(unescape(s) if "&" in s else s)

    while at < n:
        m = _MARKUP.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in ("body", "html"):  # what follows those still belongs to the body
                open_.end_tag(tag)
            continue
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            open_.cut(len(stack) - 1)
        if tag in CLOSES_P and open_.paragraph[-1]:
            open_.cut(open_.paragraph[-1])
        if tag in ENDED_BY:
            open_.end(*ENDED_BY[tag])
        attrs = _attrs(m[3]) if m[3] and not m[3].isspace() else {}
        if tag in ("html", "body") and open_.count[tag]:
            continue
        node = Node(tag, attrs)
        stack[-1].kids.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
            body = html[at : close.start() if close else n]
            at = close.end() if close else n
            if body:
                node.kids.append(unescape(body) if tag in ("title", "textarea") else body)
        elif tag not in VOID and (not (m[3] or "").endswith("/") or tag in BLOCK):
            open_.push(node)
    return root


def visible(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs:
        return False
    if node.tag == "input":
        return False
    if node.tag == "dialog" and "open" not in node.attrs:
        return False
    style = node.attrs.get("style")
    return not (style and _UNSEEN.search(style))


def _width(s: str) -> int:
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


#: Yields what it waits for and returns its result.
Steps = Generator["Steps", list, object]


class _Lines:
    """Collects text into lines; remembers how many line breaks are due."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.due_blank = False
        self.space = False

    def word(self, s: str) -> None:
        flat = _SPACE.sub(" ", s)
        if flat == " " or not flat:
            self.space |= bool(flat) and bool(self.now)
            return
        if (flat[0] == " " or self.space) and self.now:
            self.now.append(" ")
        self.now.append(flat.strip(" "))
        self.space = flat[-1] == " "

    def brk(self) -> None:
        if self.now:
            self._put("".join(self.now))
            self.now = []
        self.space = False

    def forced(self) -> None:
        if self.now:
            self.brk()
        elif self.lines:
            self.due_blank = True

    def blank(self) -> None:
        self.brk()
        if self.lines:
            self.due_blank = True

    def _put(self, line: str) -> None:
        if self.due_blank and self.lines:
            self.lines.append("")
        self.due_blank = False
        self.lines.append(line)

    def raw(self, lines: list[str]) -> None:
        self.brk()
        for line in lines:
            self._put(line) if line else self.lines.append("")


def _table(node: Node) -> Steps:
    """Caption lines and the rows with aligned cells."""
    caption: list[str] = []
    rows: list[list[str]] = []
    carried: dict[int, int] = {}

    trs: list[Node] = []
    todo = node.kids[::-1]
    while todo:
        kid = todo.pop()
        if isinstance(kid, str):
            if kid.strip():
                caption.append(_SPACE.sub(" ", kid).strip())
        elif not visible(kid):
            continue
        elif kid.tag == "tr":
            trs.append(kid)
        elif kid.tag in ("thead", "tbody", "tfoot"):
            todo.extend(reversed(kid.kids))
        elif kid.tag not in ("colgroup", "col"):
            caption.extend((yield _node(kid)))  # captions, and misplaced content, are shown before the table

    def span(cell: Node, name: str, most: int) -> int:
        raw = cell.attrs.get(name, "1").strip()
        return max(1, min(most, int(raw[:9]))) if raw.isascii() and raw.isdigit() else 1

    for tr in trs:
        row: list[str] = []

        def carry(row: list[str] = row) -> None:
            while len(row) in carried:
                left = carried.pop(len(row))
                if left > 1:
                    carried[len(row)] = left - 1
                row.append("")

        for cell in tr.kids:
            if isinstance(cell, str):
                if cell.strip():
                    caption.append(_SPACE.sub(" ", cell).strip())
                continue
            if not visible(cell):
                continue
            carry()
            lines = yield _node(cell)
            body = " ".join(x.strip() for x in lines if x.strip())
            down = span(cell, "rowspan", MAX_ROWSPAN)
            for i in range(span(cell, "colspan", MAX_COLSPAN)):
                if down > 1:
                    carried[len(row)] = down - 1
                row.append(body if i == 0 else "")
        carry()
        while row and not row[-1]:
            row.pop()
        if row:
            rows.append(row)
    widths = [0] * max(map(len, rows), default=0)
    for row in rows:
        for i, cell in enumerate(row):
            widths[i] = max(widths[i], _width(cell))
    keep = [i for i, w in enumerate(widths) if w]
    out = []
    for row in rows:
        cells = [(row[i] if i < len(row) else "", widths[i]) for i in keep]
        out.append("  ".join(c + " " * (w - _width(c)) for c, w in cells).rstrip())
    return caption, out


def render_node(node: Node) -> list[str]:
    return _run(_node(node))


def _run(steps: Steps) -> list[str]:
    """Runs a generator that yields the generators that it waits for; the stack of those that wait is a list."""
    waiting, value = [steps], None
    while True:
        try:
            waiting.append(waiting[-1].send(value))
            value = None
        except StopIteration as done:
            waiting.pop()
            value = done.value
            if not waiting:
                return value


def _node(node: Node) -> Steps:
    out = _Lines()
    yield _render(node, out)
    out.brk()
    return out.lines


def _render(node: Node, out: _Lines) -> Steps:
    closed = node.tag == "details" and "open" not in node.attrs
    number = int(s) if node.tag == "ol" and (s := node.attrs.get("start", "")).isascii() and s.isdigit() and len(s) < 10 else 1
    for kid in node.kids:
        if closed and (isinstance(kid, str) or kid.tag != "summary"):
            continue  # of a closed disclosure only the summary shows
        if isinstance(kid, str):
            out.word(kid)
            continue
        tag = kid.tag
        if not visible(kid):
            continue
        if tag == "br":
            out.forced()
        elif tag == "hr":
            out.blank()
        elif tag in ("pre", "textarea", "xmp"):
            out.blank()
            out.raw(_plain(kid).strip("\n").split("\n"))
            out.blank()
        elif tag == "table":
            caption, rows = yield _table(kid)
            out.blank()
            out.raw(caption)
            out.raw(rows)
            out.blank()
        elif tag == "li":
            mark = "- "
            if node.tag == "ol":
                mark, number = f"{number}. ", number + 1
            lines = yield _node(kid)
            out.brk()
            if lines:
                pad = " " * len(mark)
                out.raw([mark + lines[0], *((pad + x) if x else "" for x in lines[1:])])
        elif tag == "dd":
            out.raw([("    " + x) if x else "" for x in (yield _node(kid))])
        elif tag == "blockquote":
            out.blank()
            out.raw([("> " + x) if x else ">" for x in (yield _node(kid))])
            out.blank()
        elif tag == "select":
            options = _options(kid)
            chosen = next((x for x in options if "selected" in x.attrs), options[0] if options else None)
            if chosen:
                out.word(" " + _plain(chosen) + " ")
        elif tag in BLOCK:
            nested = node.tag in ("li", "ul", "ol") and tag in ("ul", "ol")
            out.blank() if tag in SPACED and not nested else out.brk()
            yield _render(kid, out)
            out.blank() if tag in SPACED and not nested else out.brk()
        elif tag in ("td", "th"):
            out.word(" ")
            yield _render(kid, out)
            out.word(" ")
        else:
            yield _render(kid, out)


def _options(node: Node) -> list[Node]:
    out, todo = [], node.kids[::-1]
    while todo:
        kid = todo.pop()
        if isinstance(kid, Node):
            if kid.tag == "option":
                out.append(kid)
            else:
                todo.extend(reversed(kid.kids))
    return out


def _plain(node: Node) -> str:
    out, todo = [], node.kids[::-1]
    while todo:
        kid = todo.pop()
        if isinstance(kid, str):
            out.append(kid)
        elif kid.tag == "br":
            out.append("\n")
        elif visible(kid):
            todo.extend(reversed(kid.kids))
    return "".join(out)


def title_of(root: Node) -> str:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag == "title":
            return _SPACE.sub(" ", "".join(k for k in node.kids if isinstance(k, str))).strip()
        if node.tag in ("#root", "html", "head"):
            todo.extend(k for k in reversed(node.kids) if isinstance(k, Node))
    return ""


def extract(html: str | None) -> tuple[str, str]:
    """Title and visible text."""
    if not html:
        return "", ""
    root = parse(html.replace("\r\n", "\n").replace("\r", "\n").replace("\0", ""))
    lines = [x.rstrip() for x in render_node(root)]
    return title_of(root), "\n".join(lines).strip("\n")


def extract_pages(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, title, text, n_chars) for every row."""
    box = Boxed(pages)
    slim = box.df.select(box.col(id_col).alias("page_id"), box.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [extract(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.string()), pa.array([len(g[1]) for g in got], pa.int64())],
                names=["page_id", "title", "text", "n_chars"],
            )

    kind = slim.schema["page_id"].dataType.simpleString()
    return slim.mapInArrow(tidy(run), f"page_id {kind}, title string, text string, n_chars long")
