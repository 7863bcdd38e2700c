"""HTML extraction (operator 9): layout-aware rendering of all visible text.

Tags build a stack of open elements, with the end tags that HTML implies. Each element is
visible or not; visible text flows into the innermost box (page, list item, quote, table cell),
and a box that closes hands its lines to the box around it. Nothing recurses, and each
step looks at its own piece of the input only, so deep or broken markup of any length is read
in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mentionlake.llm.common import ship, table, whole

# Element names of the HTML standard, by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title datalist iframe noembed noframes object audio video canvas".split())
#: Elements of SVG and MathML that show nothing, and those of HTML content inside them.
FOREIGN_HIDDEN = frozenset("title desc defs metadata annotation annotation-xml".split())
HTML_INSIDE = frozenset("foreignobject desc title annotation-xml".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table pre blockquote figure hr fieldset xmp".split())
BLOCK = SPACED | frozenset(
    "address article aside body center dd details dialog dir div dt fieldset figcaption footer form header hgroup html legend li main menu nav "
    "optgroup option search section summary caption tr td th thead tbody tfoot".split()
)
#: A start tag of the first kind ends an open element of the second, unless one of the third stands between.
SCOPE = frozenset("table ul ol dl menu dir body html blockquote div article section".split())
ENDS = {
    "li": ({"li"}, SCOPE),
    "dt": ({"dt", "dd"}, SCOPE),
    "dd": ({"dt", "dd"}, SCOPE),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"})),
    "option": ({"option"}, {"select", "datalist"}),
}
TABLE_PARTS = frozenset("caption tr td th thead tbody tfoot colgroup".split())
P_ENDERS = BLOCK - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "option", "optgroup", "caption"}
HEAD_PARTS = frozenset("base link meta title style script template noscript".split())

RAW_END = {name: re.compile(f"</{name}", re.I | re.A) for name in RAW}
SPACE = re.compile(r"[ \t\n\f\r]+")
TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: The attributes of a tag, up to its ">" or the page's end. A quote opens a value after "=" only; one that is never closed belongs to a name.
TAG_BODY = re.compile(
    r"""(?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^ \t\n\f\r>]*+))?+)*+"""
)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
#: Bounds of the layout, none of which loses text: levels of indentation and of cells kept as boxes, width a
#: column is padded to, lines of a cell printed beside others, rows a cell reaches down.
MAX_INDENT, MAX_PAD, MAX_BESIDE, MAX_DOWN = 20, 60, 12, 100


@dataclass
class Cell:
    """The lines of a table cell and the columns and rows it covers."""

    lines: list[str]
    span: int = 1
    down: int = 1


@dataclass
class Box:
    """Lines of one container, and the inline text not yet broken into one."""

    lines: list[str] = field(default_factory=list)
    inline: list[str] = field(default_factory=list)
    blank: bool = False

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.append(line)

    def end_line(self, blank: bool = False) -> None:
        if self.inline:
            line = SPACE.sub(" ", "".join(self.inline)).strip(" ")
            self.inline.clear()
            if line:
                self.put(line)
        self.blank |= blank

    def take(self, child: Box, first: str = "", rest: str = "") -> None:
        child.end_line()
        for i, line in enumerate(child.lines):
            self.put(((rest if i else first) + line).rstrip() if line or not i else "")


@dataclass
class Element:
    name: str
    visible: bool
    box: Box | None = None
    #: Number of the next item of an ordered list, or rows of a table.
    count: int | None = None
    rows: list[list[Cell]] | None = None
    #: Rows that a cell covers.
    down: int = 1
    summary_only: bool = False
    #: Part of an SVG or MathML tree.
    foreign: bool = False


def tokens(html: str, foreign: Callable[[], bool] = bool) -> Iterator[tuple[str, str, str]]:
    """(kind, name, body): kinds are text, raw, start, end; the body is the text or the tag's attributes.

    ``foreign`` tells whether the place is inside SVG or MathML, where a tag may close itself.
    """
    at, n = 0, len(html)
    raw_end: dict[str, int] = {}
    closers = {"-->": 0, ">": 0}

    def close(mark: str, start: int) -> int:
        """The place after the mark; once it is missing it stays so."""
        if closers[mark] < 0:
            return n
        found = html.find(mark, start)
        closers[mark] = found
        return n if found < 0 else found + len(mark)

    while at < n:
        open_at = html.find("<", at)
        if open_at < 0:
            yield "text", "", html[at:]
            return
        if open_at > at:
            yield "text", "", html[at:open_at]
        if html.startswith("<!--", open_at):
            at = close("-->", open_at + 4)
            continue
        if html.startswith(("<!", "<?"), open_at):
            at = close(">", open_at)
            continue
        m = TAG.match(html, open_at)
        if not m:
            yield "text", "", "<"
            at = open_at + 1
            continue
        name = m[1].lower()
        stop = TAG_BODY.match(html, m.end()).end()
        at, body = min(stop + 1, n), html[m.end() : stop]
        if html.startswith("</", open_at):
            yield "end", name, ""
            continue
        closed = name in RAW and body.endswith("/") and foreign()
        yield "start", name, body
        if name in RAW and not closed:
            if raw_end.get(name, 0) >= 0:
                found = RAW_END[name].search(html, at)
                raw_end[name] = found.start() if found else -1
            stop = n if raw_end[name] < 0 else raw_end[name]
            yield "raw", name, html[at:stop]
            at = stop


def attributes(body: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(body)}


class Page:
    """Builds the stack of one page and renders it."""

    def __init__(self):
        self.root = Box()
        self.stack: list[Element] = [Element("#page", True, self.root)]
        self.boxes: list[Box] = [self.root]
        self.pre = 0
        self.open: dict[str, int] = {}

    def text(self, text: str) -> None:
        if not self.stack[-1].visible or self.stack[-1].summary_only:
            return
        text = unescape(text)
        box = self.boxes[-1]
        if not self.pre:
            box.inline.append(text)
            return
        first, *more = text.split("\n")
        box.inline.append(first.replace(" ", "\xa0"))
        for line in more:
            had = bool(box.inline and "".join(box.inline))
            box.end_line()
            if not had and box.lines:
                box.put("")
            box.inline.append(line.replace(" ", "\xa0"))

    def start(self, name: str, body: str) -> None:
        if name in ("html", "body", "head") and (self.open.get(name) or self.open.get("body")):
            return
        if name in TABLE_PARTS and not self.open.get("table"):
            return
        if name not in HEAD_PARTS and self.open.get("head") and name != "head":
            self.close_to({"head"}, set())
        if name in ENDS:
            self.close_to(*ENDS[name])
        if name in P_ENDERS and self.open.get("p"):
            self.close_to({"p"}, {"table", "td", "th", "button"})
        if name in ("td", "th") and self.stack[-1].name in ("table", "thead", "tbody", "tfoot"):
            self.push("tr", True)
        a = attributes(body) if body.strip(" /") else {}
        foreign = name in ("svg", "math") or self.foreign()
        hidden = name in HIDDEN or foreign and name in FOREIGN_HIDDEN or "hidden" in a or bool(UNSEEN.search(a.get("style", ""))) or (name == "dialog" and "open" not in a)
        if name == "br":
            if self.stack[-1].visible:
                box = self.boxes[-1]
                if box.inline or not box.lines:
                    box.end_line()
                else:
                    box.put("") if box.lines[-1] else None
            return
        if name in VOID:
            if name == "hr" and self.stack[-1].visible:
                self.boxes[-1].end_line(blank=True)
            elif name == "wbr":
                pass
            return
        self.push(name, not hidden, a, foreign)
        if body.rstrip().endswith("/") and (foreign or name in ("path", "circle", "rect")):
            self.pop()

    def foreign(self) -> bool:
        """Whether the next element is part of an SVG or MathML tree."""
        return self.stack[-1].foreign and self.stack[-1].name not in HTML_INSIDE

    def push(self, name: str, visible: bool, a: dict[str, str] | None = None, foreign: bool = False) -> None:
        a, parent = a or {}, self.stack[-1]
        visible = visible and parent.visible and not (parent.summary_only and name != "summary")
        e = Element(name, visible, foreign=foreign)
        if name == "details":
            e.summary_only = "open" not in a
        if visible:
            if (name in BLOCK or foreign and name == "text") and name not in ("td", "th"):
                self.boxes[-1].end_line(blank=name in SPACED and not (name in ("ul", "ol") and parent.name == "li"))
            if name in ("ol", "ul", "menu", "dir"):
                start = a.get("start", "1").strip()
                e.count = (int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1) if name == "ol" else None
            if name in ("li", "blockquote", "td", "th"):
                e.box = Box()
                self.boxes.append(e.box)
            if name in ("td", "th"):
                e.count, e.down = covered(a.get("colspan", ""), 1000), covered(a.get("rowspan", ""), MAX_DOWN)
            if name == "table":
                e.rows = []
            if name == "tr" and (owner := self.nearest("table")):
                owner.rows.append([])
            if name in ("pre", "xmp", "textarea"):
                self.pre += 1
        self.stack.append(e)
        self.open[name] = self.open.get(name, 0) + 1

    def nearest(self, name: str) -> Element | None:
        """The innermost open element of a name that shows rows; looks no further than tables nest."""
        if not self.open.get(name):
            return None
        return next((e for e in reversed(self.stack) if e.name == name and e.rows is not None), None)

    def end(self, name: str) -> None:
        if name == "p" and not self.open.get("p"):
            self.boxes[-1].end_line(blank=True) if self.stack[-1].visible else None
            return
        if self.open.get(name) and name not in ("html", "body"):
            fence = {"table"} if name in ("tr", "td", "th", "thead", "tbody", "tfoot", "caption") else {"td", "th"} if name not in ("table",) else set()
            self.close_to({name}, fence)

    def close_to(self, names: set[str], fence) -> None:
        """Close up to the outermost of ``names`` inside the innermost of ``fence``, if there is any."""
        if not any(self.open.get(x) for x in names):
            return
        target = None
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name in names:
                target = i
                if len(names) == 1:
                    break
            elif self.stack[i].name in fence:
                break
        while target is not None and len(self.stack) > target:
            self.pop()

    def pop(self) -> None:
        e = self.stack.pop()
        self.open[e.name] -= 1
        if not e.visible:
            return
        if e.name in ("pre", "xmp", "textarea"):
            self.pre -= 1
        box = self.boxes[-1]
        if e.box is not None:
            self.boxes.pop()
            box, outer = e.box, self.boxes[-1]
            if e.name in ("td", "th"):
                box.end_line()
                owner = self.nearest("table")
                lines = box.lines if len(self.boxes) < MAX_INDENT else [" ".join(filter(None, box.lines))]
                if owner is not None:
                    if not owner.rows:
                        owner.rows.append([])
                    owner.rows[-1].append(Cell(lines, e.count or 1, e.down))
            elif e.name == "blockquote":
                outer.end_line(blank=True)
                outer.take(box, *(["> "] * 2 if len(self.boxes) < MAX_INDENT else ["", ""]))
                outer.blank = True
            else:
                outer.end_line()
                mark = self.mark()
                outer.take(box, mark, " " * len(mark) if len(self.boxes) < MAX_INDENT else "")
                outer.blank = False
            return
        if e.name == "table":
            box.end_line(blank=True)
            rows = e.rows or []
            if is_layout(rows):
                for cell in (c for row in rows for c in row):
                    for line in cell.lines:
                        box.put(line)
                    box.blank = len(cell.lines) > 1
            else:
                for line in aligned(rows):
                    box.put(line)
            box.blank = True
        elif e.name in BLOCK or e.foreign and e.name == "text":
            box.end_line(blank=e.name in SPACED)

    def mark(self) -> str:
        """The sign of a list item; counts the items of an ordered list."""
        owner = next((e for e in reversed(self.stack[-3:]) if e.name in ("ol", "ul", "menu", "dir")), None)
        if owner is None or owner.name != "ol" or owner.count is None:
            return "- "
        owner.count += 1
        return f"{owner.count - 1}. "

    def finish(self) -> str:
        while len(self.stack) > 1:
            self.pop()
        self.root.end_line()
        return "\n".join(line.replace("\xa0", " ").rstrip() for line in self.root.lines)


def covered(value: str, most: int) -> int:
    """A colspan or rowspan as a number from 1 to ``most``."""
    return min(most, max(1, int(value))) if re.fullmatch(r"[0-9]{1,6}", value := value.strip()) else 1


def is_layout(rows: list[list[Cell]]) -> bool:
    """Whether a table arranges blocks: one column, or a cell too tall or too wide to stand beside others."""
    blocks = [c for row in rows for c in row if len(c.lines) > 1]
    alone = all(len(row) < 2 for row in rows)
    return bool(blocks) and (alone or any(len(c.lines) > MAX_BESIDE or max(map(len, c.lines)) > MAX_PAD for c in blocks))


def placed(rows: list[list[Cell]]) -> Iterator[list[tuple[int, Cell]]]:
    """Each row's cells with their first columns, beside the cells that reach down from rows above."""
    reaching: list[tuple[int, int, int]] = []
    for row in rows:
        column, at, out, new = 0, 0, [], []
        for cell in row:
            while at < len(reaching) and reaching[at][0] < column + cell.span:
                column = max(column, reaching[at][1])
                at += 1
            out.append((column, cell))
            if cell.down > 1:
                new.append((column, column + cell.span, cell.down))
            column += cell.span
        reaching = sorted((start, end, left - 1) for start, end, left in reaching + new if left > 1)
        yield out


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Cells side by side, line by line, padded to the width of their columns (at most ``MAX_PAD``; longer cells stay whole)."""
    grid = list(placed(rows))
    widths: dict[int, int] = {}
    for row in grid:
        for column, cell in row:
            if cell.span == 1:
                widths[column] = max(widths.get(column, 0), min(MAX_PAD, max(map(len, cell.lines), default=0)))
    most = MAX_PAD * 4

    def across(start: int, end: int) -> int:
        gaps = 2 * (end - start - 1)
        return most if gaps >= most else min(most, gaps + sum(widths.get(c, 0) for c in range(start, end)))

    out = []
    for row in grid:
        parts: list[tuple[int, list[str]]] = []
        column = 0
        for start, cell in row:
            if start > column:
                parts.append((across(column, start), []))
            parts.append((across(start, start + cell.span), cell.lines))
            column = start + cell.span
        height = max((len(lines) for _, lines in parts), default=0)
        for k in range(height):
            line = "  ".join((lines[k] if k < len(lines) else "").ljust(width) for width, lines in parts).rstrip()
            if line or height > 1:
                out.append(line)
    return out


def render(html: str) -> str:
    """All visible text of a page, one block a line, with blank lines where the layout has space."""
    page = Page()
    for kind, name, body in tokens(html, page.foreign):
        if kind == "start":
            page.start(name, body)
        elif kind == "end":
            page.end(name)
        elif kind == "text" or page.stack[-1].visible:
            page.text(body)
    return page.finish()


def extract_text(pages: DataFrame, html: str | Column = "html", out: str = "text") -> DataFrame:
    """``pages`` with the rendered text of the whole page in column ``out`` (replaced if it exists).

    A null or empty page renders to an empty text. Rows are independent of each other.
    """
    ship(pages.sparkSession)

    @F.arrow_udf("string")
    def visible(column: pa.Array) -> pa.Array:
        return pa.array([render(x.as_py()) for x in column], pa.string())

    return pages.withColumn(out, visible(whole(html)))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page, laid out."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", F.length("text").cast("long").alias("n_chars"), F.size(F.filter(F.split("text", "\n", -1), lambda x: x != "")).cast("long").alias("n_lines"), "text")
