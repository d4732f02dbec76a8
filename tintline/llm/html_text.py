"""HTML extraction: all visible text, laid out."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of elements, as the HTML standard lists them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist desc defs metadata".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary"
    " table caption tbody td textarea tfoot th thead tr ul xmp".split()
)
#: Blocks with a blank line before and after.
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu dir xmp".split())
#: A start tag of the key ends an open element of the first set, but not beyond one of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption"}, {"table"}),
    "option": ({"option"}, {"select", "optgroup"}),
    "body": ({"head"}, set()),
}
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "textarea"}
P_SCOPE = {"table", "td", "th", "caption", "button", "object"}
#: Elements that may stand in a head; any other opens the body.
IN_HEAD = frozenset("head title meta link base script style noscript template html".split())

MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?", re.S
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NO_DISPLAY = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


@dataclass(slots=True)
class Element:
    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    visible: bool = True  # its own text; a descendant may be visible again

    @property
    def hidden(self) -> bool:
        a = self.attributes
        return (
            self.tag in HIDDEN
            or "hidden" in a
            or (self.tag == "dialog" and "open" not in a)
            or ("style" in a and bool(NO_DISPLAY.search(a["style"])))
        )


def attributes(source: str) -> dict[str, str]:
    found = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


class OpenElements:
    """The elements that a tag may close, with the places of each tag, so that no search walks the stack."""

    def __init__(self, root: Element) -> None:
        self.stack, self.places = [root], {}

    @property
    def last(self) -> Element:
        return self.stack[-1]

    def push(self, element: Element) -> None:
        self.places.setdefault(element.tag, []).append(len(self.stack))
        self.stack.append(element)

    def pop(self) -> None:
        self.places[self.stack.pop().tag].pop()

    def _highest(self, tags) -> int:
        return max((places[-1] for t in tags if (places := self.places.get(t))), default=0)

    def end(self, tags, scope) -> None:
        """Close the last element of ``tags`` and all in it, but not beyond one of ``scope``."""
        place = self._highest(tags)
        if place > self._highest(scope):
            while len(self.stack) > place:
                self.pop()


def tree(html: str) -> Element:
    """Elements and text, with the tags that HTML lets be left out."""
    root = Element("#root")
    opened, at, length = OpenElements(root), 0, len(html)

    def text(value: str) -> None:
        if value:
            if opened.last.tag == "head" and value.strip():
                opened.pop()
            if opened.last.visible:
                opened.last.children.append(unescape(value))

    while at < length:
        found = MARKUP.search(html, at)
        if not found:
            text(html[at:])
            break
        text(html[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag == "br":
                opened.last.children.append(Element("br"))
            else:
                opened.end({tag}, P_SCOPE - {tag} if tag not in BLOCK else {"table"} - {tag})
            continue
        if opened.last.tag == "head" and tag not in IN_HEAD:
            opened.pop()
        if tag in ENDS_P:
            opened.end({"p"}, P_SCOPE)
        if tag in ENDS:
            for _ in range(4 if tag == "tr" or tag.startswith("t") and tag != "td" and tag != "th" else 1):
                opened.end(*ENDS[tag])
        own = attributes(found[3]) if found[3] else {}
        shown = VISIBILITY.search(own.get("style", ""))
        element = Element(tag, own, [], shown[1].lower() == "visible" if shown else opened.last.visible)
        opened.last.children.append(element)
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            if tag in ("textarea", "xmp") and element.visible:
                raw = html[at : close.start() if close else length]
                element.children.append(unescape(raw) if tag == "textarea" else raw)
            at = close.end() if close else length
        elif tag not in VOID and (not found[3].endswith("/") or tag in BLOCK):  # a slash closes only void and unknown elements
            opened.push(element)
    return root


class Layout:
    """Lines of text; blank lines between spaced blocks are at most one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the line that is being filled
        self.gap = False  # a blank is due before the next word
        self.blank = False  # a blank line is due before the next line
        self.fresh = True  # no line yet in the innermost indented block
        self.margin: list[str] = []  # what lines begin with, block by block
        self.marks: list[int] = []  # blocks whose mark awaits its line

    def words(self, text: str) -> None:
        pieces = SPACE.split(text)
        if pieces[0] == "" and len(pieces) > 1:
            self.gap = True
        body = " ".join(p for p in pieces if p)
        if not body:
            return
        self.parts.append((" " if self.gap and self.parts else "") + body)
        self.gap = pieces[-1] == "" and len(pieces) > 1

    def close(self) -> None:
        if self.parts:
            self.put("".join(self.parts))
        self.parts, self.gap = [], False

    def put(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = self.fresh = False
        self.lines.append(("".join(self.margin) + line).rstrip())
        while self.marks:
            k = self.marks.pop()
            self.margin[k] = " " * len(self.margin[k])

    def space(self) -> None:
        self.close()
        if not self.fresh:
            self.blank = True

    def indent(self, mark: str) -> tuple[bool, bool]:
        """Begin a block whose first line has ``mark`` and the others as many blanks before them."""
        self.close()
        held = self.blank, self.fresh
        self.fresh = True
        if mark.strip():
            self.marks.append(len(self.margin))
        self.margin.append(mark)
        return held

    def outdent(self, held: tuple[bool, bool]) -> None:
        self.close()
        if self.marks and self.marks[-1] == len(self.margin) - 1:
            self.marks.pop()
        self.margin.pop()
        if self.fresh:  # nothing came: as if the block weren't there
            self.blank, self.fresh = held
        else:
            self.blank = False


# The renderers are generators: each yields the one of a part that it needs done, and
# ``done`` keeps them on a list of its own, so that depth is bounded by memory alone.


def done(first: Iterator) -> None:
    waiting = [first]
    while waiting:
        part = next(waiting[-1], None)
        if part is None:
            waiting.pop()
        else:
            waiting.append(part)


def _render(element: Element, out: Layout, depth: int) -> Iterator:
    for child in element.children:
        if isinstance(child, str):
            out.words(child)
        elif not child.hidden:
            yield _element(child, out, depth)


def _element(e: Element, out: Layout, depth: int) -> Iterator:
    tag = e.tag
    if tag == "br":
        if out.parts:
            out.close()
        elif not out.fresh:
            out.blank = True
        return
    if tag not in BLOCK:
        yield _render(e, out, depth)
        return
    nested = tag in ("ul", "ol", "menu", "dir", "dl") and depth > 0
    spaced = tag in SPACED and not nested
    out.space() if spaced else out.close()
    if tag in ("pre", "xmp", "textarea"):
        body = _plain(e).strip("\n")
        for line in body.split("\n") if body else ():
            out.put(line.rstrip())
    elif tag == "table":
        yield _table(e, out)
    elif tag in ("ul", "ol", "menu", "dir"):
        yield _list(e, out, depth)
    elif tag in ("dd", "blockquote"):
        held = out.indent("    ")
        yield _render(e, out, 0 if tag == "blockquote" else depth)
        out.outdent(held)
    elif tag == "details" and "open" not in e.attributes:
        summary = next((c for c in e.children if not isinstance(c, str) and c.tag == "summary" and not c.hidden), None)
        if summary:
            yield _element(summary, out, depth)
    elif tag == "optgroup" and "label" in e.attributes:
        out.words(e.attributes["label"])
        out.close()
        yield _render(e, out, depth)
    else:
        yield _render(e, out, depth)
    out.space() if spaced else out.close()


def _list(e: Element, out: Layout, depth: int) -> Iterator:
    start = e.attributes.get("start", "")
    number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for child in e.children:
        if isinstance(child, str):
            out.words(child)
        elif child.hidden:
            continue
        elif child.tag == "li":
            held = out.indent(f"{number}. " if e.tag == "ol" else "- ")
            number += 1
            yield _render(child, out, depth + 1)
            out.outdent(held)
        else:
            yield _element(child, out, depth + 1)
    out.close()


def _plain(e: Element) -> str:
    """Text as it stands; ``br`` is a line break."""
    found, waiting = [], [e]
    while waiting:
        part = waiting.pop()
        if isinstance(part, str):
            found.append(part)
        elif part.tag == "br":
            found.append("\n")
        elif part is e or not part.hidden:
            waiting.extend(reversed(part.children))
    return "".join(found)


def _span(e: Element, name: str) -> int:
    value = e.attributes.get(name, "")
    return int(value) if re.fullmatch(r"\d{1,18}", value) else 1


@dataclass(slots=True)
class Cell:
    lines: list[str]
    begin: int  # columns from here
    end: int  # up to here
    rows: float  # that it reaches over


def _placed(row: list[tuple[list[str], int, float]], above: list[Cell]) -> list[Cell]:
    """The row's cells in the columns that cells from above, in their order, leave free."""
    found, at, k = [], 0, 0
    for lines, span, rows in row:
        while k < len(above) and above[k].begin <= at:
            at, k = max(at, above[k].end), k + 1
        found.append(Cell(lines, at, at + span, rows))
        at += span
    return found


def _table(e: Element, out: Layout) -> Iterator:
    """Captions, then rows: each cell in a column as wide as its widest text."""
    rows: list[list[tuple[list[str], int, float]]] = []

    def row_of(cells: list) -> Iterator:
        found: list[tuple[list[str], int, float]] = []
        rows.append(found)
        for c in cells:
            if isinstance(c, str):
                if c.strip():
                    out.words(c)
            elif c.hidden:
                continue
            elif c.tag in ("td", "th"):
                inner = Layout()
                yield _render(c, inner, 1)
                inner.close()
                found.append((inner.lines or [""], max(1, _span(c, "colspan")), _span(c, "rowspan") or float("inf")))
            else:
                yield _element(c, out, 1)

    def walk(part: Element) -> Iterator:
        for c in part.children:
            if isinstance(c, str):
                if c.strip():
                    out.words(c)
            elif c.hidden:
                continue
            elif c.tag == "tr":
                yield row_of(c.children)
            elif c.tag in ("tbody", "thead", "tfoot"):
                yield walk(c)
            elif c.tag in ("td", "th"):
                yield row_of([c])
            else:
                yield _element(c, out, 1)
                out.close()

    yield walk(e)
    out.close()
    placed, above = [], []
    for row in rows:
        cells = _placed(row, above)
        placed.append(cells)
        above = sorted((Cell(c.lines, c.begin, c.end, c.rows - 1) for c in above + cells if c.rows > 1), key=lambda c: c.begin)
    # columns in which no cell begins or ends need no room of their own
    edges = sorted({x for cells in placed for c in cells for x in (c.begin, c.end)})
    column = {x: k for k, x in enumerate(edges)}
    widths = [0] * len(edges)
    for cells in placed:
        for c in cells:
            if column[c.end] - column[c.begin] == 1:
                widths[column[c.begin]] = max(widths[column[c.begin]], *(len(x) + 2 for x in c.lines))
    left = [0]
    for w in widths:
        left.append(left[-1] + w)
    for cells in placed:
        for i in range(max((len(c.lines) for c in cells), default=0)):
            parts, at = [], 0
            for c in cells:
                if i < len(c.lines) and c.lines[i]:
                    gap = max(left[column[c.begin]] - at, 2 if at else 0)
                    parts += [" " * gap, c.lines[i]]
                    at += gap + len(c.lines[i])
            line = "".join(parts)
            if line.strip():
                out.put(line.rstrip())


def html_to_text(html: str) -> str:
    out = Layout()
    done(_render(tree(html), out, 0))
    out.close()
    return "\n".join(out.lines)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """All visible text of every page, laid out: page_id, text.

    The tree has the tags that HTML lets be left out. Not shown: the head, scripts,
    styles, templates, embedded media, closed dialogs and details (but their summary),
    elements with ``hidden`` or a style of display: none, and the text of those with
    visibility: hidden, in which descendants may be visible again. Options, text areas and
    text in drawings are shown; values of input fields are attributes and aren't.
    Blocks are lines of their own, paragraphs, headings, lists and tables with a blank line
    around. List items have a dash or number and are indented by depth; a table's cells
    stand in columns, also where they reach over several columns or rows. White space is
    one blank but in ``pre`` and its like.

    One row per row of ``pages``; a null page has a null text, an empty one an empty
    text. Broken markup is read as far as it goes: an unclosed comment or script ends
    with the page. Depth is bounded by memory alone, and time grows with the page and the
    text that comes of it. Repeated rows and null ids are read like others; other columns
    are not read. Rows don't move between executors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                texts = [None if x is None else html_to_text(x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    narrow = pages.select(F.col(id_col), F.col(html_col).cast("string"))
    return narrow.mapInArrow(run, f"`{id_col}` {narrow.dtypes[0][1]}, text string")
