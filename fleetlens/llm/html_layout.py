"""All visible text of HTML pages, laid out as it is read.

A tree builder adds the tags that HTML implies (a new list item, cell or row
ends the one before, a block ends a paragraph). Visibility rules then leave
out what a browser does not show. The rest is written line by line: white
space collapses, paragraphs and other spaced blocks have an empty line
between them, list items a marker and an indent, table cells the width of
their column. Every line of a cell begins where its column does. Lines longer
than COLUMN are folded between words, but for cells with nothing to their right
and for lines whose spaces matter. What is still longer (a word, a
preformatted line, a cell over several columns) stays whole, and what stands to
the right of it in its row goes on in the next line that has room.

The walk keeps its own stack, so nesting depth is bounded by memory only.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.bpe_codec import slices

# Element names by their role in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
ESCAPABLE_RAW = {"textarea", "title"}
UNSEEN = set(
    "head title script style template noscript noframes noembed iframe object video audio canvas datalist rp link meta base".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre xmp hr figure fieldset".split())
BLOCK = SPACED | set(
    "html body address article aside center dd details dialog dir div dt figcaption footer form header hgroup legend li listing main nav optgroup option search section summary caption".split()
)
ENDS_PARAGRAPH = (BLOCK - {"html", "body", "option", "optgroup", "caption", "legend"}) | {"table"}
#: What a start tag ends, and within which elements it looks for it.
IMPLIED_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
SCOPES = {"table", "td", "th", "caption", "template", "html"}
LISTS = {"ul", "ol", "menu", "dir"}
#: Widest table column: longer lines are folded, or later cells stand below them.
COLUMN = 60
MOST_COLSPAN, MOST_ROWSPAN = 1000, 65534

_SPACE = " \t\n\f\r"
# Possessive, so that no page makes it try again; a tag cut off by the page's end is dropped.
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|</([a-zA-Z][^\s/>]*+)[^>]*+>?"
    r"|<([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')|[=\"'])*+)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


class Element:
    __slots__ = ("children", "attributes", "tag")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw) if raw.strip() else ():
        out.setdefault(name.lower(), html.unescape("".join(values)))
    return out


def build_tree(page: str) -> Element:
    """The page's elements, with implied start and end tags resolved."""
    root = Element("html", {})
    stack, opened = [root], Counter()

    def push(element: Element) -> None:
        stack[-1].children.append(element)
        stack.append(element)
        opened[element.tag] += 1

    def pop_to(k: int) -> None:
        opened.subtract(e.tag for e in stack[k:])
        del stack[k:]

    def find(names: set[str], stops: set[str]) -> int:
        if not any(opened[n] for n in names):
            return 0
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                return k
            if stack[k].tag in stops:
                break
        return 0

    def text(raw: str, escaped: bool = True) -> None:
        if raw:
            stack[-1].children.append(html.unescape(raw) if escaped and "&" in raw else raw)

    at = 0
    while m := _TOKEN.search(page, at):
        text(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            # An inline end tag does not end the block around it, no end tag a table cell around it.
            stops = SCOPES if tag in BLOCK or tag in SCOPES else SCOPES | BLOCK
            stops = {"table"} if tag in ("td", "th", "tr", "thead", "tbody", "tfoot", "caption") else set() if tag == "table" else stops
            k = find({tag}, stops - {tag})
            if k:
                pop_to(k)
            elif tag in ("br", "p"):  # stray, they show as empty elements
                stack[-1].children.append(Element(tag, {}))
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "html":
            continue
        ends, within = IMPLIED_ENDS.get(tag, ((), ()))
        while ends and (k := find(ends, within | ({"table"} if tag not in ("td", "th", "tr") else set()))):
            pop_to(k)
        if tag in ENDS_PARAGRAPH and (k := find({"p"}, SCOPES)):
            pop_to(k)
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            push(Element("tr", {}))
        element = Element(tag, _attributes(m[3]))
        if tag in VOID:
            stack[-1].children.append(element)
            continue
        push(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
            text(page[at : end.start() if end else len(page)], tag in ESCAPABLE_RAW)
            pop_to(len(stack) - 1)
            at = end.end() if end else len(page)
    text(page[at:])
    return root


def _style(element: Element) -> dict[str, str]:
    style = element.attributes.get("style", "")
    if ":" not in style:
        return {}
    pairs = (d.partition(":") for d in re.sub(r"/\*.*?\*/", "", style, flags=re.S).lower().split(";"))
    return {k.strip(): re.sub(r"\s*!important\s*$", "", v).strip() for k, _, v in pairs}


def shown(element: Element, parent: Element, visible: bool) -> tuple[bool, bool]:
    """(whether the element has a box, whether its text is visible), given those of its parent."""
    given = element.attributes
    if element.tag in UNSEEN or "hidden" in given or (element.tag == "dialog" and "open" not in given):
        return False, False
    if element.tag == "input" and given.get("type", "").lower() == "hidden":
        return False, False
    if parent.tag == "details" and "open" not in parent.attributes and element.tag != "summary":
        return False, False
    style = _style(element)
    if style.get("display") == "none":
        return False, False
    return True, {"hidden": False, "collapse": False, "visible": True}.get(style.get("visibility", ""), visible)


def _number(text: str | None, default: int) -> int:
    found = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return int(found[1]) if found else default


class Lines:
    """Text laid out in lines: collapsed white space, gaps between blocks, indents and markers."""

    def __init__(self):
        self.lines: list[str] = []
        self._line: list[str] = []
        self._space = self._gap = False
        self.indent, self.marker = "", None

    def text(self, text: str, keep: bool) -> None:
        if keep:
            first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self._add(first)
            for line in rest:
                self.new_line(force=True)
                self._add(line)
            return
        words = text.strip(_SPACE)
        if not words:
            self._space = self._space or bool(text and self._line)
            return
        if (self._space or text[0] in _SPACE) and self._line:
            self._line.append(" ")
        self._add(re.sub(f"[{_SPACE}]+", " ", words))
        self._space = text[-1] in _SPACE

    def _add(self, text: str) -> None:
        if text:
            self._line.append(text)

    def new_line(self, force: bool = False) -> None:
        if self._line or force:
            self._emit("".join(self._line))
        self._line, self._space = [], False

    def _emit(self, line: str) -> None:
        if self._gap and self.lines:
            self.lines.append("")
        self._gap = False
        lead, self.marker = self.indent if self.marker is None else self.marker, None
        self.lines.append((lead + line).rstrip())

    def block(self, spaced: bool) -> None:
        """The edge of a block; a spaced one leaves an empty line, once."""
        self.new_line()
        self._gap = self._gap or spaced

    def whole(self, lines: list[str]) -> None:
        self.new_line()
        for line in lines:
            self._emit(line)

    def done(self) -> list[str]:
        self.new_line()
        return self.lines


def fold(line: str) -> list[str]:
    """The line in pieces of COLUMN characters at most, divided between words; longer words stay whole."""
    words = line.lstrip(" ")
    if len(line) <= COLUMN or "  " in words:
        return [line]
    lead = line[: len(line) - len(words)]
    out = [""]
    for word in words.split(" "):
        if out[-1] and len(lead) + len(out[-1]) + 1 + len(word) > COLUMN:
            out.append("")
        out[-1] += f" {word}" if out[-1] else word
    return [lead + piece for piece in out]


class Table:
    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []  # of (first column, columns, lines)
        self._column, self._held = 0, {}  # columns that cells of earlier rows still fill

    def row(self) -> None:
        self.rows.append([])
        self._column = 0
        self._held = {c: n - 1 for c, n in self._held.items() if n > 1}

    def cell(self, lines: list[str], across: int, down: int) -> None:
        if not self.rows:
            self.row()
        while self._column in self._held:
            self._column += 1
        self.rows[-1].append((self._column, across, lines))
        for c in range(self._column, self._column + across):
            if down > 1:
                self._held[c] = down
        self._column += across

    def lines(self) -> list[str]:
        edge = max((c + across for row in self.rows for c, across, _ in row), default=0)
        rows = [
            [(c, across, lines if c + across == edge else [piece for line in lines for piece in fold(line)]) for c, across, lines in row] for row in self.rows
        ]
        widths: dict[int, int] = {}
        for row in rows:
            for c, across, lines in row:
                if across == 1:
                    widths[c] = min(COLUMN, max([widths.get(c, 0), *map(len, lines)]))
        # Where each column begins, two characters after the widest of the one before.
        starts, at = {}, 0
        for c in sorted({c for row in rows for c, _, _ in row}):
            starts[c] = at
            at += widths.get(c, 0) + 2
        out = []
        for row in rows:
            placed = [""] * max((len(lines) for _, _, lines in row), default=0)
            for c, _, lines in row:
                k = 0
                for line in lines:
                    if line:
                        while k < len(placed) and placed[k] and len(placed[k]) + 2 > starts[c]:
                            k += 1
                        placed += [""] * (k + 1 - len(placed))
                        placed[k] = placed[k].ljust(starts[c]) + line
                    k += 1
            out += [line.rstrip() for line in placed]
        return out


def render(root: Element) -> str:
    """The visible text of a tree, as lines."""
    out = Lines()
    # What is open: (outer lines, indent) of cells and lists, tables, list numbers.
    tables: list[Table] = []
    outer: list[Lines] = []
    numbers: list[int | None] = []
    indents: list[str] = []
    todo: list[tuple] = [("in", root, root, True, False)]
    while todo:
        step, element, parent, visible, keep = todo.pop()
        tag = element if step == "text" else element.tag
        if step == "text":
            if visible:
                out.text(element, keep)
            continue
        if step == "in":
            box, visible = shown(element, parent, visible)
            if not box:
                continue
            keep = keep or tag in ("pre", "xmp", "listing", "textarea")
            if tag == "br":
                if visible:
                    out.new_line(force=True)
                continue
            if tag == "table":
                out.block(True)
                tables.append(Table())
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in ("td", "th") and tables:
                outer.append(out)
                out = Lines()
            elif tag == "hr":
                out.block(True)
            elif tag in BLOCK:
                inner = tag in LISTS and bool(numbers)  # a list within a list has no gap
                out.block(tag in SPACED and not inner)
            if tag in LISTS:
                numbers.append(_number(element.attributes.get("start"), 1) if tag == "ol" else None)
            elif tag == "li":
                indents.append(out.indent)
                marker = "- "
                if numbers and numbers[-1] is not None:
                    numbers[-1] = _number(element.attributes.get("value"), numbers[-1])
                    marker = f"{numbers[-1]}. "
                    numbers[-1] += 1
                if visible:
                    out.marker = out.indent + marker
                out.indent += " " * len(marker)
            elif tag in ("blockquote", "dd"):
                indents.append(out.indent)
                out.indent += "  "
            todo.append(("out", element, parent, visible, keep))
            folded = tag == "details" and "open" not in element.attributes
            for child in reversed(element.children):
                text = isinstance(child, str)
                todo.append(("text" if text else "in", child, element, visible and not (text and folded), keep))
            continue
        if tag in ("td", "th") and tables and outer:
            cell, out = out, outer.pop()
            across = min(max(_number(element.attributes.get("colspan"), 1), 1), MOST_COLSPAN)
            down = min(max(_number(element.attributes.get("rowspan"), 1), 1), MOST_ROWSPAN)
            tables[-1].cell(cell.done(), across, down)
        elif tag == "table" and tables:
            out.whole(tables.pop().lines())
            out.block(True)
        elif tag in BLOCK:
            out.block(tag in SPACED and not (tag in LISTS and len(numbers) > 1))
        if tag in LISTS:
            numbers.pop()
        elif tag == "li":
            out.indent, out.marker = indents.pop(), None
        elif tag in ("blockquote", "dd"):
            out.indent = indents.pop()
    return "\n".join(out.done()).strip("\n")


def visible_text(page: str) -> str:
    return render(build_tree(page))


def extract(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id column, text) of every page: all its visible text, laid out.

    Table cells of any length are whole and aligned: their long lines are
    folded between words, and a longer word moves the cells right of it to a
    later line, in their columns.
    Null and empty pages, and pages that show nothing, have an empty text.
    Broken markup never fails: unclosed elements end with the page, stray end
    tags are left out. Pages of any length are read whole. Repeated rows and
    null ids are kept as they come; other columns are not read; an empty table
    gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [visible_text(t) if t else "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "text": pa.array(texts, pa.string())})

    kind = pages.schema[id_col].dataType.simpleString()
    source = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)
