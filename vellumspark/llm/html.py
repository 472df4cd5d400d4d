"""Layout-aware text of HTML pages.

A tree builder supplies the tags that HTML lets authors leave out (paragraphs, list items, table
rows and sections end by what follows them), visibility rules prune what a browser would not
show, and a renderer writes the rest as text: blocks on lines of their own, blank lines where
they have margins, lists with bullets or numbers and indents, table cells in aligned columns,
preformatted text as it stands. Of drawings (SVG) the text elements are written, each a word apart,
of formulas (MathML) all but their annotations; neither is laid out, and ``use`` is not followed.

Pages are rendered where they are scanned: no shuffle, memory bounded by a block of pages and
the tree of one page. Neither builder nor renderer recurses, so depth is no limit.

Two parameters shape the layout and lose no text: a cell longer than ``widest`` does not widen its
column, and lists and quotes nested deeper than ``deepest`` stand at that level's indent. None lifts
either; then one long cell or deep nest pads every line near it, and output may grow with the
square of the page, which is why neither is the default.

Defined results: a null or empty page has the empty text; very long pages, wide tables and great spans
take time in proportion to the page and to what is written; repeated rows are rendered one by one;
further columns, whatever their names, are not read; an empty table gives an empty table. Nothing is ranked, so there are
no ties: text follows the order of the page.
"""

from __future__ import annotations

import re
from bisect import insort
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellumspark.llm.common import blocks

# Fixed values of HTML: element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MARGIN = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table blockquote pre figure fieldset hr".split())
BLOCK = MARGIN | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary tbody td tfoot th thead tr".split())
HIDDEN = frozenset("head title script style template noscript meta link datalist audio video canvas iframe object noframes area param source track base rp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that leave an open head open.
HEAD_ONLY = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
#: SVG and MathML: roots, elements whose kids are HTML again, start tags that end them, elements that are not drawn.
FOREIGN = frozenset(("svg", "math"))
HTML_AGAIN = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAK_OUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
UNDRAWN = frozenset("annotation annotation-xml mphantom defs desc metadata symbol clippath mask marker pattern filter lineargradient radialgradient".split())
#: MathML elements whose parts stand apart.
APART = frozenset("mfrac msup msub msubsup munder mover munderover mmultiscripts mroot mtable mtr mlabeledtr".split())
SECTIONS = frozenset(("thead", "tbody", "tfoot"))
CELLS = frozenset(("td", "th"))
#: Ends of the search for an open element that a start tag closes.
SCOPES = frozenset("html table td th caption template button object marquee applet foreignobject".split())
#: What a start tag closes, up to the given boundary.
CLOSES = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "option": (frozenset(("option",)), frozenset(("select", "datalist"))),
    "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "rt": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    "rp": (frozenset(("rt", "rp")), frozenset(("ruby",))),
    "tr": (frozenset(("tr", "caption", "colgroup")), frozenset(("table",))),
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    **dict.fromkeys(SECTIONS | {"caption", "colgroup"}, (SECTIONS | {"caption", "colgroup"}, frozenset(("table",)))),
}
WHITE = re.compile(r"[ \t\n\r\f]+")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
#: The longest cell that widens its column, and the levels of lists and quotes that indent, unless told otherwise.
WIDEST, DEEPEST = 80, 40


class Node:
    """An element; ``kind`` is svg or math inside those, ``inner`` the kind of its kids, ``words`` whether text in it is drawn."""

    __slots__ = ("attrs", "inner", "kids", "kind", "tag", "words")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None = None):
        self.tag, self.attrs, self.kids = tag, attrs, []
        self.kind = tag if tag in FOREIGN else parent.inner if parent else ""
        self.inner = "" if tag in HTML_AGAIN else self.kind
        self.words = self.kind != "svg" or tag in ("text", "foreignobject") or tag in ("tspan", "textpath", "a") and parent.kind == "svg" and parent.words


class TreeBuilder(HTMLParser):
    """Builds the tree of a page; ``root`` holds it after ``close``."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]
        self.counts = Counter({"html": 1})

    def push(self, tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs, self.place())
        self.place().kids.append(node)
        self.open.append(node)
        self.counts[tag] += 1

    def place(self) -> Node:
        return self.open[-1]

    def pop_to(self, k: int) -> None:
        for node in self.open[k:]:
            self.counts[node.tag] -= 1
        del self.open[k:]

    def find(self, tags: frozenset, scopes: frozenset) -> int:
        """The innermost open element of ``tags`` inside ``scopes``, or 0."""
        if any(self.counts[t] for t in tags):
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in tags:
                    return k
                if self.open[k].tag in scopes:
                    break
        return 0

    def close_implied(self, tag: str) -> None:
        if tag in CLOSES:
            tags, scopes = CLOSES[tag]
            # The outermost one of a kind that may nest in each other (a cell inside its row) goes.
            while k := self.find(tags, scopes):
                self.pop_to(k)
        if tag in BLOCK and tag not in CELLS and (k := self.find(frozenset(("p",)), SCOPES)):
            self.pop_to(k)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop_to(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list, closed: bool = False) -> None:
        values = {k: v or "" for k, v in reversed(attrs)}
        if self.place().inner and (tag in BREAK_OUT or tag == "font" and not values.keys().isdisjoint(("color", "face", "size"))):
            k = len(self.open)
            while self.open[k - 1].inner:
                k -= 1
            self.pop_to(k)
        if self.place().inner:
            self.push(tag, values)
            if closed:
                self.pop_to(len(self.open) - 1)
            return
        if tag in ("html", "body"):
            self.root.attrs = {**values, **self.root.attrs}
            if tag == "body" and (k := self.find(frozenset(("head",)), frozenset())):
                self.pop_to(k)
            return
        ends_head = tag in BLOCK or self.place().tag == "head" and tag not in HEAD_ONLY
        if self.counts["head"] and ends_head and (k := self.find(frozenset(("head",)), frozenset())):
            self.pop_to(k)
        self.close_implied(tag)
        if tag in CELLS and self.counts["table"] and not self.find(frozenset(("tr",)), frozenset(("table",))):
            self.handle_starttag("tr", [])
        if tag == "tr" and self.counts["table"] and not self.find(SECTIONS, frozenset(("table",))):
            k = self.find(frozenset(("table",)), frozenset())
            self.pop_to(k + 1)
            self.push("tbody", {})
        if tag in VOID:
            self.place().kids.append(Node(tag, values))
        else:
            self.push(tag, values)
            if closed and tag in FOREIGN:
                self.pop_to(len(self.open) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs, closed=True)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br" or tag == "p" and not self.find(frozenset(("p",)), SCOPES):
            return self.handle_starttag("br" if tag == "br" else "p", []) if tag == "br" else None
        if tag in ("html", "body") or not self.counts[tag]:
            return None
        k = self.find(frozenset((tag,)), frozenset() if tag == "table" else SCOPES - {tag})
        if k and (tag in BLOCK or k == len(self.open) - 1 or not any(n.tag in BLOCK for n in self.open[k:])):
            self.pop_to(k)
        elif k:
            # An inline element that ends inside a block: the block stays open.
            self.counts[tag] -= 1
            del self.open[k]
        return None

    def unknown_decl(self, data: str) -> None:
        if self.place().kind and data.startswith("CDATA["):
            self.handle_data(data[6:])

    def handle_data(self, data: str) -> None:
        if self.place().tag == "head" and data.strip(" \t\n\r\f"):
            self.pop_to(len(self.open) - 1)
        kids = self.place().kids
        if kids and isinstance(kids[-1], str):
            kids.append(kids.pop() + data) if len(kids[-1]) < 4096 else kids.append(data)
        else:
            kids.append(data)


def tree(page: str) -> Node:
    builder = TreeBuilder()
    builder.feed(page)
    builder.close()
    return builder.root


def visible(node: Node, parent: Node | None) -> bool:
    a = node.attrs
    if node.tag in HIDDEN or "hidden" in a and a["hidden"] != "until-found" or "style" in a and UNSEEN.search(a["style"]):
        return False
    if node.tag == "input" and a.get("type", "").lower() == "hidden" or node.tag == "dialog" and "open" not in a:
        return False
    if node.kind and (node.tag in UNDRAWN or a.get("display") == "none" or a.get("visibility") in ("hidden", "collapse")):
        return False
    if node.kind and parent.tag == "switch" and node is not next(k for k in parent.kids if isinstance(k, Node)):
        return False
    return not (parent and parent.tag == "details" and "open" not in parent.attrs and node.tag != "summary")


class Canvas:
    """Lines of text under construction, with the prefixes of the lists and quotes around them."""

    def __init__(self, deepest: int | None):
        self.deepest = deepest
        self.lines: list[str] = []
        self.inline: list[str] = []
        self.space = self.margin = False
        self.prefixes: list[list[str]] = []

    def text(self, data: str) -> None:
        words = WHITE.split(data)
        if len(words) == 1:
            if data:
                self.add(data)
            return
        for i, word in enumerate(words):
            self.space = self.space or i > 0
            if word:
                self.add(word)

    def add(self, word: str) -> None:
        if self.space and self.inline:
            self.inline.append(" ")
        self.space = False
        self.inline.append(word)

    def end_line(self, force: bool = False) -> None:
        if self.inline or force:
            self.line("".join(self.inline))
        self.inline, self.space = [], False

    def line(self, text: str) -> None:
        if self.margin and self.lines and self.lines[-1]:
            self.lines.append("")
        self.margin = False
        lead = "".join(p.pop(0) if len(p) > 1 else p[0] for p in (self.prefixes if self.deepest is None else self.prefixes[-self.deepest :]))
        self.lines.append((lead + text).rstrip())

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Table:
    """Cells by row and first column. What spans of earlier rows take is kept as intervals (first column, end, last row)."""

    def __init__(self):
        self.rows: list[dict[int, list[str]]] = []
        self.spans: list[tuple[int, int, int]] = []
        self.begun: list[tuple[int, int, int]] = []
        self.wide: set[tuple[int, int]] = set()
        self.column = self.near = 0

    def row(self) -> None:
        self.rows.append({})
        for span in self.begun:
            insort(self.spans, span)
        self.begun, self.column, self.near = [], 0, 0

    def free(self) -> int:
        """The next column of the row that no span takes; spans that have ended go on the way."""
        here = len(self.rows) - 1
        while self.near < len(self.spans) and self.spans[self.near][0] <= self.column:
            _, end, last = self.spans[self.near]
            if last < here:
                del self.spans[self.near]
            else:
                self.column = max(self.column, end)
                self.near += 1
        return self.column

    def cell(self, lines: list[str], attrs: dict[str, str]) -> None:
        if not self.rows:
            self.row()
        number = lambda k, most: min(most, max(1, int(v))) if re.fullmatch("[0-9]{1,9}", v := attrs.get(k, "").strip()) else 1
        here, c, across, down = len(self.rows) - 1, self.free(), number("colspan", 1000), number("rowspan", 65534)
        self.rows[-1][c] = lines
        self.column = c + across
        if across > 1:
            self.wide.add((here, c))
        if down > 1:
            self.begun.append((c, c + across, here + down - 1))

    def lines(self, widest: int | None) -> Iterator[str]:
        """The rows as text; columns in which no cell begins have no place."""
        widths = dict.fromkeys(sorted({c for row in self.rows for c in row}), 0)
        for r, row in enumerate(self.rows):
            for c, cell in row.items():
                if (r, c) not in self.wide:
                    widths[c] = max(widths[c], max((len(x) for x in cell if widest is None or len(x) <= widest), default=0))
        place = {c: k for k, c in enumerate(widths)}
        blank = [" " * n for n in widths.values()]
        for row in self.rows:
            tall = sorted(row, key=lambda c: len(row[c]))
            for k in range(max((len(x) for x in row.values()), default=0)):
                while len(row[tall[0]]) <= k:
                    tall.pop(0)
                out = blank[: max(place[c] for c in tall) + 1]
                for c in tall:
                    out[place[c]] = row[c][k].ljust(widths[c])
                yield " | ".join(out).rstrip()


def render(page: str | None, widest: int | None = WIDEST, deepest: int | None = DEEPEST) -> str:
    """The visible text of a page."""
    canvases, tables, lists = [Canvas(deepest)], [], []
    stack: list[tuple] = [("enter", tree(page or ""), None)]
    pre = 0
    while stack:
        what, node, parent = stack.pop()
        canvas = canvases[-1]
        if isinstance(node, str):
            if parent.tag == "details" and "open" not in parent.attrs:
                continue
            if parent.kind:
                # White space between elements is no part of a formula or drawing.
                if parent.words and (parent.kind == "svg" or not parent.inner or node.strip()):
                    canvas.text(node)
            elif pre:
                parts = node.replace("\r\n", "\n").split("\n")
                for i, part in enumerate(parts):
                    if i:
                        canvas.end_line(force=True)
                    if part:
                        canvas.inline.append(part)
            elif parent.tag not in ("table", "tr", "ul", "ol", "dl") and parent.tag not in SECTIONS or node.strip():
                canvas.text(node)
            continue
        tag = node.tag
        if what == "enter":
            if not visible(node, parent):
                continue
            if tag == "br":
                canvas.end_line(force=True)
                continue
            if node.kind and (tag in ("svg", "text") or parent.tag in APART):
                canvas.space = True
            if tag == "math" and node.attrs.get("display") == "block":
                canvas.end_line()
            if tag in BLOCK:
                canvas.end_line()
                canvas.margin = canvas.margin or (tag in MARGIN and not (tag in ("ul", "ol", "menu") and lists))
            if tag == "hr":
                canvas.margin = True
                continue
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start", "").strip()
                lists.append(int(start) if tag == "ol" and re.fullmatch("-?[0-9]{1,9}", start) else 1 if tag == "ol" else None)
            elif tag == "li":
                value = node.attrs.get("value", "").strip()
                if lists and lists[-1] is not None:
                    lists[-1] = int(value) if re.fullmatch("-?[0-9]{1,9}", value) else lists[-1]
                    mark = f"{lists[-1]}. "
                    lists[-1] += 1
                else:
                    mark = "- "
                canvas.prefixes.append([mark, " " * len(mark)])
            elif tag in ("dd", "blockquote"):
                canvas.prefixes.append(["  "])
            elif tag == "pre":
                pre += 1
            elif tag == "table":
                tables.append(Table())
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in CELLS and tables:
                canvases.append(Canvas(deepest))
                lists.append(None)
            elif tag == "q":
                canvas.add("“")
            elif tag == "input" and node.attrs.get("type", "text").lower() in ("submit", "button", "reset", "text"):
                canvas.text(" " + node.attrs.get("value", "") + " ")
            stack.append(("leave", node, parent))
            stack += [("enter", kid, node) for kid in reversed(node.kids)]
            continue
        if node.kind and (tag in ("svg", "text") or parent.tag in APART):
            canvas.space = True
        if tag == "math" and node.attrs.get("display") == "block":
            canvas.end_line()
        if tag == "pre":
            pre -= 1
        if tag == "q":
            canvas.inline.append("”")
        if tag in CELLS and tables:
            canvases.pop()
            lists.pop()
            tables[-1].cell(canvas.done(), node.attrs)
            continue
        if tag in BLOCK:
            canvas.end_line()
            canvas.margin = canvas.margin or (tag in MARGIN and not (tag in ("ul", "ol", "menu") and len(lists) > 1))
        if tag in ("ul", "ol", "menu"):
            lists.pop()
        elif tag == "li":
            if len(canvas.prefixes[-1]) > 1:
                canvas.line("")
            canvas.prefixes.pop()
        elif tag in ("dd", "blockquote"):
            canvas.prefixes.pop()
        elif tag == "table":
            table = tables.pop()
            canvas.margin = canvas.margin or bool(table.rows)
            for line in table.lines(widest):
                canvas.line(line)
            canvas.margin = True
    return "\n".join(canvases[0].done())


def html_text(df: DataFrame, id_col: str = "page_id", html: str = "html", widest: int | None = WIDEST, deepest: int | None = DEEPEST) -> DataFrame:
    """(id, text, n_chars, n_lines) of each page; ``widest`` and ``deepest`` as told above."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, 4 << 20):
            texts = [render(h, widest, deepest) for h in batch.column(1).to_pylist()]
            counts = [pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *counts], ["id", "text", "n_chars", "n_lines"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(html)).mapInArrow(run, "id long, text string, n_chars long, n_lines long")
    return rows.withColumnRenamed("id", id_col)
