"""Layout-aware text of HTML pages.

A tokenizer and a tree builder with implied tags give the element tree; rendering keeps
all visible text: blocks on lines of their own, paragraphs and headings apart, list items with
their marks and depth, table cells aligned in columns, preformatted text as it is. What a style hides
is left out, and what is made visible inside of it comes back.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|</(?P<end>[a-zA-Z][^\s/>]*+)[^>]*+>?"
    r"|<(?P<start>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<broken>[a-zA-Z][^\s/>]*+)(?P<rest>[^>]*+)>?",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*([a-z]+)", re.I)
NUMBER = re.compile(r"\s*([+-]?\d{1,9})")

# The element names of HTML by how they are parsed and shown.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes noscript".split())
UNSHOWN = set("area base datalist head iframe link meta noembed noframes noscript object param rp script style svg template title canvas audio video".split())
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure fieldset hr menu".split())
BLOCKS = PARAGRAPHS | set("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary tbody td tfoot th thead tr".split())
CLOSES_P = PARAGRAPHS | set("address article aside center details dialog dir div dd dt fieldset figcaption footer form header hgroup li main nav search section summary".split())
#: Start tag: open elements that it ends, and where looking for them stops.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "body": ({"head"}, set()),
    "rp": ({"rp", "rt"}, {"ruby"}),
    "rt": ({"rp", "rt"}, {"ruby"}),
}
#: Start tag: the parents it may stand in, and the element implied otherwise.
PARENTS = {"td": ({"tr"}, "tr"), "th": ({"tr"}, "tr"), "tr": ({"table", "thead", "tbody", "tfoot"}, None)}
SCOPE = {"table", "td", "th", "caption", "html", "button", "template"}
#: Tables nested more deeply, as no page is meant to, are shown as blocks: every level is a call within a call.
TABLE_DEPTH = 100
#: Columns and rows that a cell spans at most, by the standard.
MOST_COLUMNS, MOST_ROWS = 1000, 65534


class Element:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def parse(page: str) -> Element:
    """The tree of a page, however broken; the root is ``html``."""
    root = Element("html")
    stack, at, size = [root], 0, len(page)

    def open_from(names: set[str], stop: set[str]) -> int | None:
        """The outermost open element of ``names`` above the nearest one of ``stop``."""
        found = None
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in stop:
                break
            if stack[i].tag in names:
                found = i
        return found

    while at < size:
        found = TOKEN.search(page, at)
        stop = found.start() if found else size
        if stop > at:
            stack[-1].children.append(html.unescape(page[at:stop]))
        if not found:
            break
        at = found.end()
        if found["cdata"] is not None:
            stack[-1].children.append(found["cdata"])
        elif found["end"]:
            tag = found["end"].lower()
            if tag == "br":
                stack[-1].children.append(Element("br"))
                continue
            stops = SCOPE - {tag} if tag not in ("html", "body") else {"html", "body"}
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in stops and tag not in ("table", "tr", "thead", "tbody", "tfoot") or stack[i].tag == "table":
                    break
        elif tag := (found["start"] or found["broken"] or "").lower():
            attributes = {}
            for name, a, b, c in ATTRIBUTE.findall(found["attributes"] or found["rest"] or ""):
                attributes.setdefault(name.lower(), html.unescape(a or b or c))
            if tag == "html":
                root.attributes = {**attributes, **root.attributes}
                continue
            if tag in CLOSES_P and (i := open_from({"p"}, SCOPE)) is not None:
                del stack[i:]
            if tag in IMPLIED and (i := open_from(*IMPLIED[tag])) is not None:
                del stack[i:]
            if tag in PARENTS and stack[-1].tag not in PARENTS[tag][0] and PARENTS[tag][1] and open_from({"table"}, set()) is not None:
                row = Element(PARENTS[tag][1])
                stack[-1].children.append(row)
                stack.append(row)
            if stack[-1].tag == "head" and (tag in BLOCKS or tag in ("a", "span", "b", "i", "img", "br")):
                del stack[-1]
            element = Element(tag, attributes)
            stack[-1].children.append(element)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*+>?", re.I).search(page, at)
                text = page[at:close.start() if close else size]
                element.children.append(html.unescape(text) if tag in ("textarea", "title") else text)
                at = close.end() if close else size
            elif tag not in VOID and not (found[0].endswith("/>") and tag not in BLOCKS):
                stack.append(element)
    return root


class Lines:
    """Text under way: white space collapsed, gaps between blocks, a prefix before each line."""

    def __init__(self):
        self.out: list[str] = []
        self.gap, self.space, self.prefix, self.mark = 0, False, "", ""

    def block(self, lines: int) -> None:
        self.gap, self.space = max(self.gap, lines), False

    def _begin(self) -> None:
        if self.gap and self.out:
            self.out.append("\n" * self.gap)
        if self.gap or not self.out:
            self.out.append(self.prefix + self.mark)
            self.mark = ""
        elif self.space:
            self.out.append(" ")
        self.gap, self.space = 0, False

    def inline(self, text: str) -> None:
        words = text.split()
        if not words:
            self.space = self.space or bool(text)
            return
        self.space = self.space or text[0].isspace()
        self._begin()
        self.out.append(" ".join(words))
        self.space = text[-1].isspace()

    def whole(self, text: str) -> None:
        """Lines as they are."""
        for i, line in enumerate(text.split("\n")):
            if i:
                self.gap += 1
                self.space = False
            if line.strip():
                self._begin()
                self.out.append(line.rstrip())

    def text(self) -> str:
        return "".join(self.out)


def displayed(element: Element) -> bool:
    """Whether the element has a place on the page."""
    a = element.attributes
    return not (element.tag in UNSHOWN or "hidden" in a or (element.tag == "dialog" and "open" not in a) or NOT_SHOWN.search(a.get("style", "")))


def visibility(element: Element, inherited: bool) -> bool:
    """Whether the element's own text is seen: children of a hidden element may be visible again."""
    found = VISIBILITY.findall(element.attributes.get("style", ""))
    return {"visible": True, "hidden": False, "collapse": False}.get(found[-1].lower(), inherited) if found else inherited


def number(element: Element, name: str, otherwise: int) -> int:
    found = NUMBER.match(element.attributes.get(name, ""))
    return int(found[1]) if found else otherwise


def mark_of(kind: str, n: int) -> str:
    """An ordered list's number in the style of its ``type``."""
    if kind in ("a", "A") and n > 0:
        out = ""
        while n:
            n, digit = divmod(n - 1, 26)
            out = chr(ord(kind) + digit) + out
        return out
    if kind in ("i", "I") and 0 < n < 4000:
        out = ""
        for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
            out += sign * (n // value)
            n %= value
        return out if kind == "i" else out.upper()
    return str(n)


def chosen(select: Element) -> list[Element]:
    """What a select shows: its selected options, else, unless it lists several, the first."""
    options, work = [], list(reversed(select.children))
    while work:
        node = work.pop()
        if isinstance(node, Element) and node.tag == "option":
            options.append(node)
        elif isinstance(node, Element) and node.tag == "optgroup":
            work += reversed(node.children)
    marked = [o for o in options if "selected" in o.attributes]
    if "multiple" in select.attributes or number(select, "size", 1) > 1:
        return options
    return marked[-1:] or options[:1]


def width_of(text: str) -> int:
    """Columns that a text takes: two for wide characters, none for combining ones."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def render(root: Element, table_depth: int = 0, seen: bool = True) -> str:
    lines = Lines()
    lists: list[list] = []  # of each open list: its kind, the next number, the step, the type of its marks
    work: list[tuple[str, object, bool]] = [("open", root, seen)]
    while work:
        what, node, seen = work.pop()
        if what == "call":
            node()
        elif isinstance(node, str):
            if seen:
                lines.whole(node) if what == "pre" else lines.inline(node)
        elif displayed(node):
            seen = visibility(node, seen)
            tag, pre = node.tag, what == "pre" or node.tag in ("pre", "listing", "textarea")
            if tag == "br":
                lines.gap, lines.space = lines.gap + 1, False
                continue
            if tag == "img":
                continue
            if tag == "table" and table_depth < TABLE_DEPTH:
                lines.block(2)
                lines.whole(_table(node, table_depth, seen))
                lines.block(2)
                continue
            gap = (2 if tag in PARAGRAPHS and not (tag in ("ul", "ol", "menu") and lists) else 1) if tag in BLOCKS else 0
            if gap:
                lines.block(gap)
            prefix, mark = lines.prefix, lines.mark
            undo = []
            if tag in ("ul", "ol", "menu"):
                back = "reversed" in node.attributes
                items = sum(isinstance(c, Element) and c.tag == "li" and displayed(c) for c in node.children)
                lists.append([tag, number(node, "start", items if back else 1), -1 if back else 1, node.attributes.get("type", "1")])
                undo.append(lists.pop)
            elif tag == "li":
                kind = lists[-1] if lists else ["ul", 1, 1, ""]
                kind[1] = number(node, "value", kind[1])
                lines.prefix = "  " * max(0, len(lists) - 1) + ("" if prefix[:1] != ">" else prefix)
                lines.mark = f"{mark_of(kind[3], kind[1])}. " if kind[0] == "ol" else "- "
                kind[1] += kind[2]
            elif tag == "blockquote":
                lines.prefix = prefix + "> "
            elif tag == "dd":
                lines.prefix = prefix + "  "

            def close(gap=gap, prefix=prefix, mark=mark, undo=undo, tag=tag):
                for f in undo:
                    f()
                if gap:
                    lines.block(gap)
                if tag in ("li", "blockquote", "dd"):
                    lines.prefix, lines.mark = prefix, mark if tag != "li" else ""

            work.append(("call", close, seen))
            children = node.children
            if tag == "details" and "open" not in node.attributes:
                children = [c for c in children if isinstance(c, Element) and c.tag == "summary"][:1]
            elif tag == "select":
                children = chosen(node)
            work += [("pre" if pre else "open", c, seen) for c in reversed(children)]
    return lines.text()


def _cell(cell: Element, depth: int, seen: bool) -> list[str]:
    """A cell's text: one line, unless it has preformatted text, whose lines stay."""
    inner = Element("span", {"style": cell.attributes.get("style", "")})
    inner.children = cell.children
    text = render(inner, depth + 1, seen)
    work = list(cell.children)
    while work:
        node = work.pop()
        if isinstance(node, Element):
            if node.tag in ("pre", "listing"):
                return text.split("\n")
            work += node.children
    return [" ".join(text.split())]


def _table(table: Element, depth: int, seen: bool) -> str:
    """Rows of cells, each column as wide as its widest cell; the caption and stray text above.

    A cell that spans rows or columns stands in the first of them and keeps the others empty.
    """
    rows: list[list[list[str]]] = []
    taken: dict[int, int] = {}  # column: rows below that a cell above still spans
    above: list[str] = []
    work = [(iter(table.children), seen)]
    while work:
        nodes, seen = work[-1]
        node = next(nodes, None)
        if node is None:
            work.pop()
            if work:
                taken.clear()  # no cell reaches out of its group of rows
        elif isinstance(node, str):
            if node.strip() and seen:
                above.append(" ".join(node.split()))
        elif not displayed(node):
            continue
        elif node.tag in ("thead", "tbody", "tfoot", "colgroup"):
            taken.clear()
            work.append((iter(node.children), visibility(node, seen)))
        elif node.tag == "tr":
            row: dict[int, list[str]] = {}
            spans: dict[int, int] = {}
            at, in_row = 0, visibility(node, seen)
            for cell in node.children:
                if isinstance(cell, Element) and not displayed(cell):
                    continue
                if is_cell := isinstance(cell, Element) and cell.tag in ("td", "th"):
                    text = _cell(cell, depth, visibility(cell, in_row))
                    across, down = min(max(1, number(cell, "colspan", 1)), MOST_COLUMNS), number(cell, "rowspan", 1)
                    down = min(down, MOST_ROWS) if down > 0 else MOST_ROWS if down == 0 else 1
                else:
                    text, across, down = [" ".join((cell if isinstance(cell, str) else render(cell, depth + 1, in_row)).split())], 1, 1
                    if not text[0] or (isinstance(cell, str) and not in_row):
                        continue
                while taken.get(at, 0):
                    at += 1
                row[at] = text
                for c in range(at, at + across):
                    if is_cell and down > 1:
                        spans[c] = down - 1
                at += across
            taken = {c: n - 1 for c, n in taken.items() if n > 1} | spans
            if any(any(t) for t in row.values()):
                rows.append([row.get(c, [""]) for c in range(max(row) + 1)])
        else:
            above.append(render(node, depth + 1, seen))
    widths: list[int] = []
    for row in rows:
        widths += [0] * (len(row) - len(widths))
        for i, cell in enumerate(row):
            widths[i] = max(widths[i], *map(width_of, cell))
    lines = []
    for row in rows:
        for k in range(max(map(len, row))):
            part = [cell[k] if k < len(cell) else "" for cell in row]
            lines.append("  ".join(t + " " * (w - width_of(t)) for t, w in zip(part, widths)).rstrip())
    return "\n".join([x for x in above if x] + lines)


def text_of(page: str | None) -> str:
    """The visible text of a page."""
    return render(parse(page)) if page else ""


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array([text_of(x) for x in some.column(2).to_pylist()], pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` of every row; null and empty pages have an empty text.

    Pages are read one by one, as long as they are; repeated rows stay apart, an empty table gives no
    rows, and columns of other names don't come along, whatever they are called.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_texts, "page_id long, url string, text string")
