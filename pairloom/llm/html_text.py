"""HTML extraction: the visible text of a page, laid out as it would be read.

A tree is built from the tags with the end tags that HTML implies, hidden parts are left out, and the rest is
written with block spacing, list marks and table cells in aligned columns.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import slices

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes object audio video canvas svg math datalist meta link base".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu fieldset".split())
BLOCKS = SPACED | frozenset("address article aside body caption center dd details dialog dir div dt figcaption footer form header hgroup html legend li main nav option search section summary tbody td tfoot th thead tr".split())
CLOSES_P = BLOCKS - frozenset("body html caption tbody td tfoot th thead tr option legend".split())
# A start tag ends open elements of these names, looked for inside the nearest of the borders.
IMPLIED_END = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "caption", "colgroup"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("select", "datalist", "optgroup")),
    "optgroup": (("option", "optgroup"), ("select",)),
    "body": (("head",), ("html",)),
}
# An end tag reaches no further out than these.
SCOPE = frozenset("table td th caption button template".split())
# Elements nested deeper than this become siblings, as browsers have it.
DEEPEST = 512
# Tables nested deeper than this are written as plain blocks.
NESTED_TABLES = 40

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
BLANK = re.compile(r"[ \t\n\f\r]+")


class Element:
    __slots__ = ("tag", "hidden", "span", "start", "below")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.below = tag, []
        self.hidden, self.span, self.start = tag in UNSEEN, 1, 1
        if attributes and not attributes.isspace():
            for m in ATTRIBUTE.finditer(attributes):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name == "hidden" or name == "style" and HIDING.search(value) or name == "type" and tag == "input" and value.lower() == "hidden":
                    self.hidden = True
                elif name == "colspan" and value.isascii() and value.isdigit():
                    self.span = min(max(1, int(value[:6])), 1000)
                elif name == "start" and value.isascii() and value.isdigit():
                    self.start = int(value[:9])


def build(page: str) -> Element:
    """The tree of a page. Wrong nesting is put right as far as text order goes; nothing raises."""
    root = Element("#page")
    stack = [root]

    def close(names, borders) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in borders:
                return

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].below.append(unescape(page[at:]))
            break
        if m.start() > at:
            stack[-1].below.append(unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].below.append(Element("br"))
            elif tag not in VOID:
                close((tag,), () if tag in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "html", "body") else SCOPE)
            continue
        if tag in IMPLIED_END:
            close(*IMPLIED_END[tag])
            if tag in ("tr", "thead", "tbody", "tfoot"):
                close((tag,), ("table",))
        if tag in CLOSES_P:
            close(("p",), SCOPE)
        if stack[-1].tag == "head" and tag not in UNSEEN:
            stack.pop()
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Element("tr")
            stack[-1].below.append(row)
            stack.append(row)
        new = Element(tag, m[3])
        stack[-1].below.append(new)
        if tag in VOID:
            continue
        if tag in RAW:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            stop = found.start() if found else end
            new.below.append(unescape(page[at:stop]) if tag in ("textarea", "title") else page[at:stop])
            at = found.end() if found else end
            continue
        if len(stack) < DEEPEST:
            stack.append(new)
    return root


class Writer:
    """Lines of text, with spaces and blank lines only where something stands on both sides."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.indent = ""
        self.mark = ""

    def words(self, text: str) -> None:
        parts = BLANK.sub(" ", text)
        if parts[:1] == " ":
            self.space, parts = True, parts[1:]
        if not parts:
            return
        if self.line:
            if self.space:
                self.line.append(" ")
        else:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.begin()
        self.space = parts[-1] == " "
        self.line.append(parts[:-1] if self.space else parts)

    def begin(self) -> None:
        """Indent a line; a list's mark takes the place of its last two columns, so that wrapped text hangs."""
        self.line.append(self.indent[: len(self.indent) - 2] + self.mark if self.mark else self.indent)
        self.mark = ""

    def end_line(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self.end_line()
        self.blank = self.blank or spaced

    def as_is(self, text: str) -> None:
        for i, part in enumerate(text.split("\n")):
            if i:
                if self.line:
                    self.end_line()
                elif self.lines:
                    self.lines.append("")
            if part:
                if not self.line:
                    if self.blank and self.lines:
                        self.lines.append("")
                    self.blank = False
                    self.begin()
                self.line.append(part)

    def text(self) -> str:
        self.end_line()
        return "\n".join(self.lines).strip("\n")


def render(root: Element, depth: int = 0) -> str:
    """The visible text below an element."""
    out = Writer()
    lists: list[tuple[str, int]] = []
    pre = 0
    todo: list[tuple[str, object]] = [("open", child) for child in reversed(root.below)]
    while todo:
        what, node = todo.pop()
        if isinstance(node, str):
            out.as_is(node) if pre else out.words(node)
            continue
        tag = node.tag
        if what == "close":
            if tag in ("ul", "ol", "menu"):
                lists.pop()
            elif tag == "pre":
                pre -= 1
            if tag in ("li", "dd", "blockquote"):
                out.block(tag == "blockquote")
                out.indent, out.mark = out.indent[: -(4 if tag == "blockquote" else 2)], ""
            elif tag in BLOCKS:
                out.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
            continue
        if node.hidden:
            continue
        if tag == "br":
            if not out.line and out.lines and not out.blank and out.lines[-1]:
                out.lines.append("")
            out.end_line()
            continue
        if tag == "table" and depth < NESTED_TABLES:
            out.block(True)
            laid = table(node, depth + 1)
            if laid:
                out.as_is(laid)
            out.block(True)
            continue
        if tag in BLOCKS:
            out.block(tag in SPACED and not (tag in ("ul", "ol", "menu") and lists))
        if tag in ("ul", "ol", "menu"):
            lists.append((tag, node.start))
        elif tag == "li":
            kind, number = lists[-1] if lists else ("ul", 1)
            out.mark = f"{number}. " if kind == "ol" else "- "
            if lists:
                lists[-1] = (kind, number + 1)
            out.indent += "  "
        elif tag == "dd":
            out.indent += "  "
        elif tag == "blockquote":
            out.indent += "    "
        elif tag == "pre":
            pre += 1
        if tag in BLOCKS or tag == "pre":
            todo.append(("close", node))
        todo += [("open", child) for child in reversed(node.below)]
    return out.text()


def table(node: Element, depth: int) -> str:
    """Rows of cells in columns as wide as their widest line; captions and stray text come first."""
    before, rows, todo = [], [], list(reversed(node.below))
    while todo:
        child = todo.pop()
        if isinstance(child, str):
            if child.strip():
                before.append(BLANK.sub(" ", child).strip())
        elif child.hidden:
            continue
        elif child.tag in ("thead", "tbody", "tfoot", "form"):
            todo += reversed(child.below)
        elif child.tag == "tr":
            cells = []
            for cell in child.below:
                if isinstance(cell, str):
                    if cell.strip():
                        cells.append((1, [BLANK.sub(" ", cell).strip()]))
                elif not cell.hidden:
                    cells.append((cell.span, render(cell, depth).split("\n")))
            if any(any(lines) for _, lines in cells):
                rows.append(cells)
        else:
            text = render(child, depth)
            if text:
                before.append(text)
    widths: dict[int, int] = {}
    for cells in rows:
        at = 0
        for span, lines in cells:
            if span == 1:
                widths[at] = max(widths.get(at, 0), *map(len, lines))
            at += span
    lines_out = list(before)
    for cells in rows:
        for k in range(max(len(lines) for _, lines in cells)):
            line, at, place = [], 0, 0
            for span, lines in cells:
                line.append((place, lines[k] if k < len(lines) else ""))
                place += sum(widths.get(c, 0) + 2 for c in range(at, at + span))
                at += span
            text = ""
            for place, part in line:
                if part:
                    text = (text.ljust(place) if len(text) <= place - 2 or not text else text + "  ") + part
            lines_out.append(text.rstrip())
    return "\n".join(lines_out)


def page_text(page: str | None) -> str | None:
    return None if page is None else render(build(page)) if page else ""


def extract(pages: DataFrame, column: str = "html", keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``text``, the visible text of ``column``, and ``n_chars``, its length.

    All rows stay and the columns in ``keep`` (all by default); columns named ``text`` or ``n_chars`` are replaced. NULL gives NULL and 0, an
    empty page or one that shows nothing an empty text. Broken markup never fails: an unclosed tag ends with what is
    around it, a ``<`` that opens no tag is text. No shuffle; a row needs memory in proportion to its page.
    """
    kept = pages.select(*[c for c in keep or pages.columns if c not in ("text", "n_chars")])
    schema = kept.withColumns({"text": F.lit(None).cast("string"), "n_chars": F.lit(None).cast("bigint")}).schema
    names = [*kept.columns, "text", "n_chars"]

    def run(batches):
        for batch in slices(batches, column):
            columns = {n: batch.column(n) for n in batch.schema.names}
            texts = [page_text(p) for p in columns[column].to_pylist()]
            columns |= {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return pages.select(*dict.fromkeys([*kept.columns, column])).mapInArrow(run, schema)
