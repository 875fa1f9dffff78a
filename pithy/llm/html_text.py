"""Layout-aware HTML to text.

A scanner reads tags, comments and raw-text elements; a tree builder keeps the stack of open
elements, supplies the tags that HTML implies (ends of p, li, dt, dd, option, tr, td, th; a row
around a bare cell; the end of head at the first visible thing) and ignores ends that match nothing;
a renderer writes all visible text with the layout: blank lines around paragraphs, headings, lists and
tables, a line for each other block, bullets and numbers with indents, ``pre`` as it stands, and
table cells aligned in columns. Both run in one pass over an explicit stack, so depth is no limit.

Not visible: head, script, style, template, noscript, iframe, audio, video, canvas, svg, object,
datalist; elements with ``hidden`` or an inline ``display: none`` or ``visibility: hidden``; closed
``dialog``; all of a closed ``details`` but its summary; hidden inputs. Comments and declarations
are skipped.

Defined cases: null and empty pages give the empty text; a tag that never ends swallows the rest of
the page, as in a browser; a raw-text element that never ends runs to the end of the page; broken
UTF-8 becomes U+FFFD. Cells longer than ``ALIGN`` characters don't widen their column, so that a
table's text grows with its cells and not with their product.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pithy.llm.arrow import map_slices, text_column, texts, with_struct

#: Longest cell that widens its column; most columns a cell may span.
ALIGN, SPAN = 60, 100

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
UNSEEN = frozenset("head script style template title noscript noembed noframes iframe audio video canvas svg object datalist".split())
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre xmp dl figure hr table".split())
BLOCK = frozenset("address article aside body caption center dd details dialog div dt fieldset figcaption footer form header hgroup html legend main menu nav option optgroup section select summary textarea tr".split()) | SPACED
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
WALLS = frozenset("table td th caption button object template html".split())
IMPLIED_ENDS = {  # start tag: (elements it ends, elements behind which it doesn't look)
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"}) | WALLS),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"}) | WALLS),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"}) | WALLS),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"}) | WALLS),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"}) | WALLS),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr", "td", "th", "caption"}), frozenset({"table"})),
    "tbody": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
    "thead": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
    "tfoot": (frozenset({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"})),
}

# A quote opens a value only after "="; elsewhere it is a character of a name or of an unquoted value.
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])[^\s>]*+)|(?!\s*+=)))*+)>")
_ATTR = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"'][^\s>]*)))?")
_HIDES = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NUMBER = re.compile(r"\s*(\d{1,6})")


class Flow:
    """Text being laid out: breaks are asked for and written before the next visible thing."""

    def __init__(self):
        self.parts: list[str] = []
        self.breaks = 0
        self.blank = False
        self.indents: list[str] = []
        self.mark = ""

    def need(self, lines: int) -> None:
        self.breaks = max(self.breaks, lines)
        self.blank = False

    def _start(self) -> None:
        if self.breaks and self.parts:
            self.parts.append("\n" * self.breaks)
        if self.breaks or not self.parts:
            lead = "".join(self.indents[:-1] if self.mark else self.indents)
            self.parts.append(lead + self.mark)
            self.mark = ""
        elif self.blank:
            self.parts.append(" ")
        elif self.mark:
            self.parts.append(self.mark)
            self.mark = ""
        self.breaks, self.blank = 0, False

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s == " ":
            self.blank = self.blank or not self.breaks and bool(self.parts)
            return
        if s.startswith(" ") and not self.breaks and self.parts:
            self.blank = True
        self._start()
        self.parts.append(s.strip(" "))
        self.blank = s.endswith(" ")

    def lines(self, s: str) -> None:
        """Text whose line ends and blanks stay."""
        for i, line in enumerate(s.replace("\r\n", "\n").split("\n")):
            if i:
                self.breaks += 1
            if line:
                self._start()
                self.parts.append(line)

    def result(self) -> str:
        return "\n".join(line.rstrip(" ") for line in "".join(self.parts).strip("\n").split("\n"))


class Table:
    """Rows of cells (text, column, columns spanned)."""

    def __init__(self):
        self.rows: list[list[tuple[str, int, int]]] = []
        self.taken: dict[int, int] = {}  # column: rows for which a cell from above still holds it
        self.at = 0

    def row(self) -> None:
        self.taken = {c: n - 1 for c, n in self.taken.items() if n > 1}
        self.rows.append([])
        self.at = 0

    def cell(self, text: str, wide: int, tall: int) -> None:
        if not self.rows:
            self.row()
        while self.at in self.taken:
            self.at += 1
        self.rows[-1].append((text, self.at, wide))
        if tall > 1:
            for c in range(self.at, self.at + wide):
                self.taken[c] = tall
        self.at += wide

    def result(self) -> list[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            for text, c, wide in row:
                if wide == 1 and len(text) <= ALIGN:
                    width[c] = max(width.get(c, 0), len(text))
        used = sorted({c for row in self.rows for _, c, _ in row})
        start, at = {}, 0
        for c in used:
            start[c] = at
            at += width.get(c, 0) + 2
        out = []
        for row in self.rows:
            line = ""
            for text, c, _ in row:
                if text:
                    line = line.ljust(start[c]) if len(line) < start[c] or not line else line + "  "
                    line += text
            if line.strip():
                out.append(line.rstrip())
        return out


class Element:
    __slots__ = ("count", "flow", "name", "seen", "spans", "table", "was_pre")

    def __init__(self, name: str, seen: bool):
        self.name, self.seen = name, seen
        self.flow = self.table = self.was_pre = None
        self.count, self.spans = 0, (1, 1)


class Page:
    """Tree builder and renderer of one page."""

    def __init__(self):
        self.flow = Flow()
        self.stack: list[Element] = []
        self.open: Counter = Counter()
        self.lists: list[Element] = []
        self.tables: list[Element] = []
        self.pre = False
        self.seen = True

    # --- tree -----------------------------------------------------------------

    def end_until(self, names: frozenset, walls: frozenset) -> None:
        """Ends the outermost of ``names`` above the nearest wall."""
        if not any(self.open[n] for n in names):
            return
        hit = None
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].name in names:
                hit = i
            elif self.stack[i].name in walls:
                break
        if hit is not None:
            while len(self.stack) > hit:
                self.pop()

    def start(self, name: str, attrs: str) -> None:
        if self.open["head"] and name not in IN_HEAD and name not in ("html", "head"):
            self.end_until(frozenset({"head"}), frozenset())
        if name in ENDS_P and self.open["p"]:
            self.end_until(frozenset({"p"}), WALLS)
        if name in HEADINGS and self.stack and self.stack[-1].name in HEADINGS:
            self.pop()
        if name in IMPLIED_ENDS:
            self.end_until(*IMPLIED_ENDS[name])
        if name in ("td", "th") and self.tables and not self._in_row():
            self.push("tr", "")
        self.push(name, attrs)
        if name in VOID:
            self.pop()

    def _in_row(self) -> bool:
        for el in reversed(self.stack):
            if el.name in ("tr", "table"):
                return el.name == "tr"
        return False

    def end(self, name: str) -> None:
        if name == "br":
            self.start("br", "")
        elif name == "p" and not self.open["p"]:
            self.start("p", "")
            self.pop()
        elif self.open[name]:
            walls = frozenset() if name in ("table", "html", "body") else frozenset({"table"}) if name in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else frozenset({"td", "th", "caption", "table"})
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i].name == name:
                    while len(self.stack) > i:
                        self.pop()
                    return
                if self.stack[i].name in walls:
                    return

    # --- layout ---------------------------------------------------------------

    def push(self, name: str, attrs: str) -> None:
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attrs)} if "=" in attrs or attrs.strip(" /") else {}
        seen = self.seen and name not in UNSEEN and "hidden" not in found and not _HIDES.search(found.get("style", ""))
        if name == "dialog" and "open" not in found:
            seen = False
        if self.stack and self.stack[-1].name == "details" and self.stack[-1].count and name != "summary":
            seen = False
        el = Element(name, self.seen)
        self.stack.append(el)
        self.open[name] += 1
        self.seen = seen
        if not seen:
            return
        flow = self.flow
        if name == "br":
            flow.breaks += 1
            flow.blank = False
        elif name == "hr":
            flow.need(2)
        elif name == "details":
            el.count = int("open" not in found)
        elif name in ("ul", "ol", "menu"):
            flow.need(1 if self.lists else 2)
            start = _NUMBER.match(found.get("start", ""))
            el.count = (int(start[1]) if start else 1) if name == "ol" else -1
            self.lists.append(el)
        elif name == "li":
            flow.need(1)
            mark = "- "
            if self.lists and self.lists[-1].count >= 0:
                mark = f"{self.lists[-1].count}. "
                self.lists[-1].count += 1
            flow.indents.append(" " * len(mark))
            flow.mark = mark
            el.table = flow
        elif name == "blockquote":
            flow.need(2)
            flow.indents.append("  ")
            el.table = flow
        elif name == "table":
            flow.need(2)
            el.table = Table()
            self.tables.append(el)
        elif name == "tr" and self.tables:
            self.tables[-1].table.row()
        elif name in ("td", "th") and self.tables:
            spans = [_NUMBER.match(found.get(k, "")) for k in ("colspan", "rowspan")]
            el.spans = tuple(min(SPAN, max(1, int(m[1]))) if m else 1 for m in spans)
            el.flow, self.flow = self.flow, Flow()
        elif name in SPACED:
            flow.need(2)
        elif name in BLOCK:
            flow.need(1)
        if name in ("pre", "xmp", "textarea"):
            el.was_pre, self.pre = self.pre, True

    def pop(self) -> None:
        el = self.stack.pop()
        self.open[el.name] -= 1
        seen, self.seen = self.seen, el.seen
        if not seen:
            return
        name = el.name
        if el.was_pre is not None:
            self.pre = el.was_pre
        if name in ("ul", "ol", "menu"):
            if self.lists and self.lists[-1] is el:
                self.lists.pop()
            self.flow.need(1 if self.lists else 2)
        elif name in ("li", "blockquote"):
            if el.table.indents:
                el.table.indents.pop()
            el.table.mark = ""
            self.flow.need(1 if name == "li" else 2)
        elif name == "table":
            self.tables.pop()
            self.flow.need(2)
            for line in el.table.result():
                self.flow.lines(line)
                self.flow.need(1)
            self.flow.need(2)
        elif el.flow is not None:
            text = _SPACE.sub(" ", el.flow and self.flow.result()).strip()
            self.flow = el.flow
            self.tables[-1].table.cell(text, *el.spans)
        elif name in SPACED:
            self.flow.need(2)
        elif name in BLOCK:
            self.flow.need(1)

    def text(self, s: str) -> None:
        if not s:
            return
        if self.stack and self.stack[-1].name == "head" and not s.isspace():
            self.end_until(frozenset({"head"}), frozenset())
        if not self.seen or (self.stack and self.stack[-1].name == "details" and self.stack[-1].count):
            return
        s = html.unescape(s) if "&" in s else s
        if self.pre:
            self.flow.lines(s)
        else:
            self.flow.text(s.replace("\xa0", " ") if s.strip() else s)

    def read(self, source: str) -> str:
        at, n = 0, len(source)
        while at < n:
            lt = source.find("<", at)
            if lt < 0:
                self.text(source[at:])
                break
            self.text(source[at:lt])
            m = _TAG.match(source, lt)
            if m:
                at = m.end()
                name = m[2].lower()
                if m[1]:
                    self.end(name)
                    continue
                self.start(name, m[3])
                if name == "plaintext":
                    self.text(source[at:].replace("&", "&amp;"))
                    break
                if name in RAW:
                    close = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                    body = source[at : close.start()] if close else source[at:]
                    self.text(body if name in ("textarea", "title") else body.replace("&", "&amp;"))
                    at = close.start() if close else n
                    if not close:
                        self.end(name)
            elif source.startswith("<!--", lt):
                end = source.find("-->", lt + 2)
                at = end + 3 if end >= 0 else n
            elif source[lt + 1 : lt + 2] in ("!", "?") or re.match(r"</[^A-Za-z]", source[lt : lt + 3]):
                end = source.find(">", lt)
                at = end + 1 if end >= 0 else n
            elif re.match(r"</?[A-Za-z]", source[lt : lt + 3]):
                break  # a tag that never ends
            else:
                self.text("<")
                at = lt + 1
        while self.stack:
            self.pop()
        return self.flow.result()


def render(source: str) -> str:
    """All visible text of a page."""
    return Page().read(source)


def extract(df: DataFrame, *, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``df`` with the visible text of each page."""
    udf = map_slices(lambda part: pa.array([render(s) for s in texts(part)], type=pa.string()), T.StringType())
    return with_struct(df, F.struct(udf(text_column(df, html_col)).alias("t")), {out_col: "t"})
