"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block element. A line's weight is the length of
its text outside links; it is more where the markup marks the content, less next to that, and
0 where it says that it isn't content (menus, headers, footers, forms, adverts, comments and
the like). The weights are summed over a sliding window of lines; on every page, text starts
where that distribution surges and ends where it dives, and the lines between are the main text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenmill.llm.texts import byte_rows, prepare

WINDOW = 3
#: Weight over a window that makes a surge.
SURGE = 80
#: Weight that a line has besides its length inside marked content, and share of a line's weight next to it.
MARKED, OUTSIDE = 60, 0.25
#: Share of a line's text that may be in links.
MAX_LINKED = 0.5

# Element names of HTML.
_SKIP = {"script", "style", "noscript", "template", "head", "svg", "math", "iframe", "object", "canvas", "audio", "video", "map", "select", "textarea", "datalist"}
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
_ASIDE = {"nav", "footer", "aside", "form", "menu", "button", "dialog", "search", "fieldset", "header"}
_MAIN = {"article", "main"}
_ENDS_P = _BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "optgroup", "legend", "summary"}
# Words of class, id and role that mark what isn't content; names like with-sidebar only tell of a layout.
_BOILER = re.compile(r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|adbox|adslot|sponsor(?:ed|s)?|promos?|promotion|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|trending|sidebar|widget|rail|nav|navbar|navigation|menu|breadcrumbs?|toolbar|topbar|masthead|header|footer|foot|bottom|copyright|legal|disclaimer|comments?|commentlist|replies|reply|discussion|disqus|respond|pagination|pager|tags|taglist|skip|search|form|contentinfo|complementary)(?:$|[\s_-]|\d)", re.I)
_HEAD = re.compile(r"(?:^|[\s_-])header(?:$|[\s_-]|\d)", re.I)
_STATE = re.compile(r"(?:with|without|has|no|show|hide)[-_]", re.I)

_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_GAP = re.compile(r"\s*")


class _Line:
    __slots__ = ("linked", "main", "off", "parts")

    def __init__(self, off: bool, main: bool):
        self.parts: list[str] = []
        self.linked, self.off, self.main = 0, off, main

    def text(self) -> str:
        text = "".join(self.parts)
        return " ".join((html.unescape(text) if "&" in text else text).split())


def _marks(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element isn't content, and whether it is the content, by its attributes; inside: within the content, which may have a header."""
    off = main = False
    for m in _ATTRIBUTE.finditer(attributes):
        key = m[1].lower()
        if key not in ("class", "id", "role", "hidden", "aria-hidden", "style"):
            continue
        value = (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            off = True
        elif key in ("class", "id", "role") and name not in ("html", "body"):
            off |= any(_BOILER.search(x) and not _STATE.match(x) and not (inside and _HEAD.search(x)) for x in value.split())
            main |= key == "role" and value in ("main", "article")
    return off and not main, main


class _Tags:
    """Ends of tags in a page. All calls together take time in proportion to the page."""

    def __init__(self, page: str):
        self.page = page
        self.last = {q: page.rfind(q) for q in "\"'>"}
        self.quotes = True  # off once a quoted value hides the last ">" of the page

    def end(self, at: int) -> int:
        """Place of the ">" that ends the tag from ``at``, outside quoted values; -1: there is none."""
        page, first = self.page, self.page.find(">", at) if at <= self.last[">"] else -1
        j, k = first, at
        while j >= 0 and self.quotes:
            k = page.find("=", k, j)
            if k < 0:
                return j
            k = _GAP.match(page, k + 1).end()
            quote = page[k : k + 1]
            if quote in ("'", '"') and k < self.last[quote]:
                k = page.find(quote, k + 1) + 1
                if k > j:
                    j = page.find(">", k)
        if j < 0 <= first:
            self.quotes = False
        return first


class _Reader:
    """Blocks of a page in order; elements that are open are on a stack with what holds inside them."""

    def __init__(self):
        self.out: list[_Line] = []
        self.stack: list[tuple[str, bool, bool, bool, int]] = []  # name, off, main, skip, links around
        self.places: dict[str, list[int]] = {}  # of each open name on the stack
        self.blocks: list[int] = []  # places of blocks
        self.solid: list[int] = []  # and of elements without text
        self.off = self.main = self.skip = False
        self.links = 0
        self.line = _Line(False, False)

    def close_line(self) -> None:
        if self.line.parts:
            self.out.append(self.line)
        self.line = _Line(self.off, self.main)

    def _inside(self) -> None:
        _, self.off, self.main, self.skip, self.links = self.stack[-1] if self.stack else ("", False, False, False, 0)

    def push(self, name: str, off: bool, main: bool) -> None:
        at = len(self.stack)
        self.places.setdefault(name, []).append(at)
        if name in _BLOCK:
            self.blocks.append(at)
        if name in _BLOCK or name in _SKIP:
            self.solid.append(at)
        self.stack.append((name, off or self.off, main or self.main, self.skip or name in _SKIP, self.links + (name == "a")))
        self._inside()

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            self.places[self.stack.pop()[0]].pop()
        for places in (self.blocks, self.solid):
            while places and places[-1] >= to:
                places.pop()
        self._inside()

    def put(self, text: str) -> None:
        if text and not self.skip:
            self.line.parts.append(text)
            if self.links:
                self.line.linked += len(text.strip())

    def end_tag(self, name: str) -> None:
        if name == "br":
            self.put(" ")
        elif self.places.get(name):
            to = self.places[name][-1]
            # an inline end tag doesn't reach out of its block
            if name in _BLOCK or not self.blocks or self.blocks[-1] < to:
                if self.solid and self.solid[-1] >= to:
                    self.close_line()
                self.pop(to)
                if not self.line.parts:
                    self.line.off, self.line.main = self.off, self.main
        elif name in _BLOCK:
            self.close_line()

    def start_tag(self, name: str, attributes: str) -> bool:
        """Whether the element was opened."""
        if name == "br":
            self.put(" ")
        if name == "hr":
            self.close_line()
        if name in _VOID:
            return False
        if name in _BLOCK or name in _SKIP:
            if self.line.parts:
                self.close_line()
            inner = self.stack[self.blocks[-1]][0] if self.blocks else ""
            if (inner == "p" and name in _ENDS_P) or (inner == name and name in ("li", "dd", "dt", "option", "tr", "td", "th")) or {inner, name} == {"dd", "dt"} or {inner, name} == {"td", "th"}:
                self.pop(self.blocks[-1])
        off, main = _marks(name, attributes, self.main) if attributes else (False, False)
        # a heading group inside the article belongs to it
        if name in _ASIDE and not (name == "header" and self.main):
            off = True
        if attributes.endswith("/") and name not in _BLOCK:
            return False
        self.push(name, off, main or name in _MAIN and not self.off)
        if name in _BLOCK or name in _SKIP:
            self.line.off, self.line.main = self.off, self.main
        return True


def lines(page: str) -> list[_Line]:
    """Blocks of a page in order. Inside an element that isn't content, ``off`` is set; inside the marked content, ``main``.

    A "<" that starts no tag is text, and so is the rest of a page behind a tag that never ends.
    """
    r, tags, at = _Reader(), _Tags(page), 0
    while (a := page.find("<", at)) >= 0:
        r.put(page[at:a])
        if page.startswith("<!--", a):
            end = page.find("-->", a + 4)
            at = end + 3 if end >= 0 else len(page)
        elif page.startswith("<![CDATA[", a):
            end = page.find("]]>", a)
            r.put(html.escape(page[a + 9 : end if end >= 0 else len(page)]))
            at = end + 3 if end >= 0 else len(page)
        elif m := _NAME.match(page, a + 1):
            end = tags.end(m.end())
            if end < 0:
                at = a
                break
            at, name = end + 1, m[0].lower()
            if name[0] == "/":
                r.end_tag(name[1:])
            elif r.start_tag(name, page[m.end() : end]) and name in _RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(page, at)
                if not r.skip:
                    r.put(page[at : close.start() if close else len(page)])
                end = page.find(">", close.end()) if close else -1
                at = end + 1 if end >= 0 else len(page)
                r.close_line()
                r.pop(len(r.stack) - 1)
                r.line = _Line(r.off, r.main)
        elif page[a + 1 : a + 2] in ("!", "?") and a < tags.last[">"]:
            at = page.find(">", a) + 1
        else:
            r.put("<")
            at = a + 1
    r.put(page[at:])
    r.close_line()
    return r.out


def weights(found: list[tuple[str, _Line]]) -> list[float]:
    """Of each line: its characters outside links, by MARKED more inside the marked content, where links count like text.

    0 where the markup says that it isn't content, and where over MAX_LINKED of it are links;
    OUTSIDE of it next to marked content.
    """
    marked = any(x.main and not x.off for _, x in found)
    out = []
    for t, x in found:
        if x.off:
            out.append(0.0)
        elif x.main:
            out.append(float(len(t) + MARKED))
        else:
            plain = max(0, len(t) - x.linked) if x.linked <= MAX_LINKED * len(t) else 0
            out.append(plain * (OUTSIDE if marked else 1.0))
    return out


def surges(weight: list[float], inside: list[bool], window: int, surge: float) -> list[bool]:
    """Which lines stand between a surge and a dive of the weight that a sliding window of lines has.

    Windows end where the marked content starts or ends. Text starts at a line of weight whose
    window has over ``surge``, and goes on up to a whole window of none.
    """
    n = len(weight)
    total = [0.0, *accumulate(weight)]
    edge = [n] * n  # where the stretch of a line ends
    for i in range(n - 2, -1, -1):
        edge[i] = edge[i + 1] if inside[i] == inside[i + 1] else i + 1
    mass = [total[min(i + window, edge[i])] - total[i] for i in range(n)]
    out, on = [], False
    for i in range(n):
        new = not i or inside[i] != inside[i - 1]
        on = mass[i] > 1e-6 if on and not new else weight[i] > 0 and mass[i] > surge
        out.append(on)
    return out


def main_text(page: str | None, window: int = WINDOW, surge: int = SURGE) -> str:
    """The main text of a page: its blocks in order, joined by one newline; empty if there is none (null, no text).

    Where nothing surges (a page of a few short lines), all lines of weight are the text.
    """
    found = [(x.text(), x) for x in lines(page or "")]
    # what isn't content takes no place in the windows of marked content
    found = [(t, x) for t, x in found if t and not (x.off and x.main)]
    weight = weights(found)
    on = surges(weight, [x.main for _, x in found], window, surge)
    keep = [t for (t, _), w, x in zip(found, weight, on, strict=True) if w and x]
    return "\n".join(keep or [t for (t, _), w in zip(found, weight, strict=True) if w])


def _extract(batches: Iterator[pa.RecordBatch], window: int, surge: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x.decode() if x is not None else None, window, surge) for x in byte_rows(b.column(2))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, window: int = WINDOW, surge: int = SURGE) -> DataFrame:
    """``page_id, url, text, n_chars``, one row for each row of ``pages``.

    Character references are decoded, white space inside a block becomes one space, blocks are
    trimmed and joined in page order by one newline; n_chars counts code points. Null or empty
    html gives an empty text. Nothing is shuffled: repeated rows, null ids and urls pass through,
    very long pages need memory for themselves only and time in proportion, and further columns are ignored.
    """
    prepare(pages, "page_id", "url", "html")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return p.mapInArrow(partial(_extract, window=window, surge=surge), "page_id long, url string, text string, n_chars long")
