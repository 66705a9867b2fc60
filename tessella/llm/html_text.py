"""Main text of HTML pages by text-to-tag ratio.

The standard library's parser streams events; every block boundary ends a line, and each line has a ratio of its text's
code points to its tags. Ratios are smoothed with a Gaussian over the lines and split by a threshold into content and
the rest. The innermost element that holds nearly all of the content lines' text, widened to the article or main element
around it or else until no content line lies outside, is the content region, of which every block stays, however short.

What lies in the region but is not the article goes by its element (menus, asides, footers, forms, scripts, styles) or by a
class, id or role that says so, since adverts and reader comments have ratios like the article's. A name that speaks of
something else too (`social-history`, not `social-links`) counts only where the ratio finds little content in the
element; none counts for an element that holds an article or, where there is none, most of the page's content.

Elements are numbered with a pointer to the parent; what a page needs to know of them is handed down when they open and
added up once at the end, so time grows with the page, however deep it is. One map over the pages.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tessella.llm.common import map_batches, table

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Hidden until their end; phrasing ones also end where a block begins or ends, for a page may leave them open. Buttons
#: hold blocks of layout, but no paragraphs.
_HIDDEN = frozenset("head script style template noscript svg math canvas object iframe audio video".split())
_PHRASING = frozenset("title select option textarea button".split())
_IN_BUTTONS = frozenset("div".split())
_NOISE = frozenset("nav menu footer aside form dialog fieldset".split())
_BLOCK = frozenset(
    "html body main article section div header nav footer aside form p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption "
    "thead tbody tfoot tr td th pre blockquote figure figcaption address details summary fieldset legend hr menu dialog "
    "search hgroup center".split()
)
#: Words in class, id or role that mark what is not the article.
_MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements sponsor sponsored promo promotion banner popup modal overlay "
    "cookie cookies consent gdpr notice notices alert alerts nav navbar navigation menu menus breadcrumb breadcrumbs "
    "pagination pager toolbar sidebar sidebars aside rail widget footer header masthead topbar bottombar comment comments "
    "disqus reply replies respond discussion share sharing social related recommended newsletter subscribe subscription "
    "signup login search form complementary contentinfo dialog".split()
)
#: Words that say where or how something stands, not what it is.
_PLACES = frozenset(
    "area articles bar block body bottom box btn button buttons card cards col column container content copyright desktop "
    "email entries entry feed first follow full google group head heading holder icons image img inner item items js large "
    "last left link links list media medium message messages mobile module more news outer page panel placement policy "
    "popular post posts region right row section site size slot small sticky stories text thread title top trending unit us "
    "user wide wrap wrapper zone".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ARTICLE = frozenset(("article", "main"))
_TEXT = frozenset(("p", "li", *_HEADINGS))  #: hold lines, not regions
_NO_MARK = frozenset(("html", "body", *_ARTICLE, *_HEADINGS))
_LISTS = ("ul", "ol", "menu")
_ENDS_P = frozenset(("body", "article", "main", "section", "div", "ul", "ol", "table", "nav", "footer", "header", "aside", "form", "p", *_HEADINGS))
_SPLIT = re.compile(r"[^a-z]+")


@dataclass
class Element:
    """An open or closed block: its parent's number, and what it hands down to what is in it."""

    name: str
    up: int
    depth: int
    noise: bool = False  #: it or one around it is noise by its element
    marked: int = 0  #: whether its own class, id or role marks it: 2, or 1 if it speaks of something else too
    article: bool = False  #: an article or main, or in one
    item: bool = False  #: a list item, or in one


@dataclass
class Line:
    text: list[str]
    tags: int = 0
    link: int = 0
    at: int = 0  #: the innermost element


def marked(value: str) -> int:
    """2 if a name in a class, id or role consists of marks, and of words for places besides; 1 if one holds a mark."""
    out = 0
    for name in value.lower().split():
        words = {w for w in _SPLIT.split(name) if len(w) > 1}
        if words & _MARKS:
            out = max(out, 1 if words - _MARKS - _PLACES else 2)
    return out


class _Lines(HTMLParser):
    def __init__(self, shown: frozenset[str] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.shown = shown  # hidden elements that this page leaves open
        self.elements = [Element("", 0, 0)]
        self.stack = [0]  # numbers of the open elements
        self.open: dict[str, list[int]] = {}  # by name, places in the stack
        self.hidden = self.links = 0
        self.hidden_by = ""
        self.lines: list[Line] = []
        self.line = Line([])

    def _end_line(self) -> None:
        if any(not x.isspace() for x in self.line.text):
            self.line.at = self.stack[-1]
            self.lines.append(self.line)
            self.line = Line([])
        else:
            self.line.text.clear()

    def _pop_to(self, place: int) -> None:
        for n in self.stack[place:]:
            self.open[self.elements[n].name].pop()
        del self.stack[place:]

    def _push(self, tag: str, attrs) -> None:
        up = self.elements[self.stack[-1]]
        noise = tag in _NOISE or tag == "header" and not up.article  # an article's own header holds its title
        own = 0
        if tag not in _NO_MARK:
            own = max((marked(value) for name, value in attrs if value and name in ("class", "id", "role")), default=0)
            own = 2 if ("aria-hidden", "true") in attrs else own
            noise = noise or any(name == "hidden" for name, _ in attrs)
        self.elements.append(Element(tag, self.stack[-1], up.depth + 1, noise or up.noise, own, tag in _ARTICLE or up.article, tag == "li" or up.item))
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.elements) - 1)

    def _breaks_out(self, tag: str) -> bool:
        """Whether a block's start or end shows that a hidden element was left open."""
        if tag not in _BLOCK or self.hidden_by == "button" and tag in _IN_BUTTONS:
            return False
        return self.hidden_by in _PHRASING or self.hidden_by == "head"

    def handle_starttag(self, tag, attrs):
        if self.hidden and self._breaks_out(tag):
            self.hidden = 0
        if self.hidden:
            self.hidden += tag == self.hidden_by
            return
        if tag in _VOID:
            if tag == "hr":
                self._end_line()
            elif tag == "br":
                self.line.text.append(" ")
            self.line.tags += 1
            return
        if (tag in _HIDDEN or tag in _PHRASING) and tag not in self.shown:
            self.hidden, self.hidden_by = 1, tag
            return
        if tag in ("html", "body") and self.open.get(tag):
            return
        if tag in _BLOCK:
            self._end_line()
            here = self.elements[self.stack[-1]].name
            if tag in _ENDS_P and here == "p" or tag in _HEADINGS and here in _HEADINGS:
                self._pop_to(len(self.stack) - 1)
            if tag == "li" and self.open.get("li"):
                place = self.open["li"][-1]
                if place > max((self.open[x][-1] for x in _LISTS if self.open.get(x)), default=0):
                    self._pop_to(place)
            self._push(tag, attrs)
        elif tag == "a":
            self.links += 1
        self.line.tags += 1

    def handle_endtag(self, tag):
        if self.hidden:
            if tag == self.hidden_by:
                self.hidden -= 1
                return
            if not self._breaks_out(tag):
                return
            self.hidden = 0
        if tag in _BLOCK:
            self._end_line()
            if self.open.get(tag):
                self._pop_to(self.open[tag][-1])
        elif tag == "a":
            self.links = max(0, self.links - 1)
        self.line.tags += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag in _BLOCK | _HIDDEN | _PHRASING:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.hidden:
            return
        self.line.text.append(data)
        if self.links:
            self.line.link += len("".join(data.split()))


def parse(html: str) -> tuple[list[Element], list[Line], list[str]]:
    """The page's blocks, its lines and their texts. A hidden element that never ends is read again as one that is shown."""
    shown: frozenset[str] = frozenset()
    while True:
        parser = _Lines(shown)
        parser.feed(html)
        parser.close()
        if not parser.hidden or parser.hidden_by in ("script", "style"):
            break
        shown |= {parser.hidden_by}
    parser._end_line()
    return parser.elements, parser.lines, [" ".join("".join(x.text).split()) for x in parser.lines]


def smooth(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing; beyond the ends the kernel's rest is left out."""
    r = max(1, math.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(values, kernel)[r:-r] / np.convolve(np.ones(len(values)), kernel)[r:-r]


def content_lines(ratios: np.ndarray, sigma: float, cut: float) -> np.ndarray:
    """Which lines are content: those whose smoothed ratio is cut * standard deviation or more."""
    smoothed = smooth(ratios, sigma)
    return (smoothed >= cut * smoothed.std()) & (ratios > 0)


def add_up(elements: list[Element], own: list[float]) -> list[float]:
    """For each element the sum over it and all elements in it; parents come before what is in them."""
    out = list(own)
    for i in range(len(elements) - 1, 0, -1):
        out[elements[i].up] += out[i]
    return out


def noisy(elements: list[Element], lines: list[Line], texts: list[str], sigma: float, cut: float) -> list[bool]:
    """Which elements are noise, by what they are or by their marks. What the ratio finds when marks do not count decides
    on marks: none counts for an element with an article in it or, on a page without articles, with more than half of the
    content; a name that speaks of something else too counts only if less than half of the element's text is content."""
    ratios = np.array([0.0 if elements[x.at].noise else len(t) / max(1, x.tags) for x, t in zip(lines, texts, strict=True)])
    mass = [0.0] * len(elements)
    if ratios.any():
        for x, t, c in zip(lines, texts, content_lines(ratios, sigma, cut), strict=True):
            mass[x.at] += len(t) * bool(c)
    size = [0.0] * len(elements)
    for x, t in zip(lines, texts, strict=True):
        size[x.at] += len(t)
    mass, size = add_up(elements, mass), add_up(elements, size)
    holds = add_up(elements, [float(e.name in _ARTICLE) for e in elements])
    out = [False] * len(elements)
    for i, e in enumerate(elements[1:], start=1):
        counts = e.marked == 2 or e.marked == 1 and 2 * mass[i] < size[i]
        out[i] = e.noise or out[e.up] or counts and not holds[i] and (holds[0] or 2 * mass[i] <= mass[0])
    return out


def extract(html: str | None, sigma: float = 1.0, cut: float = 0.5, share: float = 0.9) -> str:
    """The main text; empty for null, empty and text-free pages.

    cut: lines of a smoothed ratio of cut * standard deviation or more are content. share: of the content's code points
    that the innermost element must hold from which the content region grows.
    """
    if not html:
        return ""
    elements, lines, texts = parse(html)
    if not lines:
        return ""
    noise = noisy(elements, lines, texts, sigma, cut)
    ratios = np.array([0.0 if noise[x.at] else len(t) / max(1, x.tags) for x, t in zip(lines, texts, strict=True)])
    if not ratios.any():
        return ""
    content = content_lines(ratios, sigma, cut)
    held = [0.0] * len(elements)
    for x, t, c in zip(lines, texts, content, strict=True):
        held[x.at] += len(t) * bool(c)
    held = add_up(elements, held)
    region = max((i for i, e in enumerate(elements) if held[i] >= share * held[0] and e.name not in _TEXT), key=lambda i: elements[i].depth)
    # up to the outermost article or else main around it; where there is none, to what holds all content lines
    around = [region]
    while around[-1]:
        around.append(elements[around[-1]].up)
    own = next((i for kind in ("article", "main") for i in reversed(around) if elements[i].name == kind), None)
    region = own if own is not None else next(i for i in around if held[i] >= held[0])
    bare = elements[region].name in ("", "html", "body")  # lines of links alone may be menus there, if not content
    inside = [False] * len(elements)
    inside[region] = True
    for i in range(1, len(elements)):
        inside[i] = inside[i] or inside[elements[i].up]
    out = []
    for x, t, c in zip(lines, texts, content, strict=True):
        menu = (elements[x.at].item or bare and not c) and x.link >= len(t.replace(" ", "")) > 0
        if inside[x.at] and not noise[x.at] and not menu:
            out.append(t)
    return "\n".join(out)


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages (page_id, url, html).

    Null and empty pages give the empty text; null ids and urls stay null; repeated rows are repeated; other columns are
    ignored. Unclosed and deeply nested markup is read like any other.
    """

    def run(batch: pa.RecordBatch) -> dict:
        texts = [extract(h) for h in batch.column("html").to_pylist()]
        return {"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

    rows = pages.selectExpr("CAST(page_id AS BIGINT) AS page_id", "CAST(url AS STRING) AS url", "CAST(html AS STRING) AS html")
    return map_batches(rows, run, "page_id long, url string, text string, n_chars long")


def op8_text_tag_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
