"""Main text of web pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of text blocks. Each block has its word count and link density, those
of its neighbours, whether it is a heading, and whether the nearest telling element around it
belongs to the page's frame or to an article. A decision tree, grown by Gini impurity on the small
labelled table below, says which blocks are main text.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns

#: The beginning of a tag; a tag without attribute values; what ends a tag or begins a quoted value.
_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_PLAIN = re.compile(r"([^>=]*+)>")
_STOP = re.compile(r""">|=\s*["']""")
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt msup msub msubsup mover munder semantics annotation".split())
_UNSEEN = set("script style noscript template head title svg iframe select textarea canvas audio video".split())
_FRAME_TAGS = set("nav footer aside form menu dialog button fieldset".split())
_FRAME_WORDS = set("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies disqus foot footer form gdpr head header masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo related reply respond search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split())
_ARTICLE_WORDS = set("article articlebody content entry main post story".split())
_VOID = set("area base br col embed hr img input link meta source track wbr".split())
_CLOSED_BY = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What ends an open paragraph: a new block.
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Frame words on these tell what is on the page, not what they are.
_WHOLE = set("html body main article".split())
#: Class names that begin so tell a state of the page, not what the element is: has-sidebar.
_STATES = ("has", "no", "with", "without", "is", "show", "hide")
#: Frame words of what may hold articles other than the page's.
_OTHER_WORDS = set("comment comments disqus promo related reply respond sponsored".split())
FRAME, NEUTRAL, ARTICLE = -1, 0, 1
#: A frame by a mere name, which an article or main inside it overrules; it counts as FRAME.
NAMED = -2

#: words, link density, words before, link density before, words after, link density after,
#: surroundings (-1 frame, 0 neither, 1 article), heading, main text or not.
LABELLED = (
    (60, 0.0, 45, 0.0, 70, 0.0, 0, 0, 1), (35, 0.1, 50, 0.0, 40, 0.0, 0, 0, 1), (120, 0.05, 6, 0.0, 80, 0.0, 0, 0, 1), (25, 0.0, 30, 0.1, 60, 0.0, 0, 0, 1),
    (8, 0.0, 60, 0.0, 50, 0.0, 0, 0, 1), (4, 0.0, 40, 0.0, 45, 0.1, 0, 0, 1), (90, 0.2, 40, 0.0, 2, 1.0, 0, 0, 1), (50, 0.0, 2, 1.0, 30, 0.0, 0, 0, 1),
    (6, 0.0, 2, 1.0, 60, 0.0, 0, 1, 1), (5, 0.0, 45, 0.0, 50, 0.0, 0, 1, 1), (9, 0.0, 0, 0.0, 70, 0.0, 0, 1, 1), (4, 0.0, 3, 1.0, 35, 0.1, 0, 1, 1),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0), (3, 1.0, 2, 1.0, 40, 0.0, 0, 0, 0), (2, 1.0, 60, 0.0, 2, 1.0, 0, 0, 0),
    (7, 1.0, 30, 0.0, 7, 1.0, 0, 0, 0), (8, 0.9, 7, 1.0, 6, 1.0, 0, 0, 0), (12, 0.6, 50, 0.0, 10, 0.7, 0, 0, 0), (25, 0.8, 20, 0.7, 25, 0.9, 0, 0, 0),
    (8, 0.1, 60, 0.0, 0, 0.0, 0, 0, 0), (5, 0.0, 55, 0.0, 0, 0.0, 0, 0, 0), (10, 0.3, 2, 1.0, 0, 0.0, 0, 0, 0), (6, 0.0, 1, 1.0, 8, 0.0, 0, 0, 0),
    (9, 0.0, 1, 1.0, 6, 0.0, 0, 0, 0), (3, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0), (4, 0.0, 2, 1.0, 2, 1.0, 0, 1, 0), (2, 0.0, 50, 0.0, 5, 1.0, 0, 1, 0),
    (60, 0.0, 45, 0.0, 70, 0.0, 1, 0, 1), (5, 0.0, 40, 0.0, 30, 0.0, 1, 0, 1), (1, 0.0, 6, 0.0, 9, 0.0, 1, 0, 1), (4, 0.0, 60, 0.0, 8, 0.1, 1, 0, 1),
    (7, 0.0, 9, 0.0, 50, 0.0, 1, 1, 1), (3, 0.0, 1, 1.0, 4, 0.0, 1, 1, 1), (2, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1), (30, 0.3, 50, 0.0, 40, 0.0, 1, 0, 1),
    (12, 0.4, 30, 0.0, 20, 0.1, 1, 0, 1), (200, 0.1, 5, 0.0, 0, 0.0, 1, 0, 1), (2, 0.0, 1, 1.0, 3, 0.0, 1, 1, 1), (6, 0.0, 9, 0.0, 6, 0.0, 1, 0, 1),
    (9, 1.0, 40, 0.0, 50, 0.0, 1, 0, 1), (4, 1.0, 30, 0.0, 25, 0.1, 1, 0, 1), (14, 1.0, 20, 0.1, 60, 0.0, 1, 0, 1), (6, 1.0, 8, 0.0, 30, 0.0, 1, 0, 1),
    (5, 1.0, 0, 0.0, 40, 0.0, 1, 1, 1), (4, 1.0, 2, 1.0, 30, 0.0, 1, 1, 1), (6, 1.0, 35, 0.0, 20, 0.0, 1, 1, 1), (12, 1.0, 40, 0.0, 0, 0.0, 1, 0, 1),
    (13, 0.0, 2, 1.0, 9, 1.0, 1, 0, 1), (3, 0.0, 1, 1.0, 2, 1.0, 1, 0, 1), (40, 0.0, 9, 1.0, 12, 1.0, 1, 0, 1), (20, 0.1, 3, 1.0, 30, 0.0, 1, 0, 1),
    (12, 0.6, 30, 0.0, 20, 0.0, 1, 0, 1), (20, 0.9, 30, 0.0, 20, 0.0, 1, 0, 1), (2, 0.0, 2, 1.0, 0, 0.0, 1, 0, 1), (6, 0.0, 0, 0.0, 2, 1.0, 1, 0, 1),
    (2, 1.0, 40, 0.0, 2, 1.0, 1, 0, 0), (3, 1.0, 60, 0.0, 0, 0.0, 1, 0, 0), (5, 1.0, 2, 1.0, 5, 1.0, 1, 0, 0), (1, 1.0, 9, 0.0, 1, 1.0, 1, 0, 0),
    (9, 0.0, 1, 1.0, 7, 0.0, -1, 0, 0), (30, 0.0, 2, 1.0, 60, 0.0, -1, 0, 0), (80, 0.0, 60, 0.0, 50, 0.0, -1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, -1, 0, 0),
    (12, 0.1, 60, 0.0, 0, 0.0, -1, 0, 0), (6, 0.0, 30, 0.0, 40, 0.0, -1, 1, 0), (150, 0.0, 20, 0.0, 90, 0.0, -1, 0, 0), (4, 0.5, 8, 0.0, 3, 0.0, -1, 0, 0),
    (200, 0.0, 20, 0.0, 5, 0.0, -1, 0, 0), (120, 0.0, 0, 0.0, 0, 0.0, -1, 0, 0), (90, 0.1, 8, 0.0, 12, 0.0, -1, 0, 0), (300, 0.0, 60, 0.0, 3, 1.0, -1, 0, 0),
    (250, 0.2, 0, 0.0, 0, 0.0, -1, 0, 0), (400, 0.3, 9, 0.0, 5, 0.2, -1, 0, 0), (150, 0.2, 20, 0.0, 5, 0.0, -1, 0, 0), (900, 0.2, 300, 0.1, 0, 0.0, -1, 0, 0),
    (70, 0.0, 9, 0.0, 25, 0.0, -1, 0, 0), (85, 0.0, 50, 0.0, 4, 0.0, -1, 0, 0), (500, 0.0, 500, 0.0, 20, 0.0, -1, 0, 0), (9, 0.0, 70, 0.0, 80, 0.0, -1, 1, 0),
    (2, 0.0, 50, 0.0, 45, 0.0, -1, 0, 0), (45, 0.1, 9, 0.0, 12, 0.0, -1, 0, 0), (5, 0.0, 0, 0.0, 6, 0.0, -1, 1, 0), (20, 0.0, 70, 0.0, 80, 0.0, -1, 0, 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A leaf (share of 1,), or (feature, threshold, tree up to it, tree beyond it)."""
    if depth == 0 or y.min() == y.max():
        return (float(y.mean()),)
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[:-1] + values[1:]) / 2:
            left = x[:, f] <= t
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
            if impurity < best[0] - 1e-12:
                best = (impurity, f, float(t))
    if best[0] == np.inf:
        return (float(y.mean()),)
    _, f, t = best
    left = x[:, f] <= t
    return f, t, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


@functools.cache
def tree() -> tuple:
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def classify(x: np.ndarray, node: tuple | None = None) -> np.ndarray:
    node = tree() if node is None else node
    if len(node) == 1:
        return np.full(len(x), node[0] > 0.5)
    out, left = np.zeros(len(x), bool), x[:, node[0]] <= node[1]
    if left.any():
        out[left] = classify(x[left], node[2])
    if not left.all():
        out[~left] = classify(x[~left], node[3])
    return out


def _names(attributes: str) -> set[str]:
    """Words of the class names, id, role and property of a tag, those of mere states left out."""
    found: set[str] = set()
    for m in _NAMED.finditer(attributes):
        for name in m[1].strip("\"'").lower().split():
            words = re.split(r"[^a-z]+", name)
            if words[0] not in _STATES:
                found.update(words)
    return found


def _surroundings(tag: str, attributes: str, around: int) -> int:
    """What an element makes of what is inside it, given what is around it."""
    names = _names(attributes) if attributes else set()
    frame = set() if tag in _WHOLE else names & _FRAME_WORDS
    if around == ARTICLE:
        frame -= {"head", "header"}  # of the article
    if tag in _FRAME_TAGS or frame & _OTHER_WORDS or tag == "header" and around != ARTICLE:
        return FRAME
    if frame:
        return FRAME if around == FRAME else NAMED
    if around != FRAME and (tag in ("article", "main") or around != NAMED and names & _ARTICLE_WORDS):
        return ARTICLE
    return around


class Scanner:
    """Markup of a page, from front to back, in time linear in its length whatever is left open."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        self.quoted = {'"': True, "'": True}  # whether the sign may come again

    def attributes(self, at: int) -> tuple[str, int] | None:
        """The attributes from here on and where the tag ends; quoted values may hold ">". A quote
        that nothing closes is a sign like others."""
        if m := _PLAIN.match(self.page, at):
            return m[1], m.end()
        begin = at
        while m := _STOP.search(self.page, at):
            at = m.end()
            if m[0] == ">":
                return self.page[begin : m.start()], at
            sign = m[0][-1]
            end = self.page.find(sign, at) if self.quoted[sign] else -1
            self.quoted[sign] = end >= 0
            if end >= 0:
                at = end + 1
        return None

    def tags(self) -> Iterator[tuple[str, bool, str, str]]:
        """(text before, whether it closes, tag, attributes); at last what is left, without a tag."""
        page, begin, at = self.page, 0, 0
        while 0 <= (at := page.find("<", at)) <= self.last:
            if page.startswith("<!--", at):
                yield page[begin:at], False, "", ""
                end = page.find("-->", at + 2)
                begin = at = len(page) if end < 0 else end + 3
                continue
            m = _OPEN.match(page, at)
            if m is None:
                if page.startswith(("<!", "<?"), at):
                    yield page[begin:at], False, "", ""
                    begin = at = page.index(">", at) + 1
                else:
                    at += 1
                continue
            found = self.attributes(m.end())
            if found is None:  # no tag ends any more
                break
            tag = m[2].lower()
            yield page[begin:at], bool(m[1]), tag, found[0]
            begin = at = found[1]
            if tag in _UNSEEN and not m[1] and not found[0].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                begin = at = page.find(">", end.end()) + 1 or len(page) if end else len(page)
        yield page[begin:], False, "", ""


def blocks(page: str) -> list[tuple[str, int, float, int, int]]:
    """(text, words, link density, surroundings, heading) of each block with text, in order."""
    out: list[tuple[str, int, float, int, int]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()  # tags on the stack
    parts: list[str] = []
    linked = links = 0  # characters inside links; open links
    heading = 0
    around = NEUTRAL

    def close() -> None:
        nonlocal linked
        if parts:
            words = html.unescape("".join(parts)).split()
            if words:
                size = sum(map(len, parts))
                out.append((" ".join(words), len(words), min(1.0, linked / size), max(around, FRAME), heading))
            parts.clear()
        linked = 0

    for text, closing, tag, attributes in Scanner(page).tags():
        if text:
            parts.append(text)
            if links:
                linked += len(text)
        if not tag:
            continue
        if tag in _UNSEEN:
            if not closing and not attributes.endswith("/"):
                close()
            continue
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br":
            parts.append(" ")
        if tag in _INLINE:
            continue
        close()
        if closing:
            links = 0
            if opened[tag]:
                while True:
                    name, around = stack.pop()
                    opened[name] -= 1
                    if name == tag:
                        break
        else:
            if tag in ("p", "li"):
                links = 0
            while stack and stack[-1][0] in _CLOSED_BY.get(tag, {"p"}):
                name, around = stack.pop()
                opened[name] -= 1
            if tag not in _VOID and not attributes.endswith("/"):
                stack.append((tag, around))
                opened[tag] += 1
                around = _surroundings(tag, attributes, around)
        heading = int(any(t in _HEADINGS for t, _ in stack[-2:]))
    close()
    return out


def main_texts(pages: list[str]) -> list[str]:
    """The main text of each page; all blocks are classified at once."""
    found = [blocks(p) for p in pages]
    rows = []
    for page in found:
        sizes = [(0, 0.0), *((w, d) for _, w, d, _, _ in page), (0, 0.0)]
        rows += [(w, d, *sizes[k], *sizes[k + 2], s, h) for k, (_, w, d, s, h) in enumerate(page)]
    good = iter(classify(np.array(rows, float)) if rows else [])
    return ["\n\n".join([b[0] for b in page if next(good)]) for page in found]


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """One row per row of pages: the kept columns and text, the whole main text.

    A null or empty page, and one without main text, give an empty text. Nulls and repeats in kept
    columns pass through; other columns are ignored, whatever their names; an empty table gives no
    rows.
    """

    def run(texts: list[str | None]) -> list[pa.Array]:
        return [pa.array(main_texts([t or "" for t in texts]), pa.string())]

    source = _free(keep, "html")
    rows = pages.select(*keep, F.col(html_col).alias(source))
    return append_columns(rows, source, list(keep), "text string", run)


def _free(taken: tuple[str, ...], name: str) -> str:
    while name in taken:
        name += "_"
    return name
