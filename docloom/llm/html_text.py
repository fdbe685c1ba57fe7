"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One attribute as HTML reads it: a quote opens a value only after =; elsewhere it is part of a name.
ATTR = r"[^\s/>][^\s/>=]*(?:\s*=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|[^\s>\"'][^\s>]*)?)?"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[\s/]+|{ATTR})*+)(?:>|\Z)", re.S)
#: Their content is no text.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "select", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
_END = {tag: re.compile(rf"</{tag}(?=[\s>/]|\Z)[^>]*>?", re.I) for tag in RAW}
ASIDE = {"nav", "header", "footer", "aside", "form", "button", "menu", "dialog", "head"} | RAW
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
#: Words of class and id that mark what surrounds an article.
WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "breadcrumb", "breadcrumbs", "comment", "comments", "disqus", "replies",
    "cookie", "cookies", "consent", "gdpr", "footer", "masthead", "menu", "nav", "navbar", "navigation", "topbar", "modal", "popup", "overlay",
    "newsletter", "subscribe", "subscription", "promo", "promoted", "sponsor", "sponsored", "sidebar", "toolbar", "widget", "pagination", "pager", "login", "signup", "copyright",
}
#: Words that name parts of articles too: such a block goes unless its lines are as long as prose.
HINTS = {"banner", "header", "notice", "promotion", "recommended", "related", "share", "sharing", "social", "alert", "skip"}
PROSE = 80
MAIN = {"article", "main"}
ATTRIBUTE = re.compile(r"([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>\"'][^\s>]*))?)?")
SPACE = re.compile(r"\s+")
#: Lines in a window of the distribution, and the characters outside links a window must sum to for a surge on a page that
#: marks no article.
WINDOW, SURGE = 3, 80
#: Elements whose end tags may be left out: a new one of the same group closes the last.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Block elements that end an open paragraph.
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}


PLAIN, HINTED, OUTSIDE = 0, 1, 2


def _place(tag: str, attributes: str) -> int:
    """Does an element of this tag hold what is not the article, or may it?"""
    if tag in ASIDE:
        return OUTSIDE
    if not attributes or tag in ("body", "html"):
        return PLAIN
    found = PLAIN
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return OUTSIDE
        if name == "role" and value.lower() in ROLES:
            return OUTSIDE
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return OUTSIDE
        if name in ("class", "id") and tag not in MAIN:
            said = set(re.split(r"[^a-z]+", value.lower()))
            if said & WORDS:
                return OUTSIDE
            found = HINTED if said & HINTS else found
    return found


@dataclass
class Line:
    """A block's text: how much of it is outside links, is it inside an article, the hinted block it belongs to (or 0)."""

    text: str
    free: int
    main: bool
    hinted: int


def lines(html: str) -> list[Line]:
    """The page as lines, one for each block, without what surrounds articles by its markup. Linear in the page's length."""
    out: list[Line] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, int, bool]] = []  # tag, in main, outside, hinted block, in a link
    blocks: list[int] = []  # places in the stack of elements that are not inline
    opened: Counter = Counter()  # open elements by tag
    state = (False, False, 0, False)
    linked = hints = 0

    def close() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", unescape("".join(parts))).strip()
            if text and not state[1]:
                out.append(Line(text, max(0, len(text) - linked), state[0], state[2]))
            parts.clear()
            linked = 0

    def drop(size: int) -> None:
        nonlocal state
        while len(stack) > size:
            opened[stack.pop()[0]] -= 1
        while blocks and blocks[-1] >= size:
            blocks.pop()
        state = stack[-1][1:] if stack else (False, False, 0, False)

    def say(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            if state[3]:
                linked += len(text)

    at, end = 0, len(html)
    while at < end:
        m = TOKEN.search(html, at)
        if not m:
            say(html[at:])
            break
        say(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened[tag] > 0:
                if tag not in INLINE:
                    close()
                size = len(stack) - 1
                while stack[size][0] != tag:
                    size -= 1
                drop(size)
            continue
        if tag not in INLINE:
            close()
        if tag in VOID or m[3].endswith("/"):
            continue
        if tag in RAW:
            stop = _END[tag].search(html, at)
            at = stop.end() if stop else end
            continue
        last = stack[blocks[-1]][0] if blocks else ""  # the innermost element that is not inline
        if (tag in ENDS_P and last == "p") or last in CLOSES.get(tag, ()):
            drop(blocks[-1])
        place = _place(tag, m[3])
        if place == HINTED and not state[2]:
            hints += 1
        if tag not in INLINE:
            blocks.append(len(stack))
        state = (state[0] or tag in MAIN, state[1] or place == OUTSIDE, state[2] or (hints if place == HINTED else 0), state[3] or tag == "a")
        stack.append((tag, *state))
        opened[tag] += 1
    close()
    return out


def main_text(html: str | None) -> str:
    """The text between the surge and the dive points of the line-block distribution.

    A line weighs its characters outside links. First the lines of a block whose class or id hints at surroundings weigh
    nothing, unless they are on average as long as prose. Then markup is weighed: if elements that mark an article hold half
    of the page's weight or more, they are the article, of which every line counts in full, and what is beside them weighs
    nothing; else the marking says nothing. The distribution at a line is the weight of WINDOW lines around it. It surges
    where it rises over the threshold (one character where an article is marked, else SURGE) and dives where a whole window
    weighs nothing; all lines from the first to the last with weight in between are kept, links too.
    """
    found = lines(html or "")
    if not found:
        return ""
    size, free = Counter(), Counter()
    for x in found:
        size[x.hinted] += 1
        free[x.hinted] += x.free
    found = [x for x in found if not x.hinted or free[x.hinted] >= PROSE * size[x.hinted]]
    weight = np.array([x.free for x in found], np.int64)
    main = np.array([x.main for x in found], bool)
    marked = bool(main.any()) and 2 * int(weight[main].sum()) >= int(weight.sum())
    if marked:
        found, weight = [x for x in found if x.main], np.array([len(x.text) for x in found if x.main], np.int64)
    if not len(weight):
        return ""
    if not weight.any():  # links only
        weight = np.array([len(x.text) for x in found], np.int64)
    sums = np.convolve(weight, np.ones(WINDOW, np.int64))[WINDOW // 2 :][: len(weight)]
    least = 1 if marked else min(SURGE, int(sums.max()))
    kept: list[str] = []
    k, n = 0, len(weight)
    while k < n:
        stop = k
        while stop < n and sums[stop] > 0:  # the dive
            stop += 1
        if stop > k and sums[k:stop].max() >= least:
            full = np.flatnonzero(weight[k:stop]) + k
            kept += [x.text for x in found[full[0] : full[-1] + 1]]
        k = stop + 1
    return " ".join(kept)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Null and empty html give an empty text; malformed markup (open tags, quotes or comments) is read to its end; a page of
    any length is read whole. Every row gives a row, repeated ones too; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
