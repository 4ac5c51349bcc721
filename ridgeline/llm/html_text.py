"""Main text of web pages by tag-path ratios.

*Blocks.*  One pass over the markup keeps the stack of open elements and cuts the text into
blocks: a block ends where an element that is not inline starts or ends.  Every block has
the tag path of its element (tags with their class words, digits left out).

*Ratios.*  For every path the text length, the punctuation and the linked text of its blocks
are summed, giving a text ratio and a punctuation ratio per block.  Along the page both series
are smoothed with a Gaussian, averaged per path again and fused to
``text * (1 + punctuation) * unlinked share ** 2``.  Paths at or above the standard
deviation of that score over the page's blocks are content.

*Names.*  Elements that say what they are (``nav``, ``footer``, ``aside``, a class ``ad`` or
``comments``, a role) score nothing with all that is inside them.  If ``article`` or ``main``
elements hold text, only their paths compete.

*Page region.*  The content blocks span a region: the ``article``/``main`` elements that hold
them, else the smallest element around them, from the heading before the first to the last
one.  All its blocks that are neither named above nor lists of links belong to the text, so
that short paragraphs, headings and captions stay.

White space and ``<br>`` inside a block are one space; blocks are joined by one newline.  Character references are
decoded after the markup is gone, so a decoded ``<`` is text.

Nulls: a null html gives an empty text; page_id and url are handed through as they are.  An empty or very long page is
read whole, in one pass; unclosed tags, quotes, comments and scripts end at the end of the page.
Repeated rows and null ids give one row each.  An empty table gives no rows.
Columns other than page_id, url and html are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import parts, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: their content is no markup
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math mi mn mo "
                   "mrow msub msup nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: elements that a start tag ends, besides an open paragraph
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"},
        "tbody": {"td", "th", "tr", "thead", "tbody"}, "tfoot": {"td", "th", "tr", "tbody"}}
#: never part of an article, whatever is inside
NEVER = frozenset("nav footer aside head noscript template svg canvas object audio video dialog menu button select datalist".split())
#: not part of it unless they hold the article
UNLESS_AROUND = frozenset("form header".split())
ROLES = frozenset("navigation contentinfo complementary search dialog alert alertdialog menu menubar banner form toolbar".split())
NAMES = frozenset("ad ads adsense adv menu nav navbar navi navigation toc aside notice notices alert alerts banner popup modal overlay gdpr "
                  "consent signup login search share sharing social related recommended recommendations pagination pager "
                  "toolbar copyright legal widget widgets skip skiplink masthead reply replies respond discussion disqus thread newsletter".split())
STEMS = ("comment", "advert", "sidebar", "breadcrumb", "cookie", "subscri", "sponsor", "promo", "footer", "header")
#: words of a class that talk about the page, not the element
ABOUT = frozenset("has with without no is not show hide enabled disabled allowed open closed".split())
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：»«\"()]")
RADIUS = 2
MENU_LINKS, MENU_ITEMS = 0.9, 3

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*+)>""")
_TAG_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
MAX_BAD_QUOTES = 50


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """``("text", text, "")``, ``("open", tag, attributes)`` and ``("close", tag, "")`` in page order, comments left out."""
    at, bad, end = 0, 0, len(html)
    last = html.rfind(">")
    while at < end:
        lt = html.find("<", at)
        if lt < 0 or lt > last:  # nothing can be a tag any more
            stop = end if lt < 0 or not re.match(r"<[a-zA-Z/!?]", html[lt:lt + 2]) else lt
            yield "text", html[at:stop], ""
            return
        nxt = html[lt + 1:lt + 2]
        if lt > at:
            yield "text", html[at:lt], ""
        if html.startswith("<!--", lt):
            close = html.find("-->", lt + 2)
            at = end if close < 0 else close + 3
        elif nxt in ("!", "?") or (nxt == "/" and not html[lt + 2:lt + 3].isalpha()):
            at = html.find(">", lt) + 1
        else:
            m = _TAG.match(html, lt) if bad < MAX_BAD_QUOTES else None
            if m is None and (nxt == "/" or (nxt.isalpha() and nxt.isascii())):
                bad += 1  # a quote that is never closed
                m = _TAG_PLAIN.match(html, lt)
            if m is None:
                yield "text", "<", ""
                at = lt + 1
                continue
            at, tag = m.end(), m.group(2).lower()
            if m.group(1):
                yield "close", tag, ""
            elif tag in RAW:
                m = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = m.end() if m else end
            else:
                yield "open", tag, m.group(3)


def attributes(s: str) -> dict[str, str]:
    """Lower-cased names with their decoded values."""
    return {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTR.findall(s)}


def words(value: str) -> set[str]:
    """Lower-cased words of class and id values (camel case is cut); those of names like ``has-sidebar`` left out."""
    out: set[str] = set()
    for name in value.split():
        parts_ = [w.lower() for w in _WORD.findall(name)]
        if not ABOUT.intersection(parts_):
            out.update(parts_)
    return out


def says_no(tag: str, attr: dict[str, str]) -> int:
    """2: never article, 1: not unless it holds the article, 0: nothing said."""
    if tag in NEVER:
        return 2
    if tag in ("html", "body", "main"):
        return 0
    if tag in UNLESS_AROUND or attr.get("role", "").lower() in ROLES:
        return 1
    names = words(attr.get("class", "") + " " + attr.get("id", "") + " " + attr.get("aria-label", ""))
    if any(w.startswith("comment") for w in names):
        return 2
    if tag == "article":
        return 0
    if tag in HEADINGS:
        names = {w for w in names if not w.startswith("header")}
    return int(bool(names & NAMES) or any(w.startswith(s) or w.endswith(s) for w in names for s in STEMS))


class Page:
    """Elements (in document order) and text blocks of one page."""

    def __init__(self, html: str):
        self.parent, self.tag, self.no, self.path, self.depth = [-1], [""], [0], [0], [0]
        self.text: list[str] = []
        self.linked: list[int] = []
        self.of: list[int] = []
        self.main: list[int] = []
        self._paths: dict[tuple[int, str], int] = {}
        self._read(html)

    def _open(self, parent: int, tag: str, attr: str) -> int:
        a = attributes(attr) if attr and not attr.isspace() else {}
        label = tag + "." + " ".join(sorted(re.sub(r"\d+", "", a.get("class", "")).split()))
        self.parent.append(parent)
        self.tag.append(tag)
        self.no.append(says_no(tag, a))
        self.path.append(self._paths.setdefault((self.path[parent], label), len(self._paths) + 1))
        self.depth.append(self.depth[parent] + 1)
        k = len(self.tag) - 1
        if not self.no[k] and (tag in ("article", "main") or a.get("role", "").lower() == "main" or a.get("itemprop", "").lower() == "articlebody"):
            self.main.append(k)
        return k

    def _read(self, html: str) -> None:
        stack, here, linked, link_at = [0], [], 0, 0
        open_tags: dict[str, int] = {}

        def cut():
            nonlocal here, linked
            s = " ".join("".join(here).split())
            if s:
                self.text.append(s)
                self.linked.append(min(linked, len(s)))
                self.of.append(stack[-1])
            here, linked = [], 0

        def pop():
            nonlocal link_at
            open_tags[self.tag[stack.pop()]] -= 1
            if link_at > len(stack):
                link_at = 0

        for kind, x, attr in tokens(html):
            if kind == "text":
                s = unescape(x) if "&" in x else x
                here.append(s)
                if link_at:
                    linked += len(" ".join(s.split()))
            elif x in INLINE or x == "br":
                if x == "a":
                    link_at = len(stack) if kind == "open" else 0
                elif x == "br":
                    here.append(" ")
            elif kind == "open":
                cut()
                if x in VOID or (x in ("html", "body") and open_tags.get(x)):
                    continue
                if len(stack) > 1 and self.tag[stack[-1]] == "head" and x not in IN_HEAD:
                    pop()
                ends = ENDS.get(x, ())
                while len(stack) > 1 and (self.tag[stack[-1]] == "p" or self.tag[stack[-1]] in ends):
                    pop()
                stack.append(self._open(stack[-1], x, attr))
                open_tags[x] = open_tags.get(x, 0) + 1
            else:
                cut()
                if open_tags.get(x):
                    while self.tag[stack[-1]] != x:
                        pop()
                    pop()
        cut()

    def outside(self) -> np.ndarray:
        """For every element whether it is, or lies in, one that is no article (headings of an article's own header stay)."""
        n = len(self.tag)
        around = np.zeros(n, bool)  # holds an article
        for k in self.main:
            p = self.parent[k]
            while p >= 0 and not around[p] and self.no[p] < 2:
                around[p] = True
                p = self.parent[p]
        inside = np.zeros(n, bool)
        out = np.zeros(n, bool)
        head = np.zeros(n, bool)  # in a header of the article
        mains = set(self.main)
        for k in range(1, n):
            p = self.parent[k]
            inside[k] = inside[p] or k in mains
            own = self.no[k] == 2 or (self.no[k] == 1 and not around[k])
            header = own and self.no[k] == 1 and inside[p] and self.tag[k] == "header"
            head[k] = head[p] or header
            out[k] = out[p] or (own and not header)
        return out | (head & ~np.isin(np.array(self.tag), list(HEADINGS)))

    def mains(self) -> np.ndarray:
        """For every element the outermost article it lies in (a ``main`` that holds articles is none), else 0."""
        own, holds = np.zeros(len(self.tag), bool), np.zeros(len(self.tag), bool)
        own[self.main] = True
        for k in range(len(own) - 1, 0, -1):
            holds[self.parent[k]] |= holds[k] or (own[k] and self.tag[k] == "article")
        at = np.zeros(len(own), int)
        for k in range(1, len(at)):
            at[k] = at[self.parent[k]] or (k if own[k] and (self.tag[k] == "article" or not holds[k]) else 0)
        return at


def smooth(x: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Gaussian mean over neighbouring blocks; the weights of missing neighbours are left out."""
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / max(1.0, radius / 2)) ** 2)
    return np.convolve(x, w)[radius:len(x) + radius] / np.convolve(np.ones(len(x)), w)[radius:len(x) + radius]


def path_scores(path: np.ndarray, chars: np.ndarray, marks: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per path: score, linked share, number of blocks.  ``path`` numbers the paths of the blocks from 0."""
    n = np.bincount(path).astype(float)
    by = lambda x: np.bincount(path, x)
    text, punct = by(chars) / n, by(marks) / n
    share = by(linked) / np.maximum(by(chars), 1)
    text_s, punct_s = by(smooth(text[path])) / n, by(smooth(punct[path])) / n
    # smoothing lends a path weight from its neighbours, never more than it has by itself
    return np.minimum(text_s, text) * (1 + np.minimum(punct_s, punct)) * (1 - np.minimum(share, 1)) ** 2, share, n


def main_text(html: str | None) -> str:
    """The article of a page, one block a line."""
    if not html:
        return ""
    page = Page(html)
    if not page.text:
        return ""
    of = np.array(page.of)
    out = page.outside()[of]
    left = np.flatnonzero(~out)
    main = page.mains()
    said = left[(main[of[left]] > 0) & (np.array(page.linked)[left] < np.array([len(page.text[k]) for k in left]))]
    if len(said):
        left = left[main[of[left]] > 0]
    if not len(left):
        return ""
    path = np.unique(np.array(page.path)[of[left]], return_inverse=True)[1]
    chars = np.array([len(page.text[k]) for k in left], float)
    marks = np.array([len(PUNCTUATION.findall(page.text[k])) for k in left], float)
    score, share, n = path_scores(path, chars, marks, np.array([page.linked[k] for k in left], float))
    menu = (share >= MENU_LINKS) & (n >= MENU_ITEMS)
    of_block = score[path]
    chosen = (of_block >= of_block.std()) & ~menu[path]
    if not chosen.any():
        return ""
    first, last = np.flatnonzero(chosen)[[0, -1]]
    if len(said):
        region = np.isin(main[of[left]], main[of[left[chosen]]])
    else:
        root = _common(page, int(of[left[first]]), int(of[left[last]]))
        inside = np.zeros(len(page.tag), bool)
        inside[root] = True
        for k in range(root + 1, len(inside)):
            inside[k] = inside[page.parent[k]]
        span = np.arange(len(left))
        region = inside[of[left]] & (span >= first) & (span <= last)
        while first and page.tag[of[left[first - 1]]] in HEADINGS:
            first -= 1
            region[first] = True
    return "\n".join(page.text[k] for k, keep in zip(left, region & ~menu[path]) if keep)


def _common(page: Page, a: int, b: int) -> int:
    """The smallest element that holds both."""
    while a != b:
        if page.depth[a] >= page.depth[b]:
            a = page.parent[a]
        else:
            b = page.parent[b]
    return a


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, 64):
        text = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())],
            ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    kind = dict(pages.dtypes)["page_id"]
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars bigint")


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
