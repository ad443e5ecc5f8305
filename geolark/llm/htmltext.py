"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one a block element. Text lengths are summed over sliding windows of lines, and the article lies between the
points where the sums surge and dive, on every page. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments count as empty lines first, and elements say within which borders the range lies: those of every article (or main) element with
dense text if these hold most of it, else of the deepest element that does, else the page. Inside its borders each range goes from the first dense line to
the last, and on by REACH lines at most, so that headings and closing lines stay.

Names of elements are taken at their word, except for forms; words of class, id and role names are hints. A hint never concerns a heading,
an inline element, code, or what holds an article; words that articles use too (`related`, `legal`) count only where the text is
links or short lines; and if nothing dense is left outside the elements with hints, the one with the most text counts as the page.
"""

from __future__ import annotations

import bisect
import html
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window, and the characters in it from which it is dense.
WINDOW, SURGE = 3, 86
#: Lines that a range goes on at either end.
REACH = 16
#: Share of the dense text in an element that counts as the article's; how many hints around an article are overruled one inside another.
MOST, HINTS = 0.7, 8
#: Characters of the mean line, and share of them in links, up to and from which a text is no prose.
SHORT, LINKED = 60, 0.5

# Element names and the words of class, id and role names that mark what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
LEFT_OUT = set("head nav footer aside menu dialog select option button svg canvas object audio video map datalist".split())
FORMS = set("form fieldset".split())
HOLDERS = set("article main section div td center".split())
TEXT = set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd figcaption".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNMARKED = INLINE | set("h1 h2 h3 h4 h5 h6 pre html body main".split())
COMMENT_WORDS = set("comments commentlist disqus respond replies".split())
OTHER_WORDS = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adunit sponsor sponsored sponsors promo promos promotion promoted "
    "banner banners cookie cookies consent gdpr notice notices notification notifications popup modal overlay "
    "sidebar sidebars sidenav nav navbar navigation menu menus menubar breadcrumb breadcrumbs pagination pager toolbar topbar masthead "
    "footer copyright subscribe newsletter signup signin login hidden contentinfo alertdialog".split()
)
PROSE_WORDS = set(
    "alert alerts aside rail widget widgets header legal disclaimer comment commentary reply response responses discussion "
    "share sharing sharebar social related recommended recommendations subscription search form complementary".split()
)
WITHOUT = set("no not without has have with".split())
ARTICLE_WORDS = set("article post entry story content main page blog".split())

_TAG = re.compile(r"<(?:!--|(/?)([a-zA-Z][^\s/>]*)|[!?])")
_ATTR = re.compile(r"(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_QUOTE = re.compile(r"[\"'>]")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: What a hint says: no article unless its text is prose, no article, reader comments; and an element that is left out for sure.
MAYBE, OTHER, COMMENTS, OUT = 1, 2, 3, 4


def _mark(tag: str, attrs: str, in_article: bool) -> int:
    """What the name and the attributes of an element say: 0 for nothing, MAYBE, OTHER, COMMENTS or OUT."""
    if tag in LEFT_OUT or tag == "header" and not in_article:
        return OUT
    found = MAYBE if tag in FORMS else 0
    if not attrs or attrs == "/":
        return found
    for m in _ATTR.finditer(attrs):
        name, value = (m[1] or "").lower(), m[2] or m[3] or m[4] or ""
        if m[5] or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return OUT
        if name in ("class", "id", "role") and tag not in UNMARKED:
            for one in value.split():
                words = [w.lower() for w in _WORD.findall(one)]
                if WITHOUT & set(words) or words and words[-1] in ("header", "search") and any(w in ARTICLE_WORDS for w in words):
                    continue
                for level, known in ((COMMENTS, COMMENT_WORDS), (OTHER, OTHER_WORDS), (MAYBE, PROSE_WORDS)):
                    if any(w in known for w in words):
                        found = max(found, level)
    return found


@dataclass
class Element:
    """An element that holds blocks, or has a hint: its name, the element around it (-1: none), how deep it is, and its lines."""

    name: str
    parent: int
    depth: int
    hint: int
    first: int
    last: int = -1


@dataclass
class Page:
    """The lines outside what is left out for sure, whether each is a paragraph, heading or the like, its characters in links, and the elements in page order."""

    lines: list[str]
    is_text: list[bool]
    linked: list[int]
    elements: list[Element]


class Tags:
    """Where tags end. A `>` in quotes doesn't end one, as long as the quotes of the page close; each character is looked at a fixed number of times."""

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def end(self, at: int) -> int:
        """Place of the `>` of a tag that goes on from `at`; -1 if the page has none."""
        if at > self.last:
            return -1
        place = at
        while self.quotes:
            m = _QUOTE.search(self.page, place)
            if m and m[0] == ">":
                return m.start()
            place = self.page.find(m[0], m.end()) + 1 if m else 0
            if not place:
                self.quotes = False  # some quote is open to the end of the page: from here on quotes don't count
        return self.page.find(">", at)


def lines_of(page: str) -> Page:
    """A page's lines and elements, in one pass whose time grows with the page's length, however broken it is."""
    out_ = Page([], [], [], [])
    lines, elements = out_.lines, out_.elements
    # name, left out, the element it is or is in, whether in an article, the innermost name that is not inline
    stack: list[tuple[str, bool, int, bool, str]] = [("", False, -1, False, "")]
    open_names: Counter[str] = Counter()
    parts: list[str] = []
    in_links = 0
    at, n, tags = 0, len(page), Tags(page)

    def close_line() -> None:
        nonlocal in_links
        if parts:
            text = " ".join("".join(map(html.unescape, parts)).split())  # a reference never spans a tag
            parts.clear()
            if text:
                lines.append(text)
                out_.is_text.append(stack[-1][4] in TEXT)
                out_.linked.append(min(in_links, len(text)))
        in_links = 0

    def add(text: str) -> None:
        nonlocal in_links
        parts.append(text)
        if open_names["a"]:
            in_links += len(text)

    def leave(k: int) -> None:
        """Close everything from place k of the stack on."""
        for name, _, own, *_ in reversed(stack[k:]):
            open_names[name] -= 1
            if own >= 0 and elements[own].last < 0 and own != stack[k - 1][2]:
                if elements[own].hint or name not in INLINE:
                    close_line()
                elements[own].last = len(lines)
        del stack[k:]

    while at < n:
        m = _TAG.search(page, at)
        out = stack[-1][1]
        if not m:
            if not out:
                add(page[at:])
            break
        if m.start() > at and not out:
            add(page[at : m.start()])
        at = m.end()
        if m[0] == "<!--":
            end = page.find("-->", at)
            at = n if end < 0 else end + 3
            continue
        if not m[2]:
            end = page.find(">", at)
            at = n if end < 0 else end + 1
            continue
        end = tags.end(at)
        if end < 0:
            if not out:
                add(m[0])  # no tag: plain text
            continue
        attrs, tag, at = page[at:end], m[2].lower(), end + 1
        if tag not in INLINE:
            close_line()
        if m[1]:
            if open_names[tag] > 0:
                leave(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag))
        elif tag in RAW:
            if not attrs.endswith("/"):
                found = re.compile(f"</{re.escape(tag)}[^>]*>", re.I).search(page, at)
                at = found.end() if found else n
        elif tag not in VOID and not (attrs.endswith("/") and tag in ("svg", "path")):
            if tag in ("article", "main", "body") and out:
                # an article never stands in a menu: whatever was left open ends here
                k = len(stack)
                while stack[k - 1][1]:
                    k -= 1
                leave(k)
            _, out, around, inside, block = stack[-1]
            mark = _mark(tag, attrs, inside)
            own = around
            if not out and mark < OUT and (tag in HOLDERS or mark):
                close_line()
                own = len(elements)
                elements.append(Element(tag, around, elements[around].depth + 1 if around >= 0 else 0, mark, len(lines)))
            stack.append((tag, out or mark == OUT, own, inside or tag in ("article", "main"), block if tag in INLINE else tag))
            open_names[tag] += 1
    close_line()
    leave(1)
    return out_


def dense_lines(lengths: list[int]) -> list[int]:
    """Places of the dense lines: the longest line of each window whose sum reaches SURGE, or a third of the largest sum if that is less.

    The first is where the sums surge, the last where they dive for good. A window counts for its longest line, so that a short one before the
    article is not taken for its start.
    """
    if not any(lengths):
        return []
    padded = np.concatenate([[0], np.cumsum(lengths + [0] * (WINDOW - 1))])
    sums = padded[WINDOW:] - padded[:-WINDOW]
    return sorted({i + int(np.argmax(lengths[i : i + WINDOW])) for i in np.flatnonzero((sums > 0) & (sums >= min(SURGE, int(sums.max()) // 3))).tolist()})


def _outermost(elements: list[Element], which: Callable[[Element], bool]) -> list[Element]:
    """The elements of a kind that are in no other of it, in page order."""
    found: list[Element] = []
    for x in elements:
        if which(x) and x.last > x.first and (not found or x.first >= found[-1].last):
            found.append(x)
    return found


def _within(x: Element, others: list[Element]) -> bool:
    """Whether one of `others`, which follow each other, holds x."""
    k = bisect.bisect_right(others, x.first, key=lambda o: o.first) - 1
    return k >= 0 and x.last <= others[k].last


def no_article(page: Page) -> set[int]:
    """The elements whose hint holds: none that has an article inside, and MAYBE only for links and short lines."""
    size = np.concatenate([[0], np.cumsum(list(map(len, page.lines)))])
    links = np.concatenate([[0], np.cumsum(page.linked)])
    articles = sorted(x.first for x in page.elements if x.name in ("article", "main") and x.last > x.first)
    out = set()
    for i, x in enumerate(page.elements):
        if not x.hint or x.name in ("article", "main") or x.last <= x.first:
            continue
        k = bisect.bisect_left(articles, x.first)
        if k < len(articles) and articles[k] < x.last:
            continue
        chars = int(size[x.last] - size[x.first])
        if x.hint > MAYBE or chars <= SHORT * (x.last - x.first) or int(links[x.last] - links[x.first]) >= LINKED * chars:
            out.add(i)
    return out


def article_lines(page: Page) -> list[int]:
    """Places of the article's lines: from the surge of the windowed sums to their dive within the borders of elements, and REACH lines on."""
    n = len(page.lines)
    if not n:
        return []
    size = np.fromiter(map(len, page.lines), np.int64, n)
    hinted = no_article(page)
    inside = list(enumerate(page.elements))
    low, high = 0, n
    for depth in range(HINTS + 1):
        hints = _outermost([x for i, x in inside if i in hinted], lambda x: True) if depth < HINTS else []
        open_ = np.zeros(n, bool)
        open_[low:high] = True
        for x in hints:
            open_[x.first : x.last] = False
        # lines under a hint are empty, as long as something dense is left
        lengths = np.where(open_, size, 0)
        articles = [x for x in _outermost([x for _, x in inside], lambda x: x.name in ("article", "main")) if open_[x.first : x.last].any()]
        # beside an article with text only what is in an article may be one after all, and no comments
        may = [x for x in hints if x.hint < COMMENTS and _within(x, articles)] if articles else hints
        most = max(may, key=lambda x: int(size[x.first : x.last].sum()), default=None)
        if most is None or np.convolve(lengths, np.ones(WINDOW, np.int64)).max() >= SURGE or size[most.first : most.last].sum() <= lengths.sum():
            break
        if articles:  # the article is written in it
            hinted = {i for i in hinted if page.elements[i] is not most}
            continue
        low, high = most.first, most.last
        inside = [(i, x) for i, x in inside if low <= x.first and x.last <= high and x.depth > most.depth]
    dense = dense_lines(lengths.tolist())
    if not dense:
        return []
    weight = np.zeros(n + 1, np.int64)
    weight[np.array(dense) + 1] = size[dense]
    upto = np.cumsum(weight)
    held = lambda x: int(upto[x.last] - upto[x.first])
    own = [x for _, x in inside]
    for kind in ("article", "main"):
        found = [x for x in _outermost(own, lambda x: x.name == kind) if held(x)]  # noqa: B023
        if 2 * sum(map(held, found)) >= int(upto[-1]):
            return [i for x in found for i in _between(x.first, x.last, dense, open_, None)]
    most = max((x for x in own if held(x) >= MOST * int(upto[-1])), key=lambda x: x.depth, default=None)
    if most:
        return _between(most.first, most.last, dense, open_, None)
    return _between(low, high, dense, open_, page.is_text)


def _between(first: int, last: int, dense: list[int], open_: np.ndarray, is_text: list[bool] | None) -> list[int]:
    """The open lines from the first dense one of first..last to the last, and up to REACH open ones on both sides; only text blocks where no element is the border."""
    mine = (first + np.flatnonzero(open_[first:last])).tolist()
    own = dense[bisect.bisect_left(dense, first) : bisect.bisect_left(dense, last)]
    a, b = bisect.bisect_left(mine, own[0]), bisect.bisect_left(mine, own[-1]) + 1
    low, high = max(0, a - REACH), min(len(mine), b + REACH)
    while a > low and (is_text is None or is_text[mine[a - 1]]):
        a -= 1
    while b < high and (is_text is None or is_text[mine[b]]):
        b += 1
    return mine[a:b]


def main_text(page: str | None) -> str:
    """The article of one page: blocks in page order joined by a space, character references decoded; empty if there is none."""
    found = lines_of(page or "")
    return " ".join(found.lines[i] for i in article_lines(found))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """`pages` with `text_col`: the main text of the whole of `html_col`.

    Null html counts as empty, and a page without text gives an empty one. Pages are read whole, however long and broken; repeated rows stay; other columns stay as
    they are, but a column that is already named `text_col` gives way to the text; an empty table gives an empty result. All articles with dense text
    count.
    """

    @F.pandas_udf("string")
    def of(column):
        return column.map(main_text)

    return pages.withColumn(text_col, of(F.coalesce(F.col(f"`{html_col}`"), F.lit(""))))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
