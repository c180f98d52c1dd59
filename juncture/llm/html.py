"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's parser streams a page's events. Text between block boundaries is a line with its ratio of
characters to tags; ratios are smoothed over neighbouring lines, and the lines above the ratios' standard deviation are the
cluster of dense text. The content region is the article and main elements if they have most of it, or else the lowest element
that holds all of it and all headings. Every line of the region counts, short ones too, except the text of elements whose
name, role or class says that they are no content. Such an element counts all the same if it turns out to hold the page's text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text isn't shown, and controls.
HIDDEN = frozenset("button canvas iframe input map noscript object script select style svg template textarea title".split())
#: Elements that hold no content unless the article is in them.
PARTS = frozenset("aside dialog footer menu nav".split())
#: The same by role, and by any word of a class or id.
SKIPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
SKIPPED_WORDS = frozenset(
    "ad ads adsense advert advertisement advertising adverts aside banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies copyright "
    "discussion disqus footer gdpr hidden legal login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination paywall popup promo promotion recommended related replies reply respond share sharebar sharing sidebar signup skip social sponsor "
    "sponsored subscribe subscription tagcloud teaser toolbar topbar tracking widget widgets".split()
)
#: Of an article's own class only these count.
ARTICLE_WORDS = frozenset(("comment", "comments", "teaser", "related"))
#: After these a word of a name tells of other elements: has-sidebar, no-comments.
OF_OTHERS = frozenset("has have hide no non not with without".split())
#: These are kept inside an article or main element, where a header holds its title.
HEADERS = frozenset(("header", "hgroup"))
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Elements that a start tag of the key ends if they are open, up to the nearest of the second set.
ENDS = {
    "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu"))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "td": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "th": (frozenset(("td", "th")), frozenset(("tr", "table"))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
NO_P_INSIDE = BLOCKS - frozenset("body html td th tr tbody thead tfoot dd dt li".split())
P_ENDS, P_LIMIT = frozenset(("p",)), frozenset(("body", "div", "td", "th", "li", "button", "article", "section", "main", "blockquote"))
#: Standard deviation of the smoothing in lines; share of the dense text from which an article speaks against a larger doubtful element.
SIGMA, RIVAL = 1.5, 0.2

_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")


def named_words(names: str | None) -> set[str]:
    """Words of a class or id in lower case; those after a "no" or "has" of the same name say nothing of the element."""
    found = set()
    for name in (names or "").split():
        for word in _WORDS.findall(name):
            word = word.lower()
            if word in OF_OTHERS:
                break
            found.add(word)
    return found


class PageLines(HTMLParser):
    """Lines of one page: (runs, tags, element). A run is (text, doubtful element around it, element, characters in links).

    Text of hidden elements and controls is left out as it comes. Whether the other elements without content are such is
    only known at the end of the page (``left_out``); until then their text is kept in runs of its own.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[list[tuple[str, int, int, int]], int, int]] = []
        #: of each element, numbered in the order of start tags: its parent, its tag ("article" and "main" also by role), the
        #: innermost doubtful element around it or itself
        self.parents: list[int] = [-1]
        self.kinds: list[str] = [""]
        self.within: list[int] = [0]
        #: doubtful elements, and whether these are so by their tag or role
        self.doubtful: dict[int, bool] = {}
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]
        self.runs: list[tuple[list[str], int, int, list[int]]] = []
        self.hidden = self.tags = self.in_link = self.articles = 0

    def line(self) -> None:
        if self.runs:
            runs = [("".join(parts), within, node, sum(links)) for parts, within, node, links in self.runs]
            if not all(not text or text.isspace() for text, *_ in runs):
                self.lines.append((runs, self.tags, self.open[-1][1]))
                self.tags = 0
            self.runs = []

    def space(self) -> None:
        if self.runs:
            self.runs[-1][0].append(" ")

    def shut(self, names: frozenset[str], limit: frozenset[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in names:
                self.close_to(i)
                return
            if self.open[i][0] in limit:
                return

    def close_to(self, i: int) -> None:
        for name, node, hidden in self.open[i:]:
            self.hidden -= hidden
            self.in_link -= name == "a"
            self.articles -= self.kinds[node] in MAIN
        del self.open[i:]

    def doubt(self, tag: str, attrs: dict[str, str | None]) -> bool | None:
        """None if this may be content, True if its tag or role says that it isn't, False if only names or styles do."""
        if tag in PARTS or tag in HEADERS and not self.articles:
            return True
        if tag in ("form", "head"):
            return False
        if not attrs or tag in ("html", "body", "main", "article"):
            return False if tag == "article" and ARTICLE_WORDS & named_words(attrs.get("class")) else None
        role = attrs.get("role") or ""
        if role in SKIPPED_ROLES:
            return role != "form"
        if "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return False
        if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style") or ""):
            return False
        words = named_words(attrs.get("class")) | named_words(attrs.get("id"))
        return False if words & SKIPPED_WORDS or "header" in words and not self.articles else None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.line()
        if tag in VOID:
            if tag == "br":
                self.space()
            return
        if tag in NO_P_INSIDE:
            self.shut(P_ENDS, P_LIMIT)
        elif tag in ENDS:
            self.shut(*ENDS[tag])
        given = dict(attrs)
        doubt = self.doubt(tag, given)
        kind = tag
        if given.get("role") in MAIN:
            kind = given["role"]
        elif given.get("itemprop") == "articleBody":
            kind = "article"
        parent, node = self.open[-1][1], len(self.parents)
        self.parents.append(parent)
        self.kinds.append(kind)
        self.within.append(self.within[parent] if doubt is None else node)
        if doubt is not None:
            self.doubtful[node] = doubt
        self.articles += kind in MAIN
        self.in_link += tag == "a"
        self.hidden += tag in HIDDEN
        self.open.append((tag, node, tag in HIDDEN))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag == "svg":
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.line()
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self.close_to(i)
                return

    def handle_data(self, data: str) -> None:
        if self.hidden:
            self.space()
            return
        node = self.open[-1][1]
        within = self.within[node]
        if not self.runs or self.runs[-1][1] != within:
            self.runs.append(([], within, node, []))
        self.runs[-1][0].append(data)
        if self.in_link:
            self.runs[-1][3].append(len(data))

    def close(self) -> None:
        super().close()
        self.line()


def smoothed(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian mean over neighbours; at the ends over those that there are."""
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, kernel)[reach : reach + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def dense_lines(lengths: list[int], tags: list[int]) -> np.ndarray:
    """Which lines are in the cluster of dense text."""
    ratios = smoothed(np.array(lengths, float) / np.maximum(1, tags))
    return ratios >= min(ratios.std(), ratios.max())


def subtree_ends(parents: list[int]) -> list[int]:
    """The last element inside each: an element and all in it are a range of numbers."""
    last = list(range(len(parents)))
    for node in range(len(parents) - 1, 0, -1):
        last[parents[node]] = max(last[parents[node]], last[node])
    return last


def summed(parents: list[int], masses: list[tuple[int, int]]) -> list[int]:
    """Mass in each element from (element, mass)."""
    total = [0] * len(parents)
    for node, mass in masses:
        total[node] += mass
    for node in range(len(parents) - 1, 0, -1):
        total[parents[node]] += total[node]
    return total


def left_out(page: PageLines, dense: np.ndarray, last: list[int]) -> set[int]:
    """The doubtful elements whose text isn't content.

    One that is doubtful by its name, by a style or as a form counts as content after all if it holds most of the dense text that isn't links,
    unless an article or main element beside it has a fair part. Any one does if it holds the article or main element with the most
    text and this has no less than all that is outside of doubtful elements.
    """
    if not page.doubtful:
        return set()
    runs = [(within, node, max(0, len(text) - links)) for (line, *_), d in zip(page.lines, dense) if d for text, within, node, links in line]
    mass = summed(page.parents, [(node, n) for _, node, n in runs])
    holders = [i for i, kind in enumerate(page.kinds) if kind in MAIN and mass[i] and i not in page.doubtful]
    rivals = [i for i in holders if mass[i] >= RIVAL * mass[0]]

    def around(outer: int, node: int) -> bool:
        return outer <= node <= last[outer]

    refused: set[int] = set()
    for node, sure in page.doubtful.items():
        kept = not sure and 2 * mass[node] > mass[0] and not any(not around(node, i) and not around(i, node) and around(page.within[i], node) for i in rivals)
        if not kept:
            refused.add(node)

    def with_inner() -> set[int]:
        out: set[int] = set()
        for node in page.doubtful:
            if node in refused or page.within[page.parents[node]] in out:
                out.add(node)
        return out

    out = with_inner()
    best = max(holders, key=lambda i: (mass[i], i), default=0)
    if page.within[best] in out and mass[best] >= sum(n for within, _, n in runs if within not in out):
        node = page.within[best]
        while node:
            refused.discard(node)
            node = page.within[page.parents[node]]
        out = with_inner()
    return out


def lowest_around(page: PageLines, nodes: list[int], last: list[int]) -> int:
    """The lowest element that holds all of ``nodes``."""
    node, end = min(nodes), max(nodes)
    while node and last[node] < end:
        node = page.parents[node]
    return node


def region(page: PageLines, weights: list[int], shown: list[bool], out: set[int], last: list[int]) -> list[int]:
    """The elements that hold the content. ``weights``: dense characters of each line.

    All article and main elements, if they hold half of the dense text, with what is between them and a title that is outside of
    them; or else the lowest element that holds all dense lines and all headings.
    """
    mass = summed(page.parents, [(node, w) for (*_, node), w in zip(page.lines, weights)])
    parts: list[int] = []
    for i, kind in enumerate(page.kinds):
        if kind in MAIN and page.within[i] not in out and not (parts and i <= last[parts[-1]]):
            parts.append(i)
    if 2 * sum(mass[i] for i in parts) >= mass[0] > 0:
        titles = [node for (*_, node), s in zip(page.lines, shown) if s and page.kinds[node] == "h1"]
        if titles and titles[0] < parts[0] and not any(i <= t <= last[i] for t in titles for i in parts):
            return [lowest_around(page, [max(t for t in titles if t < parts[0]), *parts], last)]
        return parts
    node = lowest_around(page, [node for (*_, node), w, s in zip(page.lines, weights, shown) if s and (w or page.kinds[node] in HEADINGS)], last)
    # a single dense paragraph isn't a region: its neighbours belong to it
    while node and page.kinds[node] in ("p", "b", "span", "li", "em", "strong", "a", "td", "h1", "h2", "h3"):
        node = page.parents[node]
    return [node]


def main_text(html: str | None) -> str:
    """The article's blocks joined by two line ends; empty if there is no text."""
    page = PageLines()
    page.feed(_CUT_TAG.sub("", html or ""))
    page.close()
    if not page.lines:
        return ""
    last = subtree_ends(page.parents)
    whole = [" ".join("".join(text for text, *_ in runs).split()) for runs, *_ in page.lines]
    dense = dense_lines([len(t) for t in whole], [tags for _, tags, _ in page.lines])
    out = left_out(page, dense, last)
    texts, links = [], []
    for text, (runs, *_) in zip(whole, page.lines):
        kept = [run for run in runs if run[1] not in out]
        # a space where something inside the line is left out
        texts.append(text if len(kept) == len(runs) else " ".join(" ".join(t for t, *_ in kept).split()))
        links.append(sum(n for *_, n in kept))
    shown = [bool(t) for t in texts]
    if not any(shown):
        return ""
    dense &= np.array(shown)
    if not dense.any():
        dense = np.array(shown)
    holders = frozenset(region(page, [len(t) if d else 0 for t, d in zip(texts, dense)], shown, out, last))
    inside, in_article = [False] * len(page.parents), [False] * len(page.parents)
    for node, parent in enumerate(page.parents):
        inside[node] = node in holders or parent >= 0 and inside[parent]
        in_article[node] = page.kinds[node] == "article" or parent >= 0 and in_article[parent]
    # outside of an article element, what links make up is a menu unless it is dense
    return "\n\n".join(t for t, d, n, (*_, node) in zip(texts, dense, links, page.lines) if t and inside[node] and (in_article[node] or d or 2 * n < len(t)))


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """All rows and columns plus the main text and its number of code points.

    Null and empty pages and pages without content have an empty text. Cut pages end where they end. Columns
    with the names of the results are replaced.
    """

    @F.arrow_udf("struct<text:string,n:bigint>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for htmls in batches:
            texts = [main_text(h.as_py()) for h in htmls]
            yield pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["text", "n"])

    return pages.withColumn("_found", found(F.col(html_col))).withColumn(text_col, F.col("_found.text")).withColumn(chars_col, F.col("_found.n")).drop("_found")
