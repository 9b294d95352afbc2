"""Main text of web pages.

The standard library's parser streams events; text gathers in lines, one for each run
between block elements. A line's ratio is its characters by its tags; what stands in
menus, headers, footers, sidebars, notices, adverts, forms, scripts or comments has
ratio 0. A class, id or role that tells of such a thing only marks its subtree: articles
inside with more text than all others lift the mark, and so does a subtree of most of
the page's text, where there is no article, whose ratio times ``PENALTY`` is still above
the others'. The ratios are smoothed by a Gaussian over neighbouring lines, and lines that
reach the deviation of the smoothed ratios are content. They select regions: the
article elements that hold content, else the innermost containers that do; all allowed
lines of a region are the text.

Null, empty and broken markup give what text there is, or the empty text. Repeated rows
give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines on either side that a ratio is smoothed over, and the curve's width.
RADIUS, SIGMA = 2, 1.0

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style noscript template nav header footer aside form iframe object svg button select option textarea "
                   "dialog menu canvas audio video datalist".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
                   "h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("article body div main section td".split())
#: Words of a class, id or role that mark what is not the article.
ASIDE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert "
                  "popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments reply replies disqus respond "
                  "sidebar aside nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead related recommended recommendations "
                  "widget widgets toolbar pagination pager search complementary contentinfo dialog".split())
#: A word after one of these says what an element is without.
WITHOUT = frozenset("no not non without hide has have with is".split())
#: A word before one of these likewise: ad-free, share-enabled.
ABSENT = frozenset("free less enabled disabled hidden".split())
#: Share of its ratio that text in a subtree marked by class words keeps, against the other text.
PENALTY = 0.25
CLOSES_P = BLOCKS - {"br", "body", "html", "head", "title", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _names_aside(value: str) -> bool:
    """Whether a class, id or role has a word of ``ASIDE`` that its neighbours in the name do not take back."""
    for name in value.split():
        words = [w.lower() for w in _NAMES.findall(name)]
        for before, word, after in zip(["", *words], words, [*words[1:], ""]):
            if word in ASIDE and before not in WITHOUT and after not in ABSENT:
                return True
    return False


#: What an element is: content, marked by class words, or never content.
PLAIN, MARKED, NEVER = 0, 1, 2


def _aside(tag: str, attributes: list[tuple[str, str | None]]) -> int:
    if tag in HIDDEN:
        return NEVER
    marked = PLAIN
    for name, value in attributes:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return NEVER
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return NEVER
        if tag in ("html", "body", "article", "main"):
            continue
        if name in ("class", "id", "role") and value and _names_aside(value):
            marked = MARKED
    return marked


class Lines(HTMLParser):
    """Lines of a page: [text parts, tags, aside, article, container, outermost marked element]."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[list] = []
        self.open: list[tuple[str, int, int, int, int]] = []  # tag, aside, article, container, outermost marked element
        #: Depths of the open elements by tag.
        self.depths: defaultdict[str, list[int]] = defaultdict(list)
        self.count = 0
        self._new_line()

    def _new_line(self) -> None:
        _, aside, article, container, marked = self.open[-1] if self.open else ("", PLAIN, 0, 0, 0)
        self.lines.append([[], 0, aside, article, container, marked])

    def _pop_to(self, depth: int) -> None:
        for element in self.open[depth:]:
            self.depths[element[0]].pop()
        del self.open[depth:]

    def _close(self, tag: str, barrier: frozenset[str]) -> bool:
        """Close the innermost such element with all in it, unless a barrier is open inside it."""
        if self.open and self.open[-1][0] == tag:
            self._pop_to(len(self.open) - 1)
            return True
        places = self.depths.get(tag)
        if not places or any(self.depths[b][-1] > places[-1] for b in barrier if self.depths.get(b)):
            return False
        self._pop_to(places[-1])
        return True

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self._close("p", frozenset(("article", "aside", "body", "div", "footer", "header", "main", "nav", "section", "td", "th", "li", "button", "blockquote")))
        if tag in ("li", "dd", "dt", "option", "tr", "td", "th"):
            pair = {"dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th")}.get(tag, (tag,))
            for other in pair:
                self._close(other, frozenset(("ul", "ol", "dl", "table", "select", "menu", "tr" if tag in ("td", "th") else "table")))
        self.lines[-1][1] += 1
        if tag not in VOID:
            _, aside, article, container, marked = self.open[-1] if self.open else ("", PLAIN, 0, 0, 0)
            self.count += 1
            opens = tag in ("article", "main") or any(n == "itemprop" and v == "articleBody" for n, v in attrs)
            mine = max(_aside(tag, attrs), aside)
            if opens and aside == MARKED and not self.depths.get("article"):
                mine = _aside(tag, attrs)  # what is plain inside a marked element is lifted
            if mine == MARKED and aside == PLAIN:
                marked = self.count
            if not article and opens:
                article = self.count
            if tag in CONTAINERS:
                container = self.count
            self.depths[tag].append(len(self.open))
            self.open.append((tag, mine, article, container, marked))
            if tag in BLOCKS or mine != aside:
                self._new_line()
        elif tag in BLOCKS:
            self._new_line()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag and tag not in BLOCKS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.lines[-1][1] += 1
        before = self.open[-1][1] if self.open else PLAIN
        inline = tag not in BLOCKS
        closed = self._close(tag, BLOCKS if inline else frozenset())
        after = self.open[-1][1] if self.open else PLAIN
        if tag in BLOCKS or (closed and before != after):
            self._new_line()

    def handle_data(self, data: str) -> None:
        self.lines[-1][0].append(data)


def smooth(ratios: list[float]) -> list[float]:
    kernel = [math.exp(-i * i / (2 * SIGMA * SIGMA)) for i in range(-RADIUS, RADIUS + 1)]
    out = []
    for i in range(len(ratios)):
        weight = value = 0.0
        for j, k in zip(range(i - RADIUS, i + RADIUS + 1), kernel):
            if 0 <= j < len(ratios):
                weight += k
                value += k * ratios[j]
        out.append(value / weight)
    return out


def _outweighing(lines: list[tuple]) -> set[int]:
    """Marked elements whose text is most of the page's, at a ratio that outweighs the others' by ``PENALTY``.

    Where the page has an article of its own, none does.
    """
    figures: dict[int, list[int]] = {}
    for text, tags, aside, article, _, marked in lines:
        if aside == NEVER:
            continue
        if aside == PLAIN and article:
            return set()
        sums = figures.setdefault(marked, [0, 0])
        sums[0] += len(text)
        sums[1] += max(tags, 1)
    total, all_tags = sum(c for c, _ in figures.values()), sum(t for _, t in figures.values())
    out = set()
    for marked, (chars, tags) in figures.items():
        rest = (total - chars) / max(all_tags - tags, 1)
        if marked and 2 * chars > total and PENALTY * chars / tags > rest:
            out.add(marked)
    return out


def main_text(html: str | None) -> str:
    """The article's text, blocks joined by one space."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    lines = [(" ".join("".join(parts).split()), tags, aside, article, container, marked) for parts, tags, aside, article, container, marked in parser.lines]
    lines = [x for x in lines if x[0]]
    if not lines:
        return ""
    heavy = _outweighing(lines)
    # articles inside marked elements (cards of related pages, or the article) against those outside
    chars = Counter()
    for text, _, aside, article, _, marked in lines:
        if aside == PLAIN and article:
            chars[marked] += len(text)
    inside = {m for m, c in chars.items() if 2 * c > sum(chars.values())} | {0}
    lines = [(text, tags, marked in inside if aside == PLAIN else aside == MARKED and marked in heavy, article, container)
             for text, tags, aside, article, container, marked in lines]
    smoothed = smooth([len(text) / max(tags, 1) if allowed else 0.0 for text, tags, allowed, _, _ in lines])
    mean = sum(smoothed) / len(smoothed)
    deviation = math.sqrt(sum((x - mean) ** 2 for x in smoothed) / len(smoothed))
    content = [x[2] and s >= min(deviation, mean) for x, s in zip(lines, smoothed)]
    articles = {x[3] for x, c in zip(lines, content) if c and x[3]}
    if articles:
        return " ".join(x[0] for x in lines if x[2] and x[3] in articles)
    regions = {x[4] for x, c in zip(lines, content) if c}
    return " ".join(x[0] for x in lines if x[2] and x[4] in regions)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``(id, url, text, n_chars)`` for each page."""
    kind = pages.schema[id_col].dataType.simpleString()
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(_texts, f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
