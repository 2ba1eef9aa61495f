"""Main text of web pages by text-to-tag ratios.

A page is read once by the standard library's streaming parser. Its events make *lines*: a new
line starts at each block-level tag. Every line has its text and the number of tags seen since
the last line. The text-to-tag ratio of a line is its length over its tags (one at least), text
inside links not counted; the ratios are smoothed along the page with a Gaussian, and the lines
over a threshold, a share of their spread, cluster as content.

Clusters say where the article is, and which lines it has. The region is the innermost element that holds
nearly all of the clustered text, or an ``article`` or ``main`` element with most of it. A line of the region stays

* if it clusters as content, by its own ratio as well as by the smoothed one,
* if it lies between two such lines of the same parent and is not mostly links, or
* if the page's structure speaks for it: the region is an ``article`` or ``main`` element or is named as content, or the line
  is in a paragraph, heading, list, quotation or table and is not all links. So short paragraphs stay.

In a page of bare ``div`` elements the clusters alone decide. Elements that never hold the article (menus, headers, footers,
side bars, notices, adverts, forms, comments) have no say and no line: by tag, by ARIA role, or by a word in ``class`` or ``id``.

Defined cases: null and empty pages, and pages without a content line, give an empty text. Text
outside any element counts as a line of the page. Tags that are never closed end with their
parent. White space (Unicode's) inside a line becomes one space; lines join by an empty line. Repeated rows are answered one
by one, and other columns are not read. Time grows with the page's length, whatever tags stay open; a page is held whole.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Width of the smoothing, in lines.
SIGMA = 1.0
#: A line is content if its smoothed ratio is over this share of the ratios' standard deviation.
THRESHOLD = 0.5
#: The region holds at least this share of the clustered text.
HELD = 0.9

# HTML's elements by what they do, and words that pages use in class and id.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option", "optgroup"}
_HIDDEN = frozenset("head script style noscript template iframe object svg math canvas audio video select textarea button datalist title".split())
_ASIDE = frozenset("nav header footer aside form menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored sponsors promo promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead topbar footer bottom colophon sidebar sidebars aside rail widget widgets "
    "comment comments commentlist reply replies respond disqus discussion "
    "cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations form search pagination pager copyright legal disclaimer toolbar".split()
)
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LIMITS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_INNER = frozenset("p pre li td tr blockquote ul ol h1 h2 h3 h4 h5 h6".split())
_COMMENT = frozenset("comment reply".split())
_NAMED_CONTENT = frozenset("article content story post entry main body text".split())
_TEXTUAL = frozenset("p pre blockquote li dd dt figcaption table caption h1 h2 h3 h4 h5 h6".split())


def _apart(tag: str, attributes: list[tuple[str, str | None]]) -> int:
    """Whether an element holds something else than the article: 2 by what it is, 1 by its name, 0 not."""
    if tag in _ASIDE:
        return 1 if tag == "form" else 2  # some pages are one form
    by_name = 0
    for name, value in attributes:
        value = (value or "").lower() if name in ("role", "style") else value
        if name == "role" and value.strip() in _ROLES or name == "hidden" or name == "style" and "display:none" in re.sub(r"\s", "", value):
            return 2
        if name in ("class", "id") and value and tag not in ("main", "body", "html"):
            words = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", value).lower())
            if not (_COMMENT if tag == "article" else _WORDS).isdisjoint(words):
                by_name = 1
    return by_name


class _Lines(HTMLParser):
    """Parser events as lines: text, tags before it, text in links, and the elements around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, number, hidden
        self.count: Counter[str] = Counter()  # open elements by tag, so that no search is in vain
        self.parent, self.tag_of, self.apart, self.named, self.links = [-1], [""], [0], [False], 0
        self.now: list[str] = []
        self.tags = self.linked = 0
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, linked characters, element

    def _end_line(self) -> None:
        text = " ".join("".join(self.now).split())
        self.now = []
        if text:
            self.lines.append((text, self.tags, self.linked, self.open[-1][1]))
            self.tags = self.linked = 0

    def _leave(self, depth: int) -> None:
        """Close all elements from ``depth`` on."""
        if any(t in _BLOCK for t, *_ in self.open[depth:]):
            self._end_line()
        for t, *_ in self.open[depth:]:
            self.links -= t == "a"
            self.count[t] -= 1
        del self.open[depth:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag == "br":
            self.now.append(" ")
            return
        if tag in _BLOCK:
            self._end_line()
        if tag in _VOID:
            return
        if tag in _CLOSES_P and self.count["p"]:
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth][0] == "p":
                    self._leave(depth)
                    break
                if self.open[depth][0] in _BLOCK:
                    break
        if tag in _SAME and any(self.count[t] for t in _SAME[tag]):
            for depth in range(len(self.open) - 1, 0, -1):
                if self.open[depth][0] in _SAME[tag]:
                    self._leave(depth)
                    if tag != "tr":
                        break
                elif self.open[depth][0] in _LIMITS[tag]:
                    break
        _, element, hidden = self.open[-1]
        self.parent.append(element)
        self.tag_of.append(tag)
        self.apart.append(_apart(tag, attrs))
        self.named.append(tag in ("article", "main") or any(k in ("class", "id", "itemprop") and v and not _NAMED_CONTENT.isdisjoint(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower())) for k, v in attrs))
        self.count[tag] += 1
        self.open.append((tag, len(self.parent) - 1, hidden or tag in _HIDDEN))
        self.links += tag == "a"

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # HTML ignores the slash of tags that aren't void

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if self.count[tag]:
            depth = len(self.open) - 1
            while self.open[depth][0] != tag:  # what is passed over is closed, so it's passed over once
                depth -= 1
            self._leave(depth)
            return
        if tag in _BLOCK:
            self._end_line()

    def handle_data(self, data: str) -> None:
        if not self.open[-1][2]:
            self.now.append(data)
            if self.links > 0:
                self.linked += len(data)

    def finish(self) -> None:
        self.close()
        self._leave(1)
        self._end_line()


def smoothed(ratios: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian average along the lines; at the ends the weights inside the page count alone."""
    reach = max(1, math.ceil(3 * sigma))
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    n = len(ratios)
    full = np.convolve(ratios, weight)[reach:reach + n]
    return full / np.convolve(np.ones(n), weight)[reach:reach + n]


def clusters(values: np.ndarray, threshold: float) -> np.ndarray:
    """Which values are over the threshold, a share of their spread; the largest always is."""
    return values >= min(threshold * float(values.std()) or 0.0, float(values.max()))


def content_lines(ratios: np.ndarray, sigma: float = SIGMA, threshold: float = THRESHOLD) -> np.ndarray:
    """Which lines cluster as content."""
    if not len(ratios):
        return np.zeros(0, bool)
    return clusters(smoothed(ratios, sigma), threshold)


def _below(parent: list[int], amount: np.ndarray) -> np.ndarray:
    """Each element's amount with all that is inside it; parents come before their children."""
    out = amount.astype(float)
    for element in range(len(parent) - 1, 0, -1):
        out[parent[element]] += out[element]
    return out


def _set_apart(page: _Lines, length: np.ndarray, element: np.ndarray) -> np.ndarray:
    """For each element whether it stands apart from the article, itself or by what it is in.

    A name alone doesn't set apart what holds an article or main element, or a first heading and most
    of the text: that is a wrapper, such as "with-sidebar".
    """
    n = len(page.parent)
    holds_article = _below(page.parent, np.array([t in ("article", "main") for t in page.tag_of])) - np.array([t in ("article", "main") for t in page.tag_of])
    holds_heading = _below(page.parent, np.array([t == "h1" for t in page.tag_of])) > 0
    text = _below(page.parent, np.bincount(element, length, n))
    out = np.zeros(n, bool)
    for e in range(n):
        wrapper = holds_article[e] > 0 or holds_heading[e] and text[e] > 0.5 * text[0]
        out[e] = page.apart[e] == 2 or page.apart[e] == 1 and not wrapper or page.parent[e] >= 0 and out[page.parent[e]]
    return out


def main_text(html: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD, held: float = HELD) -> str:
    """The article of one page."""
    page = _Lines()
    page.feed(html or "")
    page.finish()
    lines = page.lines
    if not lines:
        return ""
    length = np.array([len(t) for t, *_ in lines], float)
    element = np.array([e for *_, e in lines])
    apart = _set_apart(page, length, element)[element]
    ratio = np.array([max(0, len(t) - k) / max(1, g) for t, g, k, _ in lines])
    ratio[apart] = 0.0
    chosen = content_lines(ratio, sigma, threshold) & ~apart & (ratio > 0)
    if not chosen.any():
        return ""
    inside = _below(page.parent, np.bincount(element[chosen], length[chosen], len(page.parent)))
    total = inside[0]
    # Elements are numbered from the outside in: the innermost that holds enough comes last.
    region = int(np.flatnonzero(inside >= held * total).max())
    for e in np.flatnonzero(inside > 0.5 * total):
        if page.tag_of[e] in ("article", "main"):
            region = int(e)
    while page.parent[region] >= 0 and (page.tag_of[region] not in _BLOCK or page.tag_of[region] in _INNER):
        region = page.parent[region]
    within = np.zeros(len(page.parent), bool)
    for e in range(len(page.parent)):
        within[e] = e == region or page.parent[e] >= 0 and within[page.parent[e]]
    kept = _kept(page, element, length, chosen & clusters(ratio, threshold), region, within)
    return "\n\n".join(line[0] for line, keep, out in zip(lines, kept, apart, strict=True) if keep and not out)


def _kept(page: _Lines, element: np.ndarray, length: np.ndarray, chosen: np.ndarray, region: int, within: np.ndarray) -> np.ndarray:
    """Which lines of the region stay: those of the clusters, those between them, and those the structure speaks for."""
    inside = within[element]
    up = region
    while up > 0 and not page.named[up]:
        up = page.parent[up]
    if up > 0 and page.tag_of[up] != "body":
        return inside
    textual, links = np.zeros(len(page.parent), bool), np.array([k for _, _, k, _ in page.lines]) / np.maximum(1, length)
    for e in range(1, len(page.parent)):
        textual[e] = page.tag_of[e] in _TEXTUAL or textual[page.parent[e]]
    spoken = textual[element] & (links < 1)
    # Lines between two chosen ones of the same parent: from the first to the last chosen child of each.
    above = np.array(page.parent)[element]
    at = np.arange(len(element))
    first, last = np.full(len(page.parent), len(element)), np.full(len(page.parent), -1)
    np.minimum.at(first, above[chosen & inside], at[chosen & inside])
    np.maximum.at(last, above[chosen & inside], at[chosen & inside])
    between = (at > first[above]) & (at < last[above]) & (links < 0.5)
    return inside & (chosen | between | spoken)


_TEXT_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extracted(sigma: float, threshold: float, held: float):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [main_text(h.as_py(), sigma, threshold, held) for h in part.column("html")]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_TEXT_ARROW)

    return task


def extract_text(pages: DataFrame, sigma: float = SIGMA, threshold: float = THRESHOLD, held: float = HELD) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages; a narrow map, nothing is shuffled."""
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extracted(sigma, threshold, held), "page_id long, url string, text string, n_chars long")


def op2_html_extract(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
