"""Main text of web pages from parser events.

The page is read as a stream of parser events and cut into lines, one per block element. Each line has a
text-to-tag ratio. The ratios are smoothed with a Gaussian and clustered by a threshold; the clusters
point to the content. It is then widened to the innermost element that holds all clusters, and to an article or main
element around that, so that short paragraphs and sections between long ones stay. Boilerplate inside is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SIGMA = 1.0
SCHEMA = "page_id long, url string, text string, n_chars long, n_lines long"

# fixed values: elements of HTML by their role
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary"
    " table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
CLOSES_P = BLOCKS - {"br"}
# names in class, id and role that mark what is not the article
MARKS = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright"
    " disclaimer disqus footer header login masthead menu modal nav navbar navigation newsletter notice pagination popup"
    " promo promoted related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe"
    " toolbar widget alert contentinfo complementary".split()
)
_PART = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")


# of these, names that an article's own head has as well
HEADS = frozenset("header masthead".split())


def marked(attributes: list[tuple[str, str | None]], in_article: bool = False) -> bool:
    """Whether class, id or role name something other than content, or the element is hidden."""
    for name, value in attributes:
        if name in ("class", "id", "role"):
            if any(part in MARKS and not (in_article and part in HEADS) for part in _PART.findall((value or "").lower())):
                return True
        elif name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
            return True
    return False


class Lines(HTMLParser):
    """Collects (text, tags, container) of each line; containers are numbered, with their parents."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = [("", False, 0)]  # tag, dropped, container
        self.parent = [0]
        self.kind = [""]
        self.lines: list[tuple[str, int, int, bool]] = []
        self.text: list[str] = []
        self.tags = 0

    def cut(self) -> None:
        tag, dropped, container = self.open[-1]
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.lines.append((text, self.tags, container, dropped))
        self.text, self.tags = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.cut()
            if tag in CLOSES_P:  # an open paragraph ends where a block begins
                self._end("p", until=BLOCKS - {"p"})
            if tag == "li":
                self._end("li", until=frozenset(("ul", "ol", "menu")))
        self.tags += 1
        if tag in VOID:
            return
        in_article = any(x[0] == "article" for x in self.open)
        dropped = self.open[-1][1] or tag in HIDDEN or tag in BOILERPLATE and not (
            tag == "header" and any(x[0] in ("article", "main") for x in self.open)
        ) or tag not in ("html", "body", "article", "main", "h1") and marked(attrs, in_article)
        container = self.open[-1][2]
        if tag in BLOCKS and tag not in ("p", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "dt", "dd", "pre"):
            self.parent.append(container)
            self.kind.append(tag)
            container = len(self.parent) - 1
        self.open.append((tag, dropped, container))

    def _end(self, tag: str, until: frozenset[str] = frozenset()) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in until:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS or tag in HIDDEN:
            self.cut()
        self.tags += 1
        if tag not in VOID:
            self._end(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data: str) -> None:
        if self.open[-1][0] not in HIDDEN:
            self.text.append(data)


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the ends repeat the outer values."""
    reach = max(1, int(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def content_lines(lines: list[tuple[str, int, int, bool]], parent: list[int], kind: list[str]) -> list[int]:
    """Numbers of the lines that belong to the content."""
    if not lines:
        return []
    ratio = np.array([len(text) / max(1, tags) for text, tags, _, _ in lines], float)
    smoothed = smooth(ratio)
    # the threshold is the spread of the smoothed ratios around their mean, never above the mean
    threshold = min(smoothed.mean(), smoothed.std())
    seeds = [i for i, x in enumerate(lines) if not x[3] and smoothed[i] >= threshold]
    if not seeds:  # only short lines: all that is not boilerplate
        seeds = [i for i, x in enumerate(lines) if not x[3]]
    if not seeds:
        return []

    # the element around all clusters; a parent's number is below its children's
    around = lines[seeds[0]][2]
    for i in seeds[1:]:
        other = lines[i][2]
        while around != other:
            around, other = (parent[around], other) if around > other else (around, parent[other])
    at = around
    while at:
        if kind[at] in ("article", "main"):
            around = at
        at = parent[at]

    def inside(container: int) -> bool:
        while True:
            if container == around:
                return True
            if not container:
                return False
            container = parent[container]

    return [i for i, x in enumerate(lines) if not x[3] and inside(x[2])]


def main_text(html: str | None) -> tuple[str, int]:
    """Main text, and the number of lines the page had."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.cut()
    kept = content_lines(parser.lines, parser.parent, parser.kind)
    return "\n".join(parser.lines[i][0] for i in kept), len(parser.lines)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [main_text(x) for x in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.string()),
                pa.array([t for t, _ in found], pa.string()),
                pa.array([len(t) for t, _ in found], pa.int64()),
                pa.array([n for _, n in found], pa.int64()),
            ],
            ["page_id", "url", "text", "n_chars", "n_lines"],
        )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: the article's blocks joined by one newline, empty if there are none.

    Null and empty html give an empty text. Repeated rows are read each on their own; further columns
    of ``pages`` are not looked at.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, SCHEMA)
