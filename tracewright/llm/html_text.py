"""The main text of a web page by text-to-tag ratios of its lines.

The standard library's parser gives events; block elements cut the page into lines. A line's ratio is
its characters by its tags. Ratios are smoothed with a Gaussian, and lines above a threshold are
content. The smallest container that holds nearly all content (an article or main element around it,
if there is one) is the region whose lines make the text, short ones between them included. Elements
that are page furniture by name, role or class never give lines.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.batches import text_batches

SIGMA = 1.0  # of the smoothing, in lines
THRESHOLD = 0.5  # standard deviations of the smoothed ratios
SHARE = 0.9  # of the content's characters that the region holds

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike "
    "strong sub sup time tt u var wbr label ruby rt rp img".split())
CONTAINER = frozenset("html body main article section div td table center".split())
NEVER = frozenset(
    "head script style noscript template svg math iframe object nav footer aside form button select textarea "
    "dialog menu canvas audio video".split())
KEEP = frozenset("html body main article".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "main menu nav ol p pre section table ul".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs cookie cookies consent "
    "gdpr notice popup modal overlay sidebar menu nav navbar navigation footer header masthead comment comments "
    "commentlist disqus reply replies respond share sharing social related recommended promo promotion sponsor "
    "sponsored newsletter subscribe subscription signup login widget pagination pager toolbar search skip".split())
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")


def is_furniture(tag: str, attrs: list[tuple[str, str | None]], in_article: bool) -> bool:
    """Whether an element is outside the main text by its name, role, class, id or visibility."""
    if tag in KEEP:
        return False
    if tag in NEVER or tag == "header" and not in_article:
        return True
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in ROLES:
            return True
        if name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
        if name in ("class", "id") and any(p.lower() in FURNITURE for p in _PART.findall(value)):
            return True
    return False


class Lines(HTMLParser):
    """Collects lines as (text, tags, containers around it)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, tuple[int, ...]]] = []
        self.names: list[str] = []  # of containers, by number
        self._open: list[tuple[str, int | None]] = []  # element, its number if it is a container
        self._skip: int | None = None  # height of the stack below an element without text
        self._text: list[str] = []
        self._tags = 0

    def cut(self) -> None:
        text = _SPACE.sub(" ", "".join(self._text)).strip()
        if text:
            self.lines.append((text, self._tags, tuple(n for _, n in self._open if n is not None)))
            self._tags = 0
        self._text.clear()

    def handle_starttag(self, tag, attrs):
        self._tags += 1
        if tag in VOID:
            if tag == "br":
                self._text.append(" ")
            elif tag == "hr":
                self.cut()
            return
        if tag in CLOSES_P and self._skip is None:
            self._close("p")
        if tag not in INLINE and self._skip is None:
            self.cut()
        number = None
        if tag in CONTAINER:
            number = len(self.names)
            self.names.append(tag)
        if self._skip is None and is_furniture(tag, attrs, any(t in ("article", "main") for t, _ in self._open)):
            if tag in INLINE:
                self._text.append(" ")
            self._skip = len(self._open)
        self._open.append((tag, number))

    def handle_startendtag(self, tag, attrs):
        self._tags += 1
        if tag in ("br", "hr"):
            self._text.append(" ")

    def _close(self, tag: str) -> None:
        """Close the innermost element of that name and what it holds; not across a container."""
        for at in range(len(self._open) - 1, -1, -1):
            name = self._open[at][0]
            if name == tag:
                if self._skip is None and any(t not in INLINE for t, _ in self._open[at:]):
                    self.cut()
                del self._open[at:]
                if self._skip is not None and at <= self._skip:
                    self._skip = None
                return
            if tag not in CONTAINER and name in CONTAINER and tag in INLINE | {"p", "li"}:
                return

    def handle_endtag(self, tag):
        self._tags += 1
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data):
        if self._skip is None:
            self._text.append(data)


def smooth(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; weights outside the page do not count."""
    reach = max(1, math.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    inside = np.convolve(np.ones(len(ratios)), weights)[reach:-reach]
    return np.convolve(ratios, weights)[reach:-reach] / inside


def main_text(html: str | None) -> str:
    """The main text, blocks in page order joined by one space; empty if there is none."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    lines = parser.lines
    if not lines:
        return ""
    smoothed = smooth(np.array([len(text) / max(1, tags) for text, tags, _ in lines]))
    content = smoothed >= THRESHOLD * smoothed.std()
    within: dict[int, int] = {}
    for (text, _, around), chosen in zip(lines, content, strict=True):
        if chosen:
            for number in around:
                within[number] = within.get(number, 0) + len(text)
    total = sum(len(line[0]) for line, chosen in zip(lines, content, strict=True) if chosen)
    holding = [n for n, size in within.items() if size >= SHARE * total]
    region = max(holding, default=None)  # containers are numbered as they open, so the last is the innermost
    if region is not None:
        around = next(a for _, _, a in lines if region in a)
        outer = [n for n in around[: around.index(region) + 1] if parser.names[n] in ("article", "main")]
        region = outer[-1] if outer else region
        lines = [line for line in lines if region in line[2]]
    return " ".join(text for text, _, _ in lines)


def extract(pages: DataFrame) -> DataFrame:
    """Per row of `pages`: page_id, url, text and n_chars, from the whole `html`.

    A null or empty html, and a page without main text, gives an empty text. Repeated rows are
    extracted one by one; other columns are ignored; no rows give none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "html"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([main_text(t) for t in texts], pa.string())],
                names=["page_id", "url", "text"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string").withColumn(
        "n_chars", F.char_length("text").cast("long"))
