"""Main text of web pages by parser events and smoothed text-to-tag ratios.

The standard library's HTML parser streams events into lines: a line is the text
between two block boundaries, with the number of tags since the line before; text in
elements that never hold an article makes no line. Each line has a text-to-tag ratio
(characters over tags, link text not counted). The ratios are smoothed by a Gaussian
kernel and clustered by a threshold (their standard deviation, at most their
mean). A region, that is the lines of one sectioning element (an ``article`` is one
region), is content when at least half of its text without links (or the largest share of any region)
lies above it; for a region in an ``article`` or ``main`` element three fifths of that share are
enough. All lines of the content regions that are not in menus,
headers, footers, sidebars, notices, adverts, forms or reader comments are
the main text. A class or id marks such a part by its words, but never an ``article`` or
``main`` element, nor an element that holds more than half of the page's text (when the word
is a whole class or id, as in ``class="ad"``, that also must hold all article and main text).

Defined results: null or empty html, and pages without content, give the empty string;
broken or cut-off markup is read as far as it goes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from peerscope.llm.bpe import text_chunks

SIGMA = 1.0            # of the Gaussian kernel, in lines
_SHARE = 0.5           # of a region's text above the threshold
_ARTICLE_SHARE = 0.6   # of that share, for regions in article or main elements
_CHUNK_BYTES = 4_000_000

# fixed values: elements of the HTML standard by their role
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset("""address article aside blockquote body center dd details dialog div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main
    menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split())
_SECTIONS = frozenset("article body div main section td".split())
_OUTSIDE = frozenset("""applet area aside audio button canvas datalist dialog embed fieldset footer form
    frame frameset head iframe input label legend map math menu meter nav noframes noscript
    object optgroup option output progress script search select style svg template textarea
    title video""".split())
_OUTSIDE_ROLES = frozenset("""alert alertdialog banner complementary contentinfo dialog form
    menu menubar navigation search status toolbar""".split())
_OUTSIDE_WORDS = frozenset("""ad ads adv advert advertisement adverts adsense banner breadcrumb breadcrumbs
    comment comments commentlist consent cookie cookies disqus footer gdpr header masthead menu modal nav navbar
    navigation newsletter notice notices notification pagination paywall popup privacy promo promotion
    related replies reply respond share sharing sidebar skip social sponsor sponsored subscribe
    toolbar widget""".split())
_NAME = re.compile(r"[a-z]+")


class LineReader(HTMLParser):
    """Collects lines: text, tags, link characters, section, whether in article or main.

    Elements whose class or id has a word of ``_OUTSIDE_WORDS`` are numbered in ``marked`` as
    [parent, characters, characters in article or main, word is a whole class or id]; their text
    makes lines only when their number is in ``kept``.
    """

    def __init__(self, kept: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, bool]] = []   # text, tags, link chars, section, in article
        # tag, outside, in a marked element that is not kept, section, in "article", "main" or "", marked element
        self.stack: list[tuple[str, bool, bool, int, str, int]] = []
        self.kept, self.marked = kept, [[0, 0, 0, False]]        # number 0 is the page
        self.text: list[str] = []
        self.tags = self.links = self.sections = self.in_link = 0

    def state(self) -> tuple[bool, bool, int, str, int]:
        return self.stack[-1][1:] if self.stack else (False, False, 0, "", 0)

    def end_line(self) -> None:
        line = " ".join("".join(self.text).split())
        if line:
            _, _, section, article, _ = self.state()
            self.lines.append((line, self.tags, min(self.links, len(line)), section, bool(article)))
            self.tags = 0
        self.text, self.links = [], 0

    def handle_starttag(self, tag: str, attrs) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag == "a":
            self.in_link = 1
        if tag in _BLOCKS:
            self.end_line()
            i = len(self.stack) - 1
            while i >= 0 and self.stack[i][0] not in _BLOCKS:
                i -= 1
            if i >= 0 and (self.stack[i][0] == "p" or tag == "li" == self.stack[i][0]):
                del self.stack[i:]          # a paragraph or list item ends where the next block begins
        if tag in _VOID or not (tag in _BLOCKS or tag in _OUTSIDE or attrs):
            return
        outside, cut, section, article, mark = self.state()
        if tag in _SECTIONS and (article != "article" or tag == "article"):
            self.sections += 1
            section = self.sections
        outside = outside or tag in _OUTSIDE or (tag == "header" and not article)
        named = whole = False
        for name, value in attrs if tag not in ("html", "body") else ():
            if name in ("class", "id"):
                value = (value or "").lower()
                named = named or not _OUTSIDE_WORDS.isdisjoint(_NAME.findall(value))
                whole = whole or not _OUTSIDE_WORDS.isdisjoint(value.split())
            elif name == "role":
                outside = outside or (value or "").lower() in _OUTSIDE_ROLES
            elif name in ("hidden",) or (name == "aria-hidden" and value == "true"):
                outside = True
        if named and not outside and tag not in ("article", "main"):
            self.marked.append([mark, 0, 0, whole])
            mark = len(self.marked) - 1
            cut = cut or mark not in self.kept
        if tag == "article" or (tag == "main" and not article):
            article = tag
        self.stack.append((tag, outside, cut, section, article, mark))

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a":
            self.in_link = 0
        if tag in _BLOCKS:
            self.end_line()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data: str) -> None:
        outside, cut, _, article, mark = self.state()
        if outside:
            return
        chars = sum(map(len, data.split()))
        while True:
            entry = self.marked[mark]
            entry[1] += chars
            entry[2] += chars if article else 0
            if not mark:
                break
            mark = entry[0]
        if cut:
            return
        self.text.append(data)
        if self.in_link:
            self.links += len(data)


def page_lines(html: str) -> list[tuple[str, int, int, int, bool]]:
    kept: frozenset[int] = frozenset()
    while True:
        reader = LineReader(kept)
        reader.feed(html)
        reader.close()
        reader.end_line()
        # what holds most of the text is no side part, whatever its name: read again with it
        _, total, in_article, _ = reader.marked[0]
        large = frozenset(i for i, (_, n, inside, whole) in enumerate(reader.marked)
                          if i and 2 * n > total and (inside == in_article or not whole))
        if large == kept:
            return reader.lines
        kept = large


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    radius = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    padded = np.pad(ratios, radius, mode="edge")
    return np.convolve(padded, kernel / kernel.sum(), mode="valid")


def main_text(html: str | None) -> str:
    lines = page_lines(html) if html else []
    if not lines:
        return ""
    chars = np.array([len(text) for text, *_ in lines], float)
    tags = np.array([n for _, n, *_ in lines], float)
    links = np.array([n for _, _, n, *_ in lines], float)
    section = np.array([s for _, _, _, s, _ in lines])
    article = np.array([a for *_, a in lines], bool)
    plain = chars - links
    ratio = smoothed(plain / np.maximum(tags, 1))
    content = ratio >= min(ratio.std(), ratio.mean())
    sections, of = np.unique(section, return_inverse=True)
    above = np.bincount(of, plain * content, len(sections))
    share = above / np.maximum(np.bincount(of, plain, len(sections)), 1)
    enough = min(_SHARE, share.max()) * np.where(article, _ARTICLE_SHARE, 1.0)
    chosen = share[of] >= enough
    return "\n".join(line[0] for line, keep in zip(lines, chosen) if keep)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` without its html, with the main text added (a column of that name is replaced)."""
    kept = [c for c in pages.columns if c not in (html_col, text_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, html in text_chunks(batch.column(len(kept)), _CHUNK_BYTES):
                texts = [main_text(h) for h in html]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(i, j - i) for c in batch.columns[:-1]] + [pa.array(texts, pa.string())],
                    names=[*kept, text_col])

    schema = StructType([*(pages.schema[c] for c in kept), StructField(text_col, StringType())])
    return pages.select(*kept, html_col).mapInArrow(run, schema)
