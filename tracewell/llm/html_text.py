"""Main text of web pages from text-to-tag ratios.

The standard library's parser streams a page's events into lines, one for each
block of text of the whole page, menus and all; only what no browser shows as
text (scripts, styles, form controls, comments) is passed over. A line's
text-to-tag ratio counts its characters outside links over its tags. Gaussian
smoothing of the ratios' logarithms and a threshold between their two means
cluster the lines: each gets a value between -1 and 1 by its distance from the
threshold. The content region is the container with the greatest sum of values:
paragraphs speak for it, menus and link lists against, and a short paragraph
stays with its neighbours. Where nothing but the page's body holds the clusters,
the region reaches from the first cluster to the last.

Tags correct the edges: a menu, footer, form or side column is no region while
another has text, ``article`` and ``main`` count as a little more, and inside the
region elements go that say by tag, role or name that they are no article text,
unless they hold most of it.

Then the region's own structure speaks, whatever its names: where most of the
text lies in one part of it, its own blocks or one division, other divisions
are boxes beside the text (readers' comments, related pages, an invitation to
subscribe) if links fill them or several blocks stand in them. A division stays
if it is of the same make as the one that holds the text, or if a heading leads
it, its blocks are about as long as the text's, and it is not a row of like
parts. Elements are numbered as they open, so an element's own are a range of
numbers, and sums go from the last number to the first: time is linear in the
page, however deep it is.
"""

from __future__ import annotations

from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.common import annotate

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HIDDEN = frozenset("script style noscript template iframe object svg canvas button select textarea head title audio video".split())
ASIDE = frozenset("nav header footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Whole names (class or id) of elements beside an article's text.
NAMES = frozenset(
    "ad ads advert adverts advertisement sponsored promo comments comment-list commentlist disqus_thread respond "
    "sidebar cookie-notice cookie-banner newsletter breadcrumb breadcrumbs share-buttons".split()
)
CONTAINERS = frozenset("article main section div td center body html nav header footer aside form menu dialog ul ol dl table".split())
DIVISIONS = frozenset("article main section div td center".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_BLOCK = frozenset(("p",))
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table select article section div main body blockquote".split())

#: Characters for each tag that are text on any page: where all lines have more, none is below the threshold.
TEXT_RATIO = 20
#: Lines that ``article`` and ``main`` count more; standard deviation of the smoothing, in lines.
BONUS, SIGMA = 2.0, 1.0

SHOWN, BESIDE, UNSEEN = 0, 1, 2


def kind_of(tag: str, attrs: list[tuple[str, str | None]]) -> int:
    """Whether an element is text, text beside the article, or nothing that is shown."""
    if tag in HIDDEN:
        return UNSEEN
    kind = BESIDE if tag in ASIDE else SHOWN
    for name, value in attrs:
        value = value or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower():
            return UNSEEN
        if name == "role" and value.strip().lower() in ROLES or name in ("class", "id") and not NAMES.isdisjoint(value.lower().split()):
            kind = BESIDE
    return SHOWN if tag in ("body", "html") else kind


class Line:
    __slots__ = ("element", "linked", "tags", "text")

    def __init__(self, text: str, linked: int, tags: int, element: int):
        self.text, self.linked, self.tags, self.element = text, linked, tags, element


class Page(list):
    """The lines of a page, and its elements by number: 0 is the page, and a parent's number is below its children's."""

    def __init__(self):
        super().__init__()
        self.tag, self.make = [""], [""]
        self.parent, self.depth, self.kind, self.last = [0], [-1], [SHOWN], [0]

    def open(self, tag: str, make: str, parent: int, kind: int) -> int:
        for column, value in ((self.tag, tag), (self.make, make), (self.parent, parent), (self.depth, self.depth[parent] + 1), (self.kind, kind), (self.last, 0)):
            column.append(value)
        return len(self.tag) - 1

    def sums(self, of: list[float]) -> list[float]:
        """For each element the sum of ``of`` (by line) over the lines within it."""
        out = [0.0] * len(self.tag)
        for line, value in zip(self, of, strict=True):
            out[line.element] += value
        for n in range(len(out) - 1, 0, -1):
            out[self.parent[n]] += out[n]
        return out

    def within(self, region: int) -> list[int]:
        """Numbers of the lines within an element."""
        last = self.last[region]
        return [i for i, line in enumerate(self) if region <= line.element <= last]


class Lines(HTMLParser):
    """Collects a line for each block of text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page()
        self.stack: list[int] = []
        self.parts: list[str] = []
        self.tags = self.linked = 0
        self.skipping = self.links = 0
        self.open_blocks: Counter = Counter()
        self.open_inline = [Counter()]  # of the elements in each open block that are none

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.page.append(Line(text, self.linked, self.tags, self.stack[-1] if self.stack else 0))
            self.tags = 0
        self.linked = 0
        self.parts.clear()

    def pop(self, depth: int) -> None:
        page = self.page
        while len(self.stack) > depth:
            n = self.stack.pop()
            tag = page.tag[n]
            page.last[n] = len(page.tag) - 1
            self.skipping -= page.kind[n] == UNSEEN
            self.links -= tag == "a"
            if tag in BLOCKS:
                self.open_blocks[tag] -= 1
                self.open_inline.pop()
            else:
                self.open_inline[-1][tag] -= 1

    def handle_starttag(self, tag, attrs):
        if not self.skipping:
            self.tags += 1
        page = self.page
        if tag in BLOCKS:
            self.flush()
            for closes in (SIBLINGS.get(tag, ()), CLOSED_BY_BLOCK):
                if not any(self.open_blocks[t] for t in closes):
                    continue
                for depth in range(len(self.stack) - 1, -1, -1):
                    if page.tag[self.stack[depth]] in closes:
                        self.pop(depth)
                        break
                    if page.tag[self.stack[depth]] in SCOPE:
                        break
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            return
        kind = kind_of(tag, attrs)
        if kind != SHOWN:
            self.flush()
        make = next((f"{tag}.{' '.join(sorted((v or '').split()))}" for k, v in attrs if k == "class"), tag)
        self.stack.append(page.open(tag, make, self.stack[-1] if self.stack else 0, kind))
        if tag in BLOCKS:
            self.open_blocks[tag] += 1
            self.open_inline.append(Counter())
        else:
            self.open_inline[-1][tag] += 1
        self.skipping += kind == UNSEEN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        elif not self.skipping:
            self.tags += 1

    def handle_endtag(self, tag):
        if not self.skipping:
            self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self.flush()
        # An inline end tag does not close blocks, and what is not open is not looked for.
        if not (self.open_blocks[tag] if tag in BLOCKS else self.open_inline[-1][tag]):
            return
        depth = len(self.stack) - 1
        while self.page.tag[self.stack[depth]] != tag:
            depth -= 1
        if self.page.kind[self.stack[depth]] == BESIDE:
            self.flush()
        self.pop(depth)

    def handle_data(self, data):
        if not self.skipping:
            self.parts.append(data)
            if self.links:
                self.linked += len(data.strip())


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    if sigma <= 0:
        return values
    reach = int(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(values, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def ratios(lines: list[Line]) -> np.ndarray:
    """Characters outside links for each tag of a line."""
    return np.array([max(0, len(x.text) - x.linked) / max(1, x.tags) for x in lines])


def threshold(levels: np.ndarray) -> float:
    """Halfway between the means of the levels above and below it, found by iteration; ``TEXT_RATIO`` at most."""
    at = float(levels.mean())
    for _ in range(32):
        high, low = levels[levels > at], levels[levels <= at]
        if not len(high) or not len(low):
            break
        moved = float(high.mean() + low.mean()) / 2
        if abs(moved - at) < 1e-9:
            break
        at = moved
    return min(at, float(np.log1p(TEXT_RATIO)))


def line_values(lines: list[Line], sigma: float = SIGMA) -> np.ndarray:
    """Between -1 and 1: how far a line's smoothed ratio is from the clusters' border."""
    levels = smooth(np.log1p(ratios(lines)), sigma)
    return np.clip(levels - threshold(levels), -1, 1)


def content_lines(page: Page, values: np.ndarray | None = None, tag_rules: bool = True) -> list[int]:
    """Numbers of the lines of the main text; without ``tag_rules`` by ratios and containers alone."""
    if not page:
        return []
    values = line_values(page) if values is None else values
    sums = page.sums([float(v) for v in values])
    held = page.sums([1.0] * len(page))
    first = [len(page)] * len(page.tag)
    for i in range(len(page) - 1, -1, -1):
        first[page[i].element] = i
    for n in range(len(first) - 1, 0, -1):
        first[page.parent[n]] = min(first[page.parent[n]], first[n])
    aside = [False] * len(page.tag)
    for n in range(1, len(aside)):
        aside[n] = aside[page.parent[n]] or page.kind[n] == BESIDE
    containers = [n for n in range(1, len(sums)) if held[n] and page.tag[n] in CONTAINERS]
    if tag_rules:
        for n in containers:
            if page.tag[n] in ("article", "main") and not aside[n]:
                sums[n] += BONUS
    able = [n for n in containers if not (tag_rules and aside[n])] or containers
    region = max(able, key=lambda n: (round(sums[n], 9), page.depth[n], -first[n]), default=0)
    if page.tag[region] in ("", "body", "html"):
        dense = np.flatnonzero(values > 0)
        if not len(dense):
            dense = np.arange(len(page))
        low, high = int(dense[0]), int(dense[-1])
        while low < high and 2 * page[low].linked > len(page[low].text):
            low += 1
        while low < high and 2 * page[high].linked > len(page[high].text):
            high -= 1
        while low and not page[low - 1].linked:
            low -= 1
        while high + 1 < len(page) and not page[high + 1].linked:
            high += 1
        chosen = list(range(low, high + 1))
    else:
        chosen = page.within(region)
    if not tag_rules:
        return chosen
    chosen = without_asides(page, chosen, region)
    return chosen if page.tag[region] in ("", "body", "html") else without_boxes(page, chosen, region)


def without_asides(page: Page, chosen: list[int], region: int) -> list[int]:
    """Leave out what stands beside the text within a region, but for an element that holds most of it."""
    counts = [0] * len(page)
    for i in chosen:
        counts[i] = len(page[i].text)
    size, total = page.sums(counts), sum(counts)
    gone = [False] * len(page.tag)
    for n in range(region + 1, page.last[region] + 1 if region else len(gone)):
        beside = page.kind[n] == BESIDE and (page.tag[n] in ASIDE or 2 * size[n] < total)
        gone[n] = beside or page.parent[n] > region and gone[page.parent[n]]
    return [i for i in chosen if not gone[page[i].element]]


class _Parts:
    """The divisions of a region with sums over the chosen lines within each, or (``own``) within none of its divisions."""

    def __init__(self, page: Page, chosen: list[int], region: int):
        self.page, size = page, page.last[region] + 1 - region
        at = {n: 0 for n in ("chars", "linked", "lines", "rest", "length")}
        self.all = {n: [0] * size for n in at}
        self.own = {n: [0] * size for n in at}
        self.start, self.holder, self.below, self.makes = region, [0] * size, [[] for _ in range(size)], [None] * size
        self.first = [len(page)] * size
        for n in range(region + 1, region + size):
            k, above = n - region, page.parent[n] - region
            division = page.tag[n] in DIVISIONS
            self.holder[k] = k if division else self.holder[above]
            if division:
                self.below[self.holder[above]].append(k)
            if (division or page.tag[n] == "li") and (above == 0 or page.tag[n - k + above] in DIVISIONS):
                self.makes[above] = self.makes[above] or Counter()
                self.makes[above][page.make[n]] += 1
        for i in chosen:
            line = page[i]
            k = self.holder[line.element - region]
            plain = page.tag[line.element] not in HEADINGS
            self.first[k] = min(self.first[k], i)
            for name, value in (("chars", len(line.text)), ("linked", line.linked), ("lines", 1), ("rest", plain), ("length", plain * len(line.text))):
                self.own[name][k] += value
                self.all[name][k] += value
        for k in range(size - 1, 0, -1):
            if page.tag[region + k] in DIVISIONS:
                above = self.holder[page.parent[region + k] - region]
                self.first[above] = min(self.first[above], self.first[k])
                for column in self.all.values():
                    column[above] += column[k]

    def is_box(self, k: int, most: int, length: float) -> bool:
        """Whether division ``k`` stands beside the text, which division ``most`` (0: none) holds in blocks of mean ``length``."""
        page, of = self.page, self.all
        if 2 * of["linked"][k] >= of["chars"][k]:
            return True
        if of["lines"][k] < 2 or most and page.make[self.start + k] == page.make[self.start + most]:
            return False
        headed = page.tag[page[self.first[k]].element] in HEADINGS
        like = max((self.makes[k] or Counter()).values(), default=0)
        return not (headed and like < 2 and 2 * of["length"][k] / max(of["rest"][k], 1) >= length)

    def boxes(self) -> list[int]:
        """Numbers of the divisions that stand beside the part that holds at least half of the text, part within part."""
        gone, k = [], 0
        while True:
            under = [x for x in self.below[k] if self.all["lines"][x]]
            total = self.own["chars"][k] + sum(self.all["chars"][x] for x in under)
            most = 0 if 2 * self.own["chars"][k] >= total else next((x for x in under if 2 * self.all["chars"][x] >= total), None)
            if most is None:
                return gone + [self.start + x for x in under if 2 * self.all["linked"][x] >= self.all["chars"][x]]
            of, x = (self.all, most) if most else (self.own, k)
            length = of["length"][x] / max(of["rest"][x], 1)
            gone += [self.start + x for x in under if x != most and self.is_box(x, most, length)]
            if not most:
                return gone
            k = most


def without_boxes(page: Page, chosen: list[int], region: int) -> list[int]:
    """Leave out divisions of a region that stand beside its text."""
    out = set(_Parts(page, chosen, region).boxes())
    if not out:
        return chosen
    gone = [False] * (page.last[region] + 1)
    for n in range(region + 1, len(gone)):
        gone[n] = n in out or gone[page.parent[n]]
    return [i for i in chosen if not gone[page[i].element]]


def page_lines(html: str | None) -> Page:
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    parser.pop(0)
    parser.page.last[0] = len(parser.page.tag) - 1
    return parser.page


def main_text(html: str | None) -> str:
    lines = page_lines(html)
    return " ".join(lines[i].text for i in content_lines(lines))


def extract_text(pages: DataFrame, html: str = "html", keep: list[str] | None = None) -> DataFrame:
    """Add ``text`` and ``n_chars`` (code points) to every row.

    A null or empty page, and one without article text, has the empty text.
    Malformed markup is read as far as it goes; a tag that never ends holds no
    text. Pages of any length are read whole; equal pages have equal texts.
    Between containers of equal sums the innermost, then the first, is taken.
    Columns named like the new ones are replaced; an empty table gives none.
    """
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def make():
        def run(pages):
            texts = [main_text(p) for p in pages]
            return texts, [len(t) for t in texts]

        return run

    return annotate(pages, [html], fields, make, keep, slice_rows=512)


def op6_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of all ``pages``; nulls, empty and repeated pages as in ``extract_text``."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extract_text(pages, keep=["page_id", "url"]).select("page_id", "url", "text", F.col("n_chars"))
