"""Main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines: every block element is a line of its own. Elements that stand around
an article (menus, page headers and footers, sidebars, reader comments) leave a gap of empty lines, and so do
the edges of what a page marks as an article (``article``, ``main``, ``articleBody``); elements that also stand
within one (scripts, forms, asides, adverts, notices) leave none. A class or id counts by a whole token or its
last part. A line other than a paragraph or heading whose text is mostly links has no size.

Sizes are summed over windows of ``WINDOW`` lines. A region begins where a sum surges above zero and ends where
it dives to zero again. Marks weigh lines: with ``share`` the part of the page's text that is marked, where marked
text counts ``FAVOUR`` times, marked lines weigh 2 share and others 2 (1 - share). So a marked article outweighs
what else is on its page, and a marked teaser does not outweigh an unmarked story. A region is kept if a weighted
sum in it reaches ``SURGE`` characters, or it is marked and the share is at least one half, or it lies between two
of its kind that are kept. If none is, the one with the highest sum is. Kept regions give all their lines,
those without size between others included.

Defined results
    A null or empty page has the empty text and no characters. Character references are decoded
    after the markup is gone. White space inside a line becomes one space; lines are joined by
    one. An element that is never closed ends with its parent, an article or the page; a raw
    element (script) ends with the page. Repeated rows are extracted alike. Further columns are
    not read. An empty table gives an empty result.

Scale
    One pass over the pages without a shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WINDOW = 3
SURGE = 86
FAVOUR = 3
LINK_SHARE = 0.5  # a line with more of its text in links is a menu, unless it is a paragraph
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 blockquote pre dd figcaption".split())

TAG = re.compile(r"""<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|$)|</?[A-Za-z][^>]*(?:>|$)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-hidden|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=\s|/|$)""", re.IGNORECASE)
NAME_WORDS = re.compile(r"[a-z]+|\d+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

RAW = set("script style title textarea noscript template iframe object svg math canvas audio video select option".split())
LEFT_OUT = set("nav header footer aside form menu button fieldset dialog datalist head".split())
ARTICLE = {"article", "main"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small"
    " span strike strong sub sup time tt u var wbr".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = set(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments"
    " consent cookie cookies copyright disclaimer disqus footer gdpr header masthead menu menus modal nav navbar"
    " navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion"
    " related replies respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription"
    " teaser toolbar widget".split()
)
AROUND = set(
    "nav header footer menu head banner breadcrumb breadcrumbs comment comments copyright disqus masthead menus navbar"
    " navigation pager pagination replies respond sidebar skip toolbar contentinfo complementary search menubar".split()
)  # elements, names and roles that end a region
STATES = set("has with no without is".split())  # has-sidebar says something of an element that is no sidebar
NEUTRAL = set(
    "area bar block body bottom box button buttons container content first form group icons inner item items last left"
    " link links list main message middle outer panel posts primary right secondary section slot text top unit wrap wrapper"
    " x".split()
)  # last parts that leave the name to the part before: adBox, sidebar-left
BOILERPLATE_ROLES = set("navigation banner contentinfo complementary search form menu menubar alert dialog toolbar".split())
ARTICLE_NAMES = {"articlebody"}


@dataclass
class Line:
    text: str
    linked: int
    inside: bool  # of an article
    paragraph: bool = False

    @property
    def size(self) -> int:
        return len(self.text) if self.paragraph or self.linked <= LINK_SHARE * len(self.text) else 0


@dataclass
class Stripper:
    """One walk over the tags of a page."""

    lines: list[Line] = field(default_factory=list)
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    links: int = 0
    block: str = ""  # the block element that the line began with
    articles: list[str] = field(default_factory=list)  # open elements that mark the article
    depths: list[int] = field(default_factory=list)  # of elements of the same name inside them
    skipped: str = ""
    depth: int = 0

    def text(self, data: str) -> None:
        if data and not self.skipped:
            self.pieces.append(data)
            if self.links:
                self.linked += len("".join(html.unescape(data).split()))

    def end_line(self) -> None:
        text = " ".join(html.unescape("".join(self.pieces)).split())
        if text:
            self.lines.append(Line(text, self.linked, bool(self.articles), self.block in PARAGRAPHS))
        self.pieces, self.linked, self.block = [], 0, ""

    def gap(self) -> None:
        self.end_line()
        if not self.articles:
            self.edge()

    def edge(self) -> None:
        self.lines += [Line("", 0, False)] * WINDOW

    def skip(self, name: str, around: bool) -> None:
        self.gap() if around else self.end_line()
        self.skipped, self.depth = name, 1

    def opened(self, name: str, attributes: str) -> None:
        marked = _marks(name, attributes)
        if self.skipped:
            if name in ARTICLE and self.skipped not in ARTICLE and marked in ("", "in"):
                self.skipped = ""
            elif name == "body" and self.skipped == "head":
                self.skipped = ""
                return
            else:
                self.depth += name == self.skipped and name not in VOID
                return
        if name not in INLINE:
            self.end_line()
        if name in VOID:
            return
        if name not in INLINE:
            self.block = name
        if marked in ("out", "around") and not (name == "header" and self.articles):
            self.skip(name, marked == "around")
        elif marked == "in":
            self.gap()
            self.articles.append(name)
            self.depths.append(1)
        else:
            if self.articles and name == self.articles[-1]:
                self.depths[-1] += 1
            self.links += name == "a"

    def closed(self, name: str) -> None:
        if self.skipped:
            if name == self.skipped:
                self.depth -= 1
                if self.depth == 0:
                    self.skipped = ""
            elif name in self.articles or name == "body":
                self.skipped = ""  # it was never closed
        if self.skipped:
            return
        if name not in INLINE:
            self.end_line()
            self.links = 0
        if name == "a":
            self.links = max(self.links - 1, 0)
        if name in self.articles:
            while self.articles[-1] != name:
                self.articles.pop()
                self.depths.pop()
            self.depths[-1] -= 1
            if self.depths[-1] == 0:
                self.articles.pop()
                self.depths.pop()
                self.gap()


def _called(token: str) -> str:
    """The name of a class or id: the whole of it, or its last part that is not neutral."""
    if token.lower() in BOILERPLATE:
        return token.lower()
    parts = NAME_WORDS.findall(CAMEL.sub(" ", token).lower())
    if not parts or parts[0] in STATES:
        return ""
    while len(parts) > 1 and (parts[-1] in NEUTRAL or parts[-1].isdigit()):
        parts.pop()
    return parts[-1]


def _marks(name: str, attributes: str) -> str:
    """Whether an element is the article (in), never part of it (out, or around it), or neither."""
    given = {}
    for key, value in ATTRIBUTE.findall(attributes) if attributes.strip(" /") else ():
        given.setdefault(key.lower(), value.strip("\"'"))
    classes = given.get("class", "").split()
    names = {_called(token) for token in [*classes, *given.get("id", "").split()]} & BOILERPLATE
    roles = set(given.get("role", "").lower().split())
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true"
    hidden = hidden or "display:none" in given.get("style", "").replace(" ", "").lower()
    if name in ("html", "body"):
        return ""
    if hidden:
        return "out"
    if name == "main" or "main" in roles or given.get("itemprop", "").lower() in ARTICLE_NAMES:
        return "in"
    if name in ARTICLE:
        names = {token.lower() for token in classes} & BOILERPLATE
    found = names | roles & BOILERPLATE_ROLES | {name} & LEFT_OUT
    if found:
        return "around" if found & AROUND else "out"
    if name in ARTICLE:
        return "in"
    return ""


def strip_markup(page: str) -> list[Line]:
    walk, at = Stripper(), 0
    while match := TAG.search(page, at):
        walk.text(page[at : match.start()])
        at = match.end()
        if match[2] is None:
            if not match[0].startswith(("<!", "<?")):  # a tag with an unclosed quote
                walk.end_line()
            continue
        name = match[2].lower()
        if match[1]:
            walk.closed(name)
        elif name in RAW and not match[3].endswith("/"):
            if not walk.skipped and name not in INLINE:
                walk.end_line()
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = close.end() if close else len(page)
        else:
            walk.opened(name, match[3])
    walk.text(page[at:])
    walk.end_line()
    return walk.lines


@dataclass
class Region:
    """Lines first to last (exclusive) between a surge and a dive, and the highest sum of windows in it."""

    first: int
    last: int
    highest: float
    marked: bool


def regions(sizes: np.ndarray, weights: np.ndarray, marked: np.ndarray) -> list[Region]:
    # sums[i] covers the lines i - WINDOW + 1 to i.
    sums = np.convolve(sizes, np.ones(WINDOW, np.int64))
    weighted = np.convolve(sizes * weights, np.ones(WINDOW))
    full = np.concatenate([[False], sums > 0, [False]])
    surges, dives = np.flatnonzero(full[1:] & ~full[:-1]), np.flatnonzero(full[:-1] & ~full[1:])
    return [
        Region(int(a), int(b) - WINDOW + 1, float(weighted[a:b].max()), bool(marked[a])) for a, b in zip(surges, dives, strict=True)
    ]


def kept_regions(found: list[Region], share: float) -> list[Region]:
    high = [r.highest >= SURGE or r.marked and share >= 0.5 for r in found]
    if not any(high):
        best = max((r.highest for r in found), default=0.0)
        high = [r.highest == best for r in found]
    kept = []
    for i, region in enumerate(found):
        alike = [high[k] and r.marked == region.marked for k, r in enumerate(found)]
        if high[i] or any(alike[:i]) and any(alike[i + 1 :]):
            kept.append(region)
    return kept


def main_text(page: str | None) -> str:
    lines = strip_markup(page or "")
    sizes = np.array([line.size for line in lines], np.int64)
    marked = np.array([line.inside for line in lines], bool)
    inside, outside = FAVOUR * int(sizes[marked].sum()), int(sizes[~marked].sum())
    share = inside / max(inside + outside, 1)
    # Without any mark all lines weigh 1.
    weights = np.where(marked, 2 * share, 2 * (1 - share)) if inside else np.ones(len(lines))
    kept = kept_regions(regions(sizes, weights, marked), share) if sizes.any() else []
    return " ".join([line.text for r in kept for line in lines[r.first : r.last] if line.text])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    types = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page) for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    schema = f"page_id {types['page_id']}, url {types['url']}, text string, n_chars bigint"
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)
