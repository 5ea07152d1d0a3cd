"""Main text of web pages by text-to-tag ratios.

Events of the standard library's HTML parser are turned into lines, one for each block of the page, while it streams: a
line has its text, the number of tags met since the line before, and the element it stands in. Text inside menus,
headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts and reader comments is left out by
element, role, or a class or id that names such a part as a whole (`related-posts`, not `related-work` or `has-sidebar`);
but a form, or an element so named, that encloses the main text (an article, main, an h1 or most of the text) is a
wrapper and stays. The ratio of text characters to tags of each other line, less where a class or id only mentions such
a part (HINTED), is smoothed by a Gaussian kernel, and lines above a threshold (a share of the ratios' standard
deviation) are clustered as content. Clustered lines that have such a ratio of their own, and not only beside others,
and are not link text alone are the core.

The region is the smallest element around the core, widened as region() says. An article or main is taken whole. In
any other region the clusters decide: the lines from the first of the core to the last are the text, and before and
after them those whose nearest box (a div, section, table cell or the like inside the region) holds some of the core or
that are in no box, as titles, leads and ends are; a box of nothing but short lines or links is none of the text.

White space inside a block becomes one space; blocks are joined by one newline. Elements are numbered as they start, so
an element holds the numbers up to the last one inside it, and no step looks at all open elements of each line: the time
grows in proportion to the page. A tag or comment that the page's end leaves unfinished is dropped, as browsers do.

Defined cases: null and empty pages have an empty text; pages of nothing but removed parts too; elements may be nested
to any depth and need not be closed; very long pages are taken whole; repeated rows get a row each; other columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from html.parser import HTMLParser

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Production parameters: kernel radius and width in lines, threshold in standard deviations, factor of hinted lines' ratios.
RADIUS, SIGMA, THRESHOLD, HINTED = 2, 1.0, 0.5, 0.5

# Element names, and words of class and id attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot "
    "th thead title tr ul".split()
)
REMOVED = frozenset(
    "aside button canvas dialog embed fieldset footer form head iframe input math menu nav noscript object option script "
    "select style svg template textarea title".split()
)
BOXES = frozenset("blockquote center details div dl figure form section table td th ol ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
WORDS = frozenset(
    "ad ads adv advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disclaimer footer form gdpr header login masthead menu menus modal nav navbar navigation newsletter notice "
    "notices notification pagination pager popup promo promoted promotion recommended related replies responses share sharing "
    "sidebar signup social sponsor sponsored subscribe subscription tags teaser toolbar widget widgets".split()
)
#: Words that leave the meaning of one of WORDS beside them as it is.
PLAIN = frozenset(
    "area articles bar block bottom box boxes button buttons container content global icons inner item items left links list "
    "main outer page pages panel posts primary reader right secondary section site stories thread top us user wrap wrapper".split()
)
#: Elements whose start ends an open one of the same kind, and of those named.
ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Elements beyond which an implied end does not reach.
SCOPES = frozenset("article aside blockquote body div dl footer form header li main nav ol section table td th ul".split())
_SPLIT = re.compile(r"[^a-z]+")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")

STAYS, HINT, NAMED, GONE = range(4)


def role_of(tag: str, attributes: dict[str, str | None], inside_article: bool) -> int:
    """GONE: an element is no main text by what it is; NAMED: by what it is called, or as a form; HINT: its name has such a word."""
    if tag in REMOVED and tag != "form" or "hidden" in attributes or attributes.get("aria-hidden") == "true":
        return GONE
    if tag == "header" and not inside_article:
        return GONE
    if (attributes.get("role") or "").lower() in ROLES:
        return GONE
    if re.search(r"display\s*:\s*none", attributes.get("style") or ""):
        return GONE
    if tag == "form":
        return NAMED
    names = f"{attributes.get('class') or ''} {attributes.get('id') or ''}".split()
    if not names or tag in ("html", "body", "main") or tag in HEADINGS:
        return STAYS
    words = WORDS - {"header", "banner", "form", "tags"} if inside_article else WORDS
    found = STAYS
    for name in names:
        parts = {p for p in _SPLIT.split(re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower()) if p}
        if parts & words:
            if parts <= words | PLAIN:
                return NAMED
            found = HINT
    return found


class Line:
    """Parts of text with the element that each stands in, the tags before it, and the innermost element open at its end."""

    __slots__ = ("parts", "tags", "node", "heading")

    def __init__(self, parts: list[tuple[int, bool, str]], tags: int, node: int, heading: bool) -> None:
        self.parts, self.tags, self.node, self.heading = parts, tags, node, heading


class Page(HTMLParser):
    """Lines and elements of a page. An element is a number in order of their starts; 0 is the page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.names, self.parent, self.role, self.end, self.size = [""], [0], [STAYS], [0], [0]
        self.open: list[int] = []
        self.has: Counter[str] = Counter()  # open elements by name
        self.headings = self.hard = 0
        self.marks: list[int] = []  # places in open of elements that implied ends look at
        self.lines: list[Line] = []
        self.parts: list[tuple[int, bool, str]] = []  # element, whether in a link, text
        self.tags = 0

    def flush(self) -> None:
        if self.parts:
            self.lines.append(Line(self.parts, self.tags, self.open[-1] if self.open else 0, self.headings > 0))
            self.parts, self.tags = [], 0

    def shut(self, k: int) -> None:
        """Ends the k-th open element and all inside it."""
        last = len(self.names) - 1
        for n in self.open[k:]:
            name = self.names[n]
            self.end[n] = last
            self.has[name] -= 1
            self.headings -= name in HEADINGS
            self.hard -= self.role[n] == GONE
        del self.open[k:]
        while self.marks and self.marks[-1] >= k:
            self.marks.pop()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if tag == "br":
            self.text(" ")
        if tag == "body" and self.has["head"]:
            self.shut(next(k for k, n in enumerate(self.open) if self.names[n] == "head"))
        if tag in ENDS:
            for k in reversed(self.marks):
                name = self.names[self.open[k]]
                if name in ENDS[tag]:
                    self.shut(k)
                    break
                if name in SCOPES:
                    break
        if tag in VOID:
            return
        role, n = role_of(tag, dict(attrs), self.has["article"] > 0), len(self.names)
        self.names.append(tag)
        self.parent.append(self.open[-1] if self.open else 0)
        self.role.append(role)
        self.end.append(n)
        self.size.append(0)
        if tag in ENDS or tag in SCOPES:
            self.marks.append(len(self.open))
        self.open.append(n)
        self.has[tag] += 1
        self.headings += tag in HEADINGS
        self.hard += role == GONE

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if self.has[tag] > 0:
            k = len(self.open) - 1
            while self.names[self.open[k]] != tag:
                k -= 1
            self.shut(k)

    def text(self, data: str) -> None:
        if not self.hard and not (self.has["header"] and not self.headings):
            self.parts.append((self.open[-1] if self.open else 0, self.has["a"] > 0, data))

    def handle_data(self, data: str) -> None:
        if not self.hard:
            self.size[self.open[-1] if self.open else 0] += len(data.strip())
        self.text(data)

    def finish(self) -> None:
        """What an unfinished tag or comment leaves over is dropped; the rest is text."""
        cut = self.rawdata.find("<")
        self.rawdata = self.rawdata if cut < 0 else self.rawdata[:cut]
        self.close()
        self.flush()
        self.shut(0)
        self.end[0] = len(self.names) - 1


def parsed(html: str) -> Page:
    page = Page()
    page.feed(html)
    page.finish()
    return page


def removed_of(page: Page) -> list[bool]:
    """For each element whether its text is left out.

    An element of what is called so stays if it holds the page's main text and not an addition to it: it is or encloses
    an article of at least half of the largest one's text, or main; or holds more than half of the text of the article,
    main or page that it stands in; or holds an h1 where the page has no article.
    """
    n, names, parent = len(page.names), page.names, page.parent
    size, gone = list(page.size), [False] * n
    for k in range(1, n):
        gone[k] = gone[parent[k]] or page.role[k] == GONE
    for k in range(n - 1, 0, -1):
        size[parent[k]] += size[k]
    articles = [k for k in range(n) if names[k] == "article" and size[k] and not gone[k]]
    most = max((size[k] for k in articles), default=0)
    kept = {k for k in articles if 2 * size[k] >= most} | {k for k in range(n) if names[k] == "main" and size[k] and not gone[k]}
    holds = [k in kept or not articles and names[k] == "h1" and not gone[k] for k in range(n)]
    for k in range(n - 1, 0, -1):
        if holds[k] and names[k] != "h1" or holds[k] and not articles:
            holds[parent[k]] = True
    inside = [0] * n  # the nearest kept article or main around an element
    out = [False] * n
    for k in range(1, n):
        p = parent[k]
        inside[k] = p if p in kept else inside[p]
        named = page.role[k] == NAMED and not holds[k] and not (2 * size[k] > size[inside[k]] > 0 and (inside[k] or not kept))
        out[k] = out[p] or gone[k] or named
    return out


def content(page: Page) -> list[tuple[str, int, int, bool, bool]]:
    """(text, tags, element, whether link text alone, whether hinted) of the lines that aren't removed."""
    out, removed = [], removed_of(page)
    hinted = [False] * len(page.names)
    for k in range(1, len(hinted)):
        hinted[k] = hinted[page.parent[k]] or page.role[k] == HINT
    tags = 0
    for line in page.lines:
        tags += line.tags
        parts = [p for p in line.parts if not removed[p[0]]]
        text = _SPACE.sub(" ", "".join(p[2] for p in parts)).strip(" ")
        if text:
            link = not line.heading and not any(not a and data.strip() for _, a, data in parts)
            out.append((text, tags, line.node, link, hinted[line.node]))
            tags = 0
    return out


def smoothed(ratios: np.ndarray, radius: int = RADIUS, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, the kernel cut at the page's ends."""
    at = np.arange(-radius, radius + 1)
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    total = np.convolve(ratios, kernel, "full")[radius : radius + len(ratios)]
    return total / np.convolve(np.ones(len(ratios)), kernel, "full")[radius : radius + len(ratios)]


def content_lines(lines: list[tuple[str, int, int, bool, bool]]) -> tuple[np.ndarray, np.ndarray]:
    """Whether each line is in a content cluster by its smoothed text-to-tag ratio, and whether its own ratio is as high."""
    own = np.array([len(t) / max(1, n) * (HINTED if hint else 1) for t, n, _, _, hint in lines], float)
    ratios = smoothed(own)
    limit = min(THRESHOLD * ratios.std(), ratios.max())
    return ratios >= limit, own >= limit


def core_of(lines: list[tuple[str, int, int, bool, bool]]) -> list[int]:
    """The clustered lines that aren't link text alone and have a high ratio of their own; without any, those that aren't links; else all."""
    clustered, high = content_lines(lines)
    texts = clustered & ~np.array([line[3] for line in lines])
    return np.flatnonzero(next(x for x in (texts & high, texts, clustered) if x.any())).tolist()


def region(page: Page, lines: list[tuple[str, int, int, bool, bool]], core: list[int]) -> tuple[int, bool]:
    """The element that bounds the main text, and whether it is taken whole: the smallest around the core.

    In an article or main it is widened to the outermost article and on to main, elsewhere to the elements around it,
    as long as that adds no line of link text alone.
    """
    parent, end = page.parent, page.end
    nodes = [lines[k][2] for k in core]
    low, high = min(nodes), max(nodes)
    at = low
    while end[at] < high:
        at = parent[at]
    around, k = [], at
    while k:
        if page.names[k] in ("article", "main"):
            around.append(k)
        k = parent[k]
    articles = [k for k in around if page.names[k] == "article"]
    at = articles[-1] if articles else around[-1] if around else at
    least = around[-1] if around else 0
    links = sorted(line[2] for line in lines if line[3])
    held = lambda k: bisect_right(links, end[k]) - bisect_left(links, k)
    while at != least and held(parent[at]) == held(at):
        at = parent[at]
    return at, bool(around)


def main_text(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    page = parsed(html)
    lines = content(page)
    if not lines:
        return ""
    core = core_of(lines)
    at, whole = region(page, lines, core)
    inside = [k for k, line in enumerate(lines) if at <= line[2] <= page.end[at]]
    if not whole:
        box = [0] * len(page.names)  # the nearest box inside the region
        for k in range(at + 1, page.end[at] + 1):
            box[k] = k if page.names[k] in BOXES else box[page.parent[k]]
        places = sorted(lines[k][2] for k in core)
        full = lambda b: not b or bisect_left(places, b) < bisect_right(places, page.end[b])
        inside = [k for k in inside if core[0] <= k <= core[-1] or full(box[lines[k][2]])]
    return "\n".join(lines[k][0] for k in inside)


TEXTS = T.StructType(
    [T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def extract(pages: DataFrame) -> DataFrame:
    """One row a page: page_id, url, text, n_chars."""
    common.ship(pages.sparkSession)

    def make(batch):
        texts = [main_text(h) for h in batch.column(2).to_pylist()]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return common.map_rows(pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")), make, TEXTS)
