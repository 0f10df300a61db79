"""Main text of HTML pages: streaming parser events, text-to-tag ratios, smoothing, threshold clustering.

``html.parser`` events become blocks (what stands between block-level tags).  Each block
is a line with a ratio of text characters to tags; the ratios are smoothed by a Gaussian
and split into two clusters.  The lines of the content cluster that are not mostly links
vote, in all regions alike: article, main and the other block containers.  Their smallest
common region is returned whole, so that a short paragraph or section is never lost; if it
stands in an article or main, or is only a part (a section, a cell), what holds it is.  Elements that are never main text (menus,
headers, footers, asides, forms, scripts, notices, adverts, comments) are left out before:
by tag, role or a whole class name.  Those with such a word in a longer name, with a name that
main text may have too (social, legal, share), and articles in other regions (teasers) go
only if their text is mostly links.
"""

from __future__ import annotations

import functools
import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_WORDS = lambda s: frozenset(s.split())
VOID = _WORDS("area base br col embed hr img input link meta param source track wbr")
RAW_SKIP = _WORDS("script style noscript template")
SKIP = _WORDS("head title nav header footer aside form button select textarea iframe object svg canvas dialog menu audio video map datalist") | RAW_SKIP
BLOCK = _WORDS("html body address article blockquote br center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hr li main ol p pre section summary table tbody td tfoot th thead tr ul caption") | SKIP
REGION = _WORDS("article main")
CONTAINER = _WORDS("article main section div td body blockquote")
PART = _WORDS("section td blockquote")  # never the whole of a text
CLOSES_P = BLOCK - _WORDS("br html body td th tr tbody thead tfoot caption summary figcaption dt dd li")
ROLES = _WORDS("navigation banner contentinfo complementary search form dialog alert menu menubar")
NOISE = _WORDS(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar navigation menu "
    "breadcrumb breadcrumbs footer sidebar aside cookie cookies consent notice notices notification gdpr popup modal "
    "newsletter subscribe login comment comments commentlist disqus replies pagination pager"
)
DOUBT = NOISE | _WORDS("header masthead widget overlay subscription signup share sharing social related recommended reply respond toolbar skip copyright legal disclaimer teaser")
SCOPE = _WORDS("html table td th caption button object")  # a p outside of these is not closed by a block in them
_TOKEN = re.compile(r"[a-z]+")


def _suspect(attrs) -> bool:
    """Whether a part of a class or id is a name of DOUBT: then the element is left out if it is mostly links."""
    return any(value and name in ("class", "id") and not DOUBT.isdisjoint(_TOKEN.findall(value.lower())) for name, value in attrs)


def _noisy(attrs) -> bool:
    """Whether an element is left out whatever it holds."""
    for name, value in attrs:
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if value and name in ("class", "id") and not NOISE.isdisjoint(value.lower().split()):
            return True
        if value and name == "role" and value.lower() in ROLES:
            return True
        if value and name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


class _Blocks(HTMLParser):
    """Blocks of a page as (text, tags, region): region is the innermost container."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int]] = []  # name, whether what is around is left out, region
        self.places: dict[str, list[int]] = {"p": [], "": [], "scope": []}  # in ``open``, by name; "": containers and left-out elements, "scope": those of SCOPE
        self.skip, self.region, self.regions = False, 0, [("body", 0)]  # kind and parent of each region
        self.suspects: list[int] = []  # regions with a doubtful name
        self.link, self.linked = False, 0  # whether in a link, and characters of the block in links
        self.links: list[int] = []  # of each block, the characters in links
        self.text: list[str] = []
        self.tags = 1
        self.blocks: list[tuple[str, int, int]] = []

    def updatepos(self, i, j):
        """Line numbers are not needed."""
        return j

    def flush(self) -> None:
        if self.text:
            text = " ".join("".join(self.text).split())
            if text:
                self.blocks.append((text, self.tags, self.region))
                self.links.append(self.linked)
                self.tags = 1
            self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK:
            self.flush()
            p, scope = self.places["p"], self.places["scope"]
            if tag in CLOSES_P and p and (not scope or p[-1] > scope[-1]):
                self._close("p")
            elif tag in ("li", "tr", "td", "th", "dt", "dd") and self.open and self.open[-1][0] == tag:
                self._close(tag)
        if tag in VOID:
            self.tags += not self.skip
            return
        for key in self._keys(tag):
            self.places.setdefault(key, []).append(len(self.open))
        self.open.append((tag, self.skip, self.region))
        if self.skip:
            return
        self.tags += 1
        self.link |= tag == "a" and any(name == "href" for name, _ in attrs)
        if tag in SKIP or attrs and tag not in ("html", "body") and _noisy(attrs):
            self.skip = True
            return
        doubt = bool(attrs) and tag in BLOCK and tag not in ("html", "body") and _suspect(attrs) or tag == "article" and self._in_region()
        if tag in CONTAINER or doubt:
            self.regions.append((tag, self.region))
            self.region = len(self.regions) - 1
            if doubt:
                self.suspects.append(self.region)

    def _in_region(self) -> bool:
        """Whether an article or main is around."""
        return bool(self.places.get("article") and len(self.places["article"]) > 1 or self.places.get("main"))

    @staticmethod
    def _keys(tag: str) -> list[str]:
        return [tag, *([""] if tag in CONTAINER or tag in SKIP else []), *(["scope"] if tag in SCOPE else [])]

    def _close(self, tag: str) -> None:
        """Close the last open element of this name and all in it; each element is closed once, so pages of any depth take linear time."""
        places, walls = self.places.get(tag), self.places[""]
        if not places:
            return
        k = places[-1]
        if walls and walls[-1] > k and tag not in CONTAINER and tag not in SKIP:
            return  # a stray end tag does not close what is around it
        _, self.skip, self.region = self.open[k]
        while len(self.open) > k:
            for key in self._keys(self.open.pop()[0]):
                self.places[key].pop()

    def handle_endtag(self, tag):
        self.link &= tag != "a"
        if tag in BLOCK:
            self.flush()
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)
            if self.link:
                self.linked += len(data.strip())


def _content(blocks: list[tuple[str, int, int]], sigma: float) -> tuple[np.ndarray, np.ndarray]:
    """Which lines belong to the cluster with the higher smoothed text-to-tag ratio, and which of them would also by their own."""
    n = len(blocks)
    kernel, weight = _kernel(sigma)
    reach = len(kernel) // 2
    ratio = np.array([len(t) / tags for t, tags, _ in blocks])
    norm = np.convolve(np.ones(n), kernel) if n <= 2 * reach else _edges(n, weight, reach)
    smooth = np.log1p((np.convolve(ratio, kernel) / norm)[reach : reach + n])
    low, high = smooth.min(), smooth.max()
    if high - low < 0.7:  # one cluster: less than a factor of two between the lines
        return np.ones(n, bool), np.ones(n, bool)
    upper, before, limit = smooth > (low + high) / 2, 0, (low + high) / 2
    for _ in range(20):
        k = int(np.count_nonzero(upper))
        if k == before:
            break
        total = float(smooth @ upper)
        limit = (total / k + (float(smooth.sum()) - total) / (n - k)) / 2
        upper, before = smooth > limit, k
    return upper, upper & (np.log1p(ratio) > limit)


@functools.cache
def _kernel(sigma: float) -> tuple[np.ndarray, np.ndarray]:
    reach = math.ceil(3 * sigma)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return kernel, np.cumsum(kernel)


def _edges(n: int, weight: np.ndarray, reach: int) -> np.ndarray:
    """What a convolution of ``n`` ones gives: the kernel is cut at both ends."""
    norm = np.full(n + 2 * reach, weight[-1])
    norm[: 2 * reach + 1] = weight
    norm[-2 * reach - 1 :] = weight[::-1]
    return norm


def main_text(html: str | None, sigma: float = 1.0) -> str:
    """The main text of one page; '' for null, for empty pages and for pages without any."""
    if not html:
        return ""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.flush()
    regions = parser.regions
    gone = _mostly_links(parser) if parser.suspects else set()
    blocks = [b for b in parser.blocks if b[2] not in gone] if gone else parser.blocks
    links = [2 * n > len(b[0]) for b, n in zip(parser.blocks, parser.links, strict=True) if b[2] not in gone]
    if not blocks:
        return ""
    content, strong = _content(blocks, sigma)
    chosen = [b[2] for b, yes in zip(blocks, content, strict=True) if yes]
    sure = {b[2] for b, yes, link in zip(blocks, strong, links, strict=True) if yes and not link}
    # Lines that belong to the cluster by their neighbours alone vote in the regions of sure lines and beside them, not in others.
    beside = {regions[r][1] for r in sure} - {0}
    votes = [b[2] for b, yes, link in zip(blocks, content, links, strict=True) if yes and not link and (not sure or b[2] in sure or regions[b[2]][1] in beside)]
    top = _whole(functools.reduce(lambda a, b: _common(a, b, regions), votes or chosen), regions)
    inside: list[bool] = []
    for k, (_, parent) in enumerate(regions):
        inside.append(k == top or k > 0 and inside[parent])
    return "\n".join(text for text, _, region in blocks if inside[region])


def _mostly_links(parser: _Blocks) -> set[int]:
    """The suspect regions whose text is mostly in links, with all regions inside."""
    size, linked = [0] * len(parser.regions), [0] * len(parser.regions)
    for (text, _, region), n in zip(parser.blocks, parser.links, strict=True):
        size[region] += len(text)
        linked[region] += n
    for k in range(len(size) - 1, 0, -1):
        size[parser.regions[k][1]] += size[k]
        linked[parser.regions[k][1]] += linked[k]
    gone = {k for k in parser.suspects if 2 * linked[k] > size[k]}
    for k in range(1, len(size)):
        if parser.regions[k][1] in gone:
            gone.add(k)
    return gone


def _common(a: int, b: int, regions: list[tuple[str, int]]) -> int:
    """The innermost region that holds both; a parent has a smaller number."""
    while a != b:
        if a > b:
            a = regions[a][1]
        else:
            b = regions[b][1]
    return a


def _whole(region: int, regions: list[tuple[str, int]]) -> int:
    """The article or main around ``region``; without one, what holds it if it is only a part of that."""
    at = region
    while at and regions[at][0] not in REGION:
        at = regions[at][1]
    while not at and regions[region][0] in PART and regions[regions[region][1]][0] != "body":
        region = regions[region][1]
    return at or region


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url"), sigma: float = 1.0) -> DataFrame:
    """The ``keep`` columns, text and n_chars (code points), one row for each row of ``pages``.

    Null, empty and broken pages give text ''.  Repeated rows stay.  Columns outside
    ``keep`` are not read, so a column named text or n_chars there does not clash.  Pages
    are parsed one by one in Arrow batches: memory is bounded by the longest page.
    """
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([*(pages.schema[c] for c in keep), StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x.as_py(), sigma) for x in part.column("_html")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [f.name for f in schema])

    return pages.select(*keep, pages[html].alias("_html")).mapInArrow(run, schema)
