"""Main text of web pages: standard-library parser events, text-to-tag ratio of each line, Gaussian smoothing, clustering.

The parser's events stream into lines, a line being the text between two block boundaries, with the tags seen since the line
before and the region that it stands in (the nearest div, section, article, nav or the like, or the nearest element whose
name tells what it is). A line's ratio is its characters a tag. Tags and names only weigh it: in an article or main region it
counts more, in what is or is named a menu, header, footer, sidebar, notice, advert, form or comment far less, and text that
stands in a region itself, in no paragraph, heading, item or cell, less.

The ratios in page order are smoothed with a Gaussian and cut at their standard deviation, or at a share of the largest; the same is done with ratios capped,
so that a very long line doesn't raise the cut over all others. A line is content where its smoothed ratio and its own reach
a cut: an isolated line in menus is drawn down by them. A region that holds a content line is kept, whatever its
size beside others, with its short lines; of its lines that are links and nothing else, those stay that smoothing with their
neighbours lifts over a cut.

Defined results: a null or empty page, and one without any text, gives an empty text. Broken markup never fails and takes time
in proportion to its length: unclosed elements end with the one around them. Repeated rows each give a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
REGION = frozenset("article main section div body".split())
#: What these hold is no text of the page.
DROPPED = frozenset("head title script style noscript template button select textarea iframe object svg canvas dialog audio video map".split())
#: What these hold is text, but likely none of the article.
ASIDE = frozenset("nav header footer aside form menu".split())
#: Weights of ratios: in an article or main region, in what is or is named an aside, in no element of text.
LANDMARK, APART, BARE = 2.0, 0.01, 0.05
#: A paragraph ends where one of these begins.
ENDS_P = BLOCK - {"body", "html", "title", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "legend", "summary"}
#: Names in class, id or role, as whole words, of what isn't content.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|cookie|cookies|consent|gdpr|notice|alert|warning|popup|modal|overlay|newsletter|subscribe|signup|login|"
    r"menu|nav|navbar|navigation|breadcrumb|breadcrumbs|pagination|pager|sidebar|side|aside|complementary|contentinfo|header|masthead|topbar|footer|foot|toolbar|search|share|sharing|social|related|recommended|"
    r"comment|comments|commentlist|disqus|replies|reply|respond|discussion|form|widget|tags|meta|byline-share|skip)(?:$|[\s_-])",
    re.IGNORECASE,
).search
#: Of these, what an article or main element can be named that is none of the page's content.
ASIDES = re.compile(r"(?:^|[\s_-])(?:comment|comments|commentlist|reply|replies|respond|related|recommended|promo|sponsored|advert|ad|ads|widget)(?:$|[\s_-])", re.IGNORECASE).search


@dataclass(frozen=True)
class Line:
    text: str
    tags: int
    region: int
    weight: float
    plain: bool  # some of it is no link


class Lines(HTMLParser):
    """Collects the lines of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, float, bool, bool]] = []  # tag, region, weight, dropped, in a link
        self.places: dict[str, list[int]] = {}  # of the open elements of each tag
        self.blocks: list[int] = []  # of the open block elements
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.tags, self.regions, self.plain = 0, 0, False

    def now(self) -> tuple[str, int, float, bool, bool]:
        return self.open[-1] if self.open else ("", 0, 1.0, False, False)

    def end_line(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                _, region, weight, _, _ = self.now()
                bare = not self.blocks or self.open[self.blocks[-1]][0] in REGION
                self.lines.append(Line(text, max(1, self.tags), region, weight * (BARE if bare else 1.0), self.plain))
                self.tags, self.plain = 0, False

    def pop_to(self, at: int) -> None:
        if self.blocks and self.blocks[-1] >= at:
            self.end_line()
        for tag, *_ in self.open[at:]:
            self.places[tag].pop()
        while self.blocks and self.blocks[-1] >= at:
            self.blocks.pop()
        del self.open[at:]

    def last(self, tag: str) -> int:
        """The place of the innermost open element of that tag, or -1."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in VOID:
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self.end_line()
            return
        if tag in ENDS_P and (at := self.last("p")) >= 0 and at >= (self.blocks[-1] if self.blocks else 0):
            self.pop_to(at)
        if tag in BLOCK:
            self.end_line()
        _, region, weight, dropped, linked = self.now()
        if tag == "body":
            dropped = False  # a head that was never closed ends here
        landmark, aside = tag in ("article", "main"), tag not in ("html", "body") and (tag in ASIDE or self.named_aside(tag, attrs))
        if tag in REGION or aside:
            self.regions += 1
            region = self.regions
        if aside:
            weight = APART
        elif landmark and weight == 1.0:
            weight = LANDMARK
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCK:
            self.blocks.append(len(self.open))
        self.open.append((tag, region, weight, dropped or tag in DROPPED, linked or tag == "a"))

    def named_aside(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        tells = ASIDES if tag in ("article", "main") else NAMES
        return any(v and tells(v) for k, v in attrs if k in ("class", "id", "role"))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # only void elements close themselves in HTML

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        at = self.last(tag)
        # an inline end tag doesn't close blocks
        if at >= 0 and (tag in BLOCK or not self.blocks or self.blocks[-1] < at):
            self.pop_to(at)

    def handle_data(self, data: str) -> None:
        _, _, _, dropped, linked = self.now()
        if not dropped:
            self.parts.append(data)
            self.plain = self.plain or not (linked or data.isspace())


def smooth(ratio: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    reach = max(1, round(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def lines_of(html: str) -> list[Line]:
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    return parser.lines


def main_text(html: str, *, sigma: float = 1.0, cap: float = 20.0, share: float = 0.35) -> str:
    """The text of a page. cap: characters a tag from which a line is text, however many more others have. share: of the largest
    smoothed ratio, where the cut lies at least."""
    lines = lines_of(html)
    if not lines:
        return ""
    ratio = np.array([len(x.text) / x.tags for x in lines])
    weight = np.array([x.weight for x in lines])
    content, lifted = np.zeros(len(lines), bool), np.zeros(len(lines), bool)
    for own in (ratio * weight, np.minimum(ratio, cap) * weight):
        smoothed = smooth(own, sigma)
        cut = max(min(smoothed.std(), smoothed.max()), share * smoothed.max())
        lifted |= smoothed >= cut
        content |= (smoothed >= cut) & (own >= cut)
        if not content.any():
            content[smoothed.argmax()] = True
    good = {x.region for x, c in zip(lines, content, strict=True) if c}
    return "\n".join(x.text for x, up in zip(lines, lifted.tolist(), strict=True) if x.region in good and (up or x.plain))


def extract(df: DataFrame, *, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, text and n_chars (code points of the text) of each page. No shuffle."""
    source = df.select(*keep, F.coalesce(F.col(html), F.lit("")).alias("\0html"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                part = whole.slice(at, 500)
                texts = [main_text(x) for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[f.name for f in schema])

    return source.mapInArrow(run, schema)
