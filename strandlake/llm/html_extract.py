"""Main text of web pages from streaming parser events.

The standard library's parser streams events; text is gathered in lines, one for each block. Every
line has a text-to-tag ratio (characters for each tag met since the line before, counted over the
whole page), which counts no further than FULL, so that one very long paragraph does not outweigh the
others, and is smoothed by a Gaussian kernel; two-means clustering of the smoothed ratios gives the
threshold of content lines. Lines inside menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and comments never count; a class or id marks them only by its whole
name (`sidebar`, `cookie-banner`, but not `has-sidebar`), and never on the page, its body or its main
part. What is dropped inside a line (a button, a drawing) does not part it. If the page marks an article or a main
part, its lines are the region when at least one of them is content or no line is; otherwise the
region reaches from the first to the last line that is content or in the marked part, and over the
lines next to these, up to where two lines in a row are mostly link text. All remaining lines of the region are kept: short paragraphs
between long ones, titles and closing lines belong to the text.

Each page is parsed alone, so nothing is shuffled. Defined results: null and empty pages and pages
without text give an empty string; a tag that the end of the page cuts off is dropped.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strandlake.llm.common import annotate

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav header footer aside form dialog menu head title fieldset".split())
#: Elements whose text is no text; they stand inside a line.
MUTED = frozenset("script style noscript template svg iframe button select textarea option label datalist".split())
BLOCKS = frozenset("address article blockquote body caption center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hr html legend li main ol p pre section summary table tbody td tfoot th thead tr ul".split()) | DROPPED
#: Elements that a new one of the same kind closes.
SELF_CLOSING = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Words of a class, id or role that mark what is not the article.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline captcha comment comments commentlist consent contentinfo cookie cookies disclaimer disqus dialog feedback footer gdpr header hidden infobox masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promotion recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar widget".split())
#: Words that may stand beside a mark in one name.
BESIDE = frozenset("area bar block bottom box button buttons container content cta form global group icons inner item items left link links list main message outer page policy posts primary right section secondary site slot top unit wrap wrapper".split())
#: Elements that are the page or its main part, whatever their class.
WHOLE = frozenset("html body main".split())
ATTRIBUTES = frozenset(("class", "id", "role", "aria-label"))
_SPLIT = re.compile(r"[^a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_SPACE = re.compile(r"\s+")
_CUT_TAG = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")

#: Lines to each side that smoothing looks at.
RADIUS, SIGMA = 2, 1.0
#: Characters for each tag beyond which a line is no more likely to be content.
FULL = 40.0


class Lines(HTMLParser):
    """Lines of a page: text, tags since the line before, whether it may be content, whether in an article, whether mostly link text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, bool, bool]] = []
        self.held: list[str] = []
        self.tags = 0
        self.stack: list[tuple[str, bool, bool, bool, bool]] = []  # (tag, drops its text, is the article, is a link, mutes)
        self.drop = self.article = self.links = self.linked = self.muted = 0

    def end_line(self):
        if self.held:
            text = _SPACE.sub(" ", "".join(self.held)).strip()
            if text:
                self.lines.append((text, self.tags, not self.drop, self.article > 0, 2 * self.linked > len(text)))
                self.tags = 0
            self.held, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if self.muted and tag in ("article", "main") and not self.article:
            self.pop_to(next(i for i, x in enumerate(self.stack) if x[4]))  # what should have ended before the article
        if self.muted:  # all that it holds is muted, too
            self.tags += 1
            if tag not in VOID:
                self.push(tag, False, False, False, True)
            return
        if tag in BLOCKS:
            self.end_line()
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in SELF_CLOSING.get(tag, ()):
                    self.pop_to(i)
                    break
                if self.stack[i][0] in BLOCKS:
                    break
        elif tag == "br":
            self.held.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        # An article in an article may be a reader's comment.
        drops = tag in DROPPED or (tag not in WHOLE and tag not in MUTED and (tag != "article" or self.article > 0) and marked(attrs))
        article = tag in ("article", "main")
        if article and not drops and self.drop and not any(x[0] in ("form", "section", "ol", "ul") for x in self.stack):
            self.pop_to(next(i for i, x in enumerate(self.stack) if x[1]))  # what should have ended before the article
        self.push(tag, drops, article, tag == "a" and any(name == "href" for name, _ in attrs), tag in MUTED)

    def push(self, tag, drops, article, link, mutes):
        if drops and not self.drop and tag in BLOCKS:
            self.end_line()
        elif drops:
            mutes = mutes or not self.drop
            drops = False
        self.stack.append((tag, drops, article, link, mutes))
        self.drop += drops
        self.article += article
        self.links += link
        self.muted += mutes

    def pop_to(self, i):
        for _, drops, article, link, mutes in self.stack[i:]:
            self.drop -= drops
            self.article -= article
            self.links -= link
            self.muted -= mutes
        del self.stack[i:]

    def handle_endtag(self, tag):
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if not self.stack[i][4] and (tag in BLOCKS or any(x[1] for x in self.stack[i:])):
                    self.end_line()
                self.pop_to(i)
                return
        if tag == "p":
            self.end_line()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_data(self, data):
        if self.muted:
            return
        self.held.append(data)
        if self.links:
            self.linked += len(data.strip())


def marked(attrs) -> bool:
    for name, value in attrs:
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and value and "display:none" in value.replace(" ", "").lower()):
            return True
        if name in ATTRIBUTES and value and any(map(is_mark, value.split() if name != "aria-label" else [value])):
            return True
    return False


def is_mark(name: str) -> bool:
    """Whether a class name is a mark, or marks and words that may stand beside them."""
    parts = [x for x in _SPLIT.split(_CAMEL.sub("-", name).lower()) if x]
    return not MARKS.isdisjoint(parts) and all(x in MARKS or x in BESIDE for x in parts)


def smoothed(ratios: np.ndarray, radius: int = RADIUS, sigma: float = SIGMA) -> np.ndarray:
    """Means weighted by a Gaussian kernel, which is cut off and weighted anew at both ends."""
    kernel = np.array([math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)])
    return np.convolve(ratios, kernel)[radius : radius + len(ratios)] / np.convolve(np.ones(len(ratios)), kernel)[radius : radius + len(ratios)]


def threshold(values: np.ndarray, rounds: int = 20) -> float:
    """Half-way between the centres of two clusters; 0 where all values are alike."""
    low, high = float(values.min()), float(values.max())
    if high <= 2 * low:
        return 0.0
    for _ in range(rounds):
        cut = (low + high) / 2
        upper, lower = values[values > cut], values[values <= cut]
        if not len(upper) or not len(lower) or (low, high) == (lower.mean(), upper.mean()):
            break
        low, high = float(lower.mean()), float(upper.mean())
    return (low + high) / 2


def grown(allowed: list[int], core: list[int], linked: list[bool]) -> list[int]:
    """The allowed lines from the first to the last of the core, and those to both sides up to two link lines in a row."""
    ends = []
    for at, step in ((allowed.index(core[0]), -1), (allowed.index(core[-1]), 1)):
        i = at + step
        while 0 <= i < len(allowed):
            if not linked[allowed[i]]:
                at = i
            elif abs(i - at) > 1:
                break
            i += step
        ends.append(at)
    return allowed[ends[0] : ends[1] + 1]


def extract(html: str) -> str:
    parser = Lines()
    parser.feed(_CUT_TAG.sub("", html))
    parser.close()
    parser.end_line()
    lines = parser.lines
    allowed = [i for i, x in enumerate(lines) if x[2]]
    if not allowed:
        return ""
    values = smoothed(np.array([min(FULL, len(x[0]) / max(1, x[1])) for x in lines]))
    cut = threshold(values[allowed])
    content = [i for i in allowed if values[i] > cut]
    region = [i for i in allowed if lines[i][3]]
    if not region or (content and not any(lines[i][3] for i in content)):
        region = grown(allowed, sorted({*content, *region}), [x[4] for x in lines]) if content else allowed
    return "\n\n".join(lines[i][0] for i in region)


EXTRACTED = StructType([StructField("text", StringType()), StructField("n_chars", LongType())])


def extract_column(column: pa.Array):
    texts = [extract(x) if x else "" for x in column.to_pylist()]
    return [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())]


def extract_text(pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """(the columns `keep` of pages, by default all, with a struct column of EXTRACTED, its name)."""
    return annotate(pages, html_col, EXTRACTED, extract_column, pages.columns if keep is None else keep, "extracted")


#: For pages whose article holds only headings, paragraphs, bold text, line breaks and &amp;, as those of the table do.
ORACLE_SQL = r"""
WITH a AS (SELECT page_id, url, string_split_regex(regexp_extract(html, '(?s)<article>(.*)</article>', 1), '</?(p|h1)>') AS blocks FROM pages),
b AS (SELECT page_id, url, list_filter(list_transform(blocks, lambda x: trim(regexp_replace(replace(replace(replace(replace(
  regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM a)
SELECT page_id, url, array_to_string(blocks, chr(10) || chr(10)) AS text, length(array_to_string(blocks, chr(10) || chr(10)))::BIGINT AS n_chars FROM b
"""
