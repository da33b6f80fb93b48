"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams start, end and text events.  They become lines: one per block element, with its
text, the number of tags met in it, and whether it lies inside something that is never content (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, styles, comments: by element, role or class name).  A line's ratio is
its text length over its tags.  Ratios are smoothed along the page with a Gaussian and split into two clusters
(one-dimensional 2-means started at the extremes); the cut between the centres is the threshold.  Lines over it mark the
content.  On a page with marked article (or main) elements, or with just one, every line of those elements that is not in
a never-content element belongs to the text, however short, but for blocks of links under the cut.  On any other page the runs of marked lines are the text,
with the short lines of their container or between two runs, and headings right before a run.

Scale: one map over the pages, no shuffle; memory is bounded by the longest page.

Edge cases: NULL or empty html, and pages without text, give an empty text; broken or cut markup is read as far as it
goes; repeated rows and NULL ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediafold.llm.common import map_arrow

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td "
    "tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REGIONS = frozenset(("article", "main", "body"))
NEVER = frozenset(
    "aside button canvas datalist dialog fieldset footer form head iframe label legend menu nav noscript object optgroup "
    "option script select style svg template textarea title audio video".split())
ROLES = frozenset("banner complementary contentinfo dialog alert alertdialog form menu menubar navigation search "
                  "toolbar".split())
# Words of class names and ids that mark boilerplate.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disclaimer disqus footer gdpr menu modal nav navbar navigation newsletter notice notification pagination "
    "popup promo promotion promoted recommended related replies reply respond share sharing sidebar signup social "
    "sponsor sponsored subscribe subscription toolbar widget masthead".split())
# ... unless the same name also speaks of the content ("post-related-text") ...
CONTENT_NAMES = frozenset("article body content entry has main no page post story text with without".split())
# ... which does not clear these ("post-comments"), but for a layout that has or lacks them ("content-with-sidebar").
FIRM_NAMES = frozenset(
    "ad ads advert adverts banner comment comments disqus footer menu nav navbar navigation newsletter promo promoted "
    "replies reply respond share sharing sidebar sponsored widget".split())
# "story-related" is boilerplate, "post-related-text" is not.
RELATED_NAMES = frozenset(("recommended", "related"))
LAYOUT_NAMES = frozenset("has no with without".split())
# Class names that unmake even an article or main element.
REGION_NAMES = frozenset("ad ads advert comment comments promo promoted related replies reply sponsored".split())
_NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_INVISIBLE = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
_CUT_MARKUP = re.compile(r"<[a-zA-Z/!?]")
# Elements that group lines on a page without article or main.
CONTAINERS = frozenset("center div section table td th".split())
# Blocks that go as a whole if they are links and their smoothed ratio lies under the cut, inside articles, too.
GROUPS = CONTAINERS | {"ol", "ul"}
LINK_SHARE = 0.8
# Smoothed ratios (logarithms) of a page less than this apart do not tell boilerplate from text.
ALIKE = math.log(3)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# An open element that these end implicitly.
CLOSES = {"p": BLOCKS, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
          "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr")),
          "th": frozenset(("td", "th", "tr")), "option": frozenset(("option", "optgroup"))}


def never_content(tag: str, attrs: list[tuple[str, str | None]], inside_region: bool) -> bool:
    """True if nothing inside this element is main text."""
    if tag in NEVER or (tag == "header" and not inside_region):
        return True
    if tag in ("html", "body"):
        return False
    names = REGION_NAMES if tag in REGIONS else NAMES
    for name, value in attrs:
        if name == "hidden" and (value or "").strip().lower() != "until-found":
            return True
        if not value:
            continue
        if name == "style" and _INVISIBLE.search(value.lower()):
            return True
        if name == "role" and value.strip().lower() in ROLES:
            return True
        if name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if name in ("class", "id"):
            for token in value.split():
                words = {w.lower() for w in _NAME_WORD.findall(token)}
                firm, related = words & names & FIRM_NAMES, words & names & RELATED_NAMES
                cleared = LAYOUT_NAMES if firm else LAYOUT_NAMES | {"text"} if related else CONTENT_NAMES
                if words & names and not words & cleared:
                    return True
    return False


class Lines(HTMLParser):
    """Collects ``(text, tags, never content, region, container, group, heading, characters in links)`` per block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, bool, int, int, int, bool, int]] = []
        # element, never content, region, container, group, inside a link
        self.stack: list[tuple[str, bool, int, int, int, bool]] = []
        self.containers = self.groups = self.linked = 0
        self.parts: list[str] = []
        self.tags = 0
        self.regions = 0
        self.inner: set[int] = set()  # regions that are articles or main elements
        self.outer: dict[int, int] = {}  # the outermost of them around each

    def _state(self) -> tuple[bool, int, int, int]:
        return self.stack[-1][1:5] if self.stack else (False, 0, 0, 0)

    def _break(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            heading = any(t in HEADINGS for t, *_ in self.stack)
            self.lines.append((text, self.tags, *self._state(), heading, self.linked))
            self.tags = 0
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        while self.stack and tag in CLOSES.get(self.stack[-1][0], ()):
            self._break()
            self.stack.pop()
        if tag in BLOCKS:
            # A block ends an open paragraph even if an inline element is still open in it.
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] == "p":
                    self._break()
                    del self.stack[i:]
                    break
                if self.stack[i][0] in BLOCKS:
                    break
            self._break()
        elif tag == "br":
            self.parts.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        never, region, container, group = self._state()
        skip = never or never_content(tag, attrs, region > 0 and any(t in ("article", "main") for t, *_ in self.stack))
        if skip and not never:
            self._break()
        if tag in REGIONS:
            self.regions += 1
            if tag != "body":
                self.inner.add(self.regions)
                self.outer[self.regions] = self.outer.get(region, self.regions)
            region = self.regions
        if tag in CONTAINERS:
            self.containers += 1
            container = self.containers
        if tag in GROUPS:
            self.groups += 1
            group = self.groups
        if tag == "header" and not skip:
            skip = True  # inside a region only its headings are kept
        elif tag in HEADINGS and skip and self.stack and self.stack[-1][0] == "header" and self._outer_clear():
            skip = False
        self.stack.append((tag, skip, region, container, group, tag == "a" or bool(self.stack and self.stack[-1][5])))

    def _outer_clear(self) -> bool:
        """True if only the innermost header makes this place never content."""
        return len(self.stack) > 1 and not self.stack[-2][1]

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in BLOCKS or self.stack[i][1]:
                    self._break()
                del self.stack[i:]
                return
            if tag not in BLOCKS and self.stack[i][0] in BLOCKS:
                return  # a stray end of an inline element closes no block around it
        if tag in BLOCKS:
            self._break()

    def parse_html_declaration(self, i):
        # As browsers do: "<![endif]-->", "<![CDATA[" and the like are bogus comments that end at the next ">".
        if self.rawdata.startswith("<![", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] in ("script", "style"):
            return
        self.parts.append(data)
        if self.stack and self.stack[-1][5]:
            self.linked += len(data)

    def finish(self) -> list[tuple]:
        if _CUT_MARKUP.match(self.rawdata):  # a tag or comment that the page ends in is not text
            self.rawdata = ""
        self.close()
        self._break()
        return self.lines


def smooth(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; the page's ends are repeated outwards."""
    r = max(1, math.ceil(2 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratios, r, mode="edge"), kernel / kernel.sum(), mode="valid")


def threshold(values: np.ndarray, rounds: int = 50) -> float:
    """Midpoint of two clusters' centres; everything is content if all values are alike."""
    lo, hi = float(values.min()), float(values.max())
    if hi - lo < 1e-9:
        return lo
    for _ in range(rounds):
        upper = values > (lo + hi) / 2
        new = float(values[~upper].mean()), float(values[upper].mean())
        if new == (lo, hi):
            break
        lo, hi = new
    return (lo + hi) / 2


def main_text(html: str | None) -> str:
    """Main text of one page: blocks in page order, one per line."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    lines = [x for x in parser.finish() if not x[2]]
    if not lines:
        return ""
    own = np.log1p([len(text) / max(tags, 1) for text, tags, *_ in lines])
    ratio = smooth(own)
    cut = threshold(ratio)
    over = ratio >= cut
    inner = np.array([region in parser.inner for _, _, _, region, *_ in lines])
    articles = {parser.outer[region] for _, _, _, region, *_ in lines if region in parser.inner}
    if any(over & inner) or len(articles) == 1:  # then stray lines of the body around them are not content
        links = link_blocks(lines, ratio, cut)
        kept = inner & ~links if any(over & inner & ~links) else inner  # an article of links alone stays
    elif ratio.max() - ratio.min() < ALIKE:
        kept = [True] * len(lines)
    else:
        kept = content_runs(lines, over, over & (own >= cut))
    return "\n".join(x[0] for x, k in zip(lines, kept, strict=True) if k)


def link_blocks(lines: list[tuple], ratio: np.ndarray, cut: float) -> np.ndarray:
    """Lines of blocks of two lines or more whose text is links and whose mean smoothed ratio is under the cut."""
    out = np.zeros(len(lines), bool)
    group = np.array([x[5] for x in lines])
    if not any(x[7] for x in lines):
        return out
    size, linked = np.array([len(x[0]) for x in lines]), np.array([x[7] for x in lines])
    for g in np.unique(group[group > 0]):
        own = group == g
        if own.sum() > 1 and linked[own].sum() >= LINK_SHARE * size[own].sum() and ratio[own].mean() < cut:
            out |= own
    return out


def content_runs(lines: list[tuple], over: np.ndarray, sure: np.ndarray, gap: int = 4) -> np.ndarray:
    """Lines to keep of a page without articles: runs over the cut, with what belongs to them however short.

    That is every line of a container that holds a line over the cut by itself (of lines in no container, the two on
    either side of it), up to ``gap`` lines between two runs, and headings right before a run.
    """
    container = np.array([x[4] for x in lines])
    kept = over | (np.isin(container, container[sure]) & (container > 0))
    for i in np.flatnonzero(sure & (container == 0)):
        kept[max(i - 2, 0):i + 3] |= container[max(i - 2, 0):i + 3] == 0
    at = np.flatnonzero(kept)
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a <= gap + 1:
            kept[a:b] = True
    for i in range(len(lines) - 2, -1, -1):
        if kept[i + 1] and lines[i][6]:
            kept[i] = True
    return kept


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    def run(batches):
        for batch in batches:
            text = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return map_arrow(rows, run, "page_id long, url string, text string, n_chars long")
