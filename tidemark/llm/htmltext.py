"""Main text of web pages from streamed parser events.

The standard library's parser feeds start, end and data events. They build lines, one for each block of text; a line's ratio
is its code points over its tags (at least 1). Ratios are smoothed by a Gaussian over neighbouring lines, and lines
at or above a threshold (the standard deviation of the smoothed ratios, at most their mean) are the dense cluster. The regions
are the article and main elements that hold lines of the cluster; of a page without one, the dense
lines with those that lie between them. Elements that are menu, header, footer, sidebar, form, script or style by name, and classes
that name adverts, consent or reader comments, are never content, nor do they count for the threshold. Classes that only may mark
such parts (header, sidebar, search and the like) are a prior: they cut a line's ratio to ``PRIOR`` of it, so that such a line
is content only where its own density is high.

Cases: null and empty pages, and pages without content, give an empty text. Unclosed and misnested tags are taken as
browsers do in the main: a new block ends an open paragraph, an end tag closes what it encloses, a stray one is ignored.
Pages of any length are read whole. Repeated rows get equal results, one row each; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import prepare

#: Standard deviation of the smoothing, in lines.
SIGMA = 1.5
#: What is left of the ratio of lines in an element whose class may mark what isn't content.
PRIOR = 0.1
#: Names of HTML elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
NEVER = frozenset("aside audio button canvas dialog embed fieldset footer form head iframe input map menu nav noscript object script search select style svg template textarea title video".split())
REGIONS = frozenset(("article", "main"))
#: Words in class, id or role that name what isn't content.
_MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|breadcrumbs?|comments?|commentlist|complementary|consent|contentinfo|cookies?|disqus|gdpr|login|masthead|nav|navbar|navigation|newsletter|pager|pagination|popup|promo\w*|recommend\w*|related|replies|respond|signup|skip|social|sponsor\w*|subscribe)(?:$|[\s_-])"
)
#: Words that may name it: they lower the ratio, and count for nothing in a name that tells of content too (article-header, with-sidebar).
_MAYBE = re.compile(r"(?:^|[_-])(?:banner|disclaimer|dropdown|footer|header|menu|modal|notices?|notification|overlay|reply|reviews?|search|share|sharing|sidebar|toolbar|topbar|widget)(?:$|[_-])")
_TELLS = re.compile(r"(?:^|[_-])(?:article|body|content|entry|has|main|no|page|post|story|text|with|without)(?:$|[_-])")
_OPEN_ENDED = frozenset(("p", "li", "dt", "dd", "option", "tr", "td", "th"))


class _Lines(HTMLParser):
    """Lines of a page: text, tags, the region element (a number, or -1) that they lie in, and the prior; marked ones are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool, int, float]] = []  # element, whether its text is out, region, prior
        self.lines: list[tuple[str, int, int, float]] = []
        self.parts: list[str] = []
        self.tags = 0
        self.regions = 0

    def _state(self) -> tuple[bool, int, float]:
        return self.stack[-1][1:] if self.stack else (False, -1, 1.0)

    def flush(self) -> None:
        if self.parts:
            if text := " ".join("".join(self.parts).split()):
                self.lines.append((text, self.tags, *self._state()[1:]))
            self.parts = []
        self.tags = 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
            if tag != "br":
                self._end_open(tag)
        self.tags += 1
        if tag in VOID:
            return
        out, region, prior = self._state()
        if not out:
            out = tag in NEVER or tag == "header" and region < 0
            for name, value in attrs:
                if name in ("class", "id", "role") and value and tag not in ("html", "body"):
                    out = out or bool(_MARKED.search(value.lower()))
                    if any(_MAYBE.search(x) and not _TELLS.search(x) for x in value.lower().split()):
                        prior = PRIOR
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and value and re.search(r"display\s*:\s*none", value.lower()):
                    out = True
            if tag in REGIONS and not out and region < 0:
                region, self.regions = self.regions, self.regions + 1
        self.stack.append((tag, out, region, prior))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _end_open(self, tag: str) -> None:
        """A block ends an open paragraph; an item, cell or row ends the one before it."""
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == "p" or name == tag and tag in _OPEN_ENDED:
                del self.stack[k:]
                return
            if name in BLOCKS or name in NEVER:
                return

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        for k in range(len(self.stack) - 1, -1, -1):
            name = self.stack[k][0]
            if name == tag:
                del self.stack[k:]
                return
            if tag not in BLOCKS and name in BLOCKS:
                return  # an inline end tag doesn't reach out of its block

    def handle_data(self, data):
        if not (self.stack and self.stack[-1][1]):
            self.parts.append(data)


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing over lines; at the ends the weights that fall outside are left out."""
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    full = np.convolve(ratios, kernel)[reach : reach + len(ratios)]
    return full / np.convolve(np.ones(len(ratios)), kernel)[reach : reach + len(ratios)]


def main_text(html: str | None) -> str:
    """The page's content, blocks joined by one space."""
    parser = _Lines()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    lines = parser.lines
    if not lines:
        return ""
    sizes, tags, region, prior = (np.array(x, float) for x in zip(*((len(t), n, r, p) for t, n, r, p in lines)))
    own = prior * sizes / np.maximum(1, tags)
    ratio = smoothed(own)
    limit = min(ratio.std(), ratio.mean())
    # a line under a prior is judged by its own density: that of its neighbours says nothing of it
    dense = np.where(prior < 1, own, ratio) >= limit
    if not dense.any():
        dense = own == own.max()
    held = np.unique(region[dense & (region >= 0)])
    if len(held):
        pick = np.isin(region, held)
    else:
        at = np.flatnonzero(dense)
        pick = (np.arange(len(lines)) >= at[0]) & (np.arange(len(lines)) <= at[-1])
    return " ".join(lines[k][0] for k in np.flatnonzero(pick & ((prior == 1) | dense)))


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """The columns named in keep with text and n_chars."""
    prepare(pages.sparkSession)
    out, k = pages.select(*[F.col(c) for c in keep], F.col(html).alias("__html")), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x.as_py()) for x in b.column(k)]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*keep, "text", "n_chars"])

    return out.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema[:-1]), "text string, n_chars bigint"]))
