"""Main-text extraction by line-block distribution.

Markup is stripped to lines, one for each block of the page. Blocks inside
navigation, headers, footers, sidebars, notices, adverts, forms, comments, scripts
and styles count no text, nor does link text. The text lengths of a sliding window of lines make the
distribution: a surge is where it leaves zero, a dive where it falls back. The
lines between a surge and its dive are the article if the page marks them as such
(``article`` or ``main``) or the window reaches ``peak`` characters in between, or four fifths of the
page's own greatest sum where that is less.

Defined results: a null page is an empty one and gives an empty text; character
references are decoded once; white space inside a block becomes one space; blocks
join with one newline; broken or missing end tags end with the enclosing block. Repeated rows give
a row each, an empty table gives an empty result, other input columns pass through.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3
PEAK = 86

#: Comments, elements whose content is no text, and tags.
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^>]*>"
    r"""|<(?:svg|math)\b(?:[^<>"']|"[^"]*"|'[^']*')*/>"""
    r"|<(script|style|noscript|template|svg|math|iframe|object|canvas|select|textarea|title|head(?=[\s>]))\b.*?(?:</\1\s*>|\Z)"
    r"""|<(/?)([a-zA-Z][\w:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*)>""",
    re.S | re.I,
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILERPLATE = frozenset("nav header footer aside form menu button dialog".split())
#: Words in a class, id or role that mark boilerplate.
NAMES = frozenset(
    "ad ads advert adverts advertisement banner breadcrumb breadcrumbs byline comment comments complementary contentinfo cookie cookies consent copyright disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion related replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget".split()
)
#: Names that tell what a block has beside it, or what is done with an article, mark none.
BESIDE, DONE_WITH, ARTICLES = frozenset("has with without no".split()), frozenset("search share social tags".split()), frozenset("article entry post story".split())
#: Words that stand beside those of ``NAMES`` without telling of anything else; so do vendors' short prefixes and numbers.
AFFIXES = frozenset(
    "area bar block bottom box button buttons col column container content desktop dropdown element fixed float form global group holder icon icons id inner item items left link links list main message mobile module outer page panel post posts primary region right row secondary section site slot sticky text toggle top unit wrap wrapper".split()
)
NAME_PARTS = re.compile(r"[^\s\"']+")
NAMED = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PARTS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


def is_boilerplate(tag: str, attributes: str) -> bool:
    if tag in BOILERPLATE:
        return True
    if tag in ("html", "body", "main", "article") or not attributes:
        return False
    return any(names_boilerplate(name) for value in NAMED.findall(attributes) for name in NAME_PARTS.findall(value))


def names_boilerplate(name: str) -> bool:
    """Does a name mark boilerplate, whole or with affixes, as ``page-footer`` does, but not ``has-sidebar``, ``share-story`` or ``related-work``?"""
    parts = [p.lower() for p in PARTS.findall(name)]
    if not parts or parts[0] in BESIDE or parts[0] in DONE_WITH and parts[-1] in ARTICLES:
        return False
    marks = [p in NAMES for p in parts]
    return any(marks) and all(mark or p in AFFIXES or i == 0 and len(p) <= 3 for i, (p, mark) in enumerate(zip(parts, marks, strict=True)))


def lines_of(page: str) -> Iterator[tuple[str, bool, bool, int]]:
    """Each block's ``(text, counts, marked as article, characters of link text)`` in page order."""
    open_tags: list[str] = []
    skip_from = 0  # open tags when boilerplate began, plus one
    article = links = linked = 0
    parts: list[str] = []

    def flush() -> Iterator[tuple[str, bool, bool, int]]:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if text:
            yield text, not skip_from, article > 0, linked
        linked = 0

    at = 0
    for m in MARKUP.finditer(page):
        piece = page[at : m.start()]
        at = m.end()
        parts.append(piece)
        if links:
            linked += len(piece)
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag in BLOCKS or tag == "br":
            if tag == "br":
                parts.append(" ")
            else:
                yield from flush()
        if m[2]:
            if tag in open_tags:
                while True:
                    closed = open_tags.pop()
                    article -= closed in ("article", "main")
                    links -= closed == "a"
                    if len(open_tags) < skip_from:
                        skip_from = 0
                    if closed == tag:
                        break
        elif tag not in VOID:
            if tag == "p" and open_tags[-1:] == ["p"]:
                open_tags.pop()
                if len(open_tags) < skip_from:
                    skip_from = 0
            open_tags.append(tag)
            article += tag in ("article", "main")
            links += tag == "a"
            if not skip_from and is_boilerplate(tag, m[4]):
                skip_from = len(open_tags)
    rest = page[at:]
    parts.append(rest if "<" not in rest else rest[: rest.index("<")])  # a tag cut off by the page's end is no text
    yield from flush()


def main_text(page: str | None, window: int = WINDOW, peak: int = PEAK) -> str:
    """The article of one page."""
    lines = list(lines_of(page or ""))
    if not lines:
        return ""
    counted = np.array([counts for _, counts, _, _ in lines])
    weight = np.array([max(0, len(text) - linked) if counts else 0 for text, counts, _, linked in lines])
    marked = np.array([counts and article for _, counts, article, _ in lines])
    if marked.any():
        weight = np.where(marked, np.maximum(weight, 1), 0)
    else:
        peak = min(peak, int(0.8 * np.convolve(weight, np.ones(window, np.int64)).max()))  # a page of short lines has its own scale
    spread = np.convolve(weight, np.ones(window, np.int64))[: len(lines)]  # the window ends at the line
    flat = np.concatenate([[True], spread == 0, [True]])
    surges, dives = np.flatnonzero(flat[:-1] & ~flat[1:]), np.flatnonzero(~flat[:-1] & flat[1:])
    kept: list[int] = []
    for a, b in zip(surges, dives, strict=True):
        if marked[a:b].any() or spread[a:b].max() >= peak:
            held = a + np.flatnonzero(weight[a:b])
            kept += [i for i in range(held[0], held[-1] + 1) if weight[i] or counted[i] and not marked.any()]  # a line that is all link stays between others
    return "\n".join(lines[i][0] for i in kept)


def extract(pages: DataFrame, window: int = WINDOW, peak: int = PEAK) -> DataFrame:
    """``pages(html, ...)`` with ``text`` and ``n_chars`` (code points) in place of ``html``."""

    @F.pandas_udf("string")
    def text_of(page: pd.Series) -> pd.Series:
        return page.map(lambda p: main_text(p, window, peak))

    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    return pages.select(*kept, text_of(F.col("html").cast("string")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
