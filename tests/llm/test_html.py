import html
import re

import pytest

from trawl.llm.html import extract, main_text


def plain(page):
    """What this table's pages hold: an article of a heading and paragraphs."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = re.split(r"</?(?:h1|p)>", inside)
    return "\n".join(t for b in blocks if (t := " ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split())))


def test_equals_plain_reading_of_the_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r.page_id: r for r in extract(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(plain(r.html)) and got[r.page_id].url == r.url


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""),
        ("", ""),
        ("<p>", ""),
        ("<html><body><nav>a menu</nav></body></html>", ""),
        ("<main><p>One &amp;amp; &eacute;<p>two\n\t three<div class='ad-box'>buy</div></main>", "One &amp; é\ntwo three"),
        ("<article><h1>T</h1><form>f</form><p>a<b>b</b>c<script>x<p></script></p><div id='comments'><p>me</p></div></article><p>after</p>", "T\nabc"),
        ("<div class=sidebar>" + "s " * 90 + "</div><div>" + "long text " * 20 + "</div><div>short</div><div class='x'><a href=/>link</a></div>", ("long text " * 20).strip() + "\nshort"),
        ("<article><p>cut off <em>he", "cut off he"),
        ("<article>a<!-- <p>no</p> -->b&#8212;c &lt;p&gt;</article>", "ab—c <p>"),
        ("<article><p>broken <a href=\"x\">tag</p><p>next", "broken tag\nnext"),
        ("<article><p>a</p><svg/><p>b</p><math display='block'/><p>c</p><svg><text>no</text></svg></article>", "a\nb\nc"),
        ("<div class='content has-sidebar'>" + "<p>a body of some length, in plain words</p>" * 4 + "<div class='page-footer-links'>no</div></div>", "\n".join(["a body of some length, in plain words"] * 4)),
        ("<div class='share-story'><p>" + "w " * 60 + "</p></div><div class='related-post'>no</div>", ("w " * 60).strip()),
        ("<p>A short page.</p><p><a href=x>all of it link</a></p><p>Its end.</p>", "A short page.\nall of it link\nIts end."),
        ("<article><p class='byline'>me<p>one<p>two</article>", "one\ntwo"),
        ("<article><p>" + "x " * 300_000 + "</p></article>", ("x " * 300_000).strip()),
        ("<article><section id='related-work'><p>a</p></section><section id=binary-search>b</section><div class='social-history'>c</div><p class='tags-explained'>d</p><div class='sharing-economy'>e</div></article>", "a\nb\nc\nd\ne"),
        ("<article><p>a</p><div class='td-ad-slot-2'>no</div><div id=relatedPosts>no</div><div class='social-share buttons'>no</div><div class='newsletter_signup_box'>no</div><p>b</p></article>", "a\nb"),
        ('<article><p>a</p><svg viewBox="0 0 > 1"/><p>b</p></article>', "a\nb"),
        ("<article><p>a< b and c</p><p>end <sp", "a< b and c\nend"),
    ],
)
def test_cases(page, text):
    assert main_text(page) == text


def test_empty_and_clashing_columns(spark):
    frame = spark.createDataFrame([], "page_id long, url string, html string, text string, n_chars int")
    assert extract(frame).columns == ["page_id", "url", "text", "n_chars"] and extract(frame).collect() == []
