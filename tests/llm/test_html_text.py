from __future__ import annotations

import os
import re
from html import unescape

import pytest

from clausemill.llm.html_text import blocks, hashed, host, page_texts, parse
from clausemill.llm.queries import QUERIES

PAGES = "page_id long, url string, html string, text string, key int, Template int"
FOLDER = "/root/testdata/sf0.01"


def text(source, template=frozenset()):
    root = parse(source)
    hashed(root)
    return "\n".join(blocks(root, template))


FULL = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{x}</style></head><body class="home page-with-sidebar">
<header><h1>Site</h1></header><nav><ul><li>Menu<li>More</ul></nav><div id="cookie-notice">We use cookies</div>
<div class="layout"><main><article class="post"><h2>The  title</h2><!-- no <p>comment</p> --><p>One &lt;b&gt; <b>bold</b>
 and&nbsp;<i>it</i>alic &#233; &#x1F600; &unknown; AT&T<p>Two<br>lines<div class="adBox">Buy</div><ul><li>first<li>second <em>em</em></ul>
<table><tr><td>a<td>b<tr><td>c</table><script>var a = "</p><p>no";</script><form><input value="x">Send</form><blockquote>Quote</blockquote>
<aside>By the way</aside><div class="shareButtons">Share</div></article><section class="comments"><article class="comment"><p>Nice!</p>
</article></section></main><div class="sidebar">Side</div></div><footer>&copy; Foot</footer><div role="navigation">Up</div></body></html>"""


def test_article_without_all_that_is_around_it():
    assert text(FULL).split("\n") == [
        "The title", "One <b> bold and\xa0italic é 😀 &unknown; AT&T", "Two lines", "first", "second em", "a", "b", "c", "Quote",
    ]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""), ("", ""), ("just text", "just text"), ("<p>a<p>b", "a\nb"), ("<article>cut off <b>he", "cut off he"),
        ("<article>cut <p cla", "cut"), ("<article>a &am", "a &am"), ("<article>a <!-- never closed", "a"), ("<nav>x</nav>", ""),
        ("<article><script>never closed <p>x", ""), ("a < b and c > d", "a < b and c > d"), ("<p><b>x<br><p>y</b>z", "x\nyz"),
        ("<div>one<div>two</div>three</div>", "one\ntwo\nthree"), ("<p>a</div>b</p>", "ab"), ("<html><body><p>a</body></html>\n", "a"),
        ("<main><p>m</p></main><p>not</p>", "m"), ("<p title='a > b'>t</p>", "t"), ("<p>x</p ><P>Y</P>", "x\nY"), ("</p></x><", "<"),
        ("<article><p>one</p></article><article><p>two</p></article>", "one\ntwo"), ("<p hidden>x</p>y", "y"), ("<a<b>z", "z"),
        ("<div class='commentary-free uploads'>kept</div>", "kept"), ("<div class='post-comments'>gone</div>", ""),
    ],
)
def test_odd_pages(source, want):
    assert text(source) == want


def test_very_long_and_deep_pages():
    assert text("<article>" + "<p>word &amp; word</p>" * 50_000).count("\n") == 49_999
    assert text("<div>" * 20_000 + "deep") == "deep"


def page(i, body, site="www.a.example", top="article"):
    return (i, f"https://{site}:80/p/{i}", f"<body>{body}<{top}><p>Text {i}</p><p>Same words in every article.</p></{top}></body>", "x", 1, 2)


def test_what_a_site_repeats_is_removed(spark):
    rows = [page(i, "<div>Known <b>everywhere</b></div>", top="div") for i in range(12)]
    rows += [page(100 + i, "<div>Known <b>everywhere</b></div>", "other.example", top="div") for i in range(3)]
    rows += [page(200 + i, "<div>Known <b>everywhere</b></div>", "art.example") for i in range(12)]
    rows += [(None, None, None, "x", 1, 2), (300, "", "", "x", 1, 2), (0, rows[0][1], rows[0][2], "x", 1, 2), (301, "no address", "<p>x</p>", "x", 1, 2)]
    pages = spark.createDataFrame(rows, PAGES).repartition(5)
    got = page_texts(pages).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    texts = {r.page_id: r.text for r in got}
    assert texts[3] == "Text 3"  # no article marks the site's text, so what recurs goes
    assert texts[101] == "Known everywhere\nText 101\nSame words in every article."  # seen on too few pages
    assert texts[205] == "Text 205\nSame words in every article."  # an article's own text stays
    assert (texts[None], texts[300], texts[301]) == ("", "", "x")


def test_hosts(spark):
    urls = ["HTTPS://User@Www.A.example:8080/x?y//z", "//b.example", "c.example/x", None, "", "http://[bad", "ftp://d.example#e"]
    frame = spark.createDataFrame([(u,) for u in urls], "u string").select(host("u").alias("h"))
    assert [r.h for r in frame.collect()] == ["www.a.example", "b.example", "", "", "", "[bad", "d.example"]


@pytest.mark.parametrize("html, want", [(None, ""), ("", ""), ("plain", "plain"), ("<article><p>One</p><p>two</p></article>", "One\ntwo"), ("<!-- -->", "")])
def test_odd_pages_alone(spark, html, want):
    """No page of the batch holds a subtree that counting could remove."""
    rows = [(i, u, html, "x", 1, 2) for i, u in enumerate([None, "http://a.example/1"])]
    assert [r.text for r in page_texts(spark.createDataFrame(rows, PAGES)).collect()] == [want, want]


def test_empty_table(spark):
    assert page_texts(spark.createDataFrame([], PAGES)).isEmpty()


def test_a_sentence_keeps_words_that_the_menu_repeats():
    menu = "<div class='top'><a href='/c'>Contact</a><b>News</b></div>"
    template = frozenset(e.digest for e in hashed(parse(menu)) if e.tag in ("a", "b", "div"))
    kept = "<article><p>Write to <a href='/x'>Contact</a> for <b>News</b> today.</p></article>"
    assert text(menu + kept, template) == "Write to Contact for News today."
    assert text(menu + "<p>No article</p>", template) == "No article"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_all_pages_against_a_plain_cut(spark):
    """These pages hold one article each, of headings and paragraphs only."""
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)
        parts = re.split(r"(?:</?(?:p|h1|b|br)\b[^>]*>)+", re.sub(r"<[^>]*\Z", "", inner[1])) if inner else []
        lines = [re.sub(r"[ \t-\r]+", " ", unescape(p)).strip(" ") for p in parts]
        want[r.page_id] = "\n".join(x for x in lines if x)
    assert {r.page_id: r.text for r in QUERIES["op9_html_text"](spark, FOLDER).collect()} == want
