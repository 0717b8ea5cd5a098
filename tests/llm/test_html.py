from __future__ import annotations

import re

from html import unescape

import pytest

from salesops.llm import html
from salesops.llm.queries import main_text

P1 = "The first paragraph of the article goes on for quite a while, so that it is surely text."
P2 = "A second one, somewhat shorter than the first, follows."


def test_marked_article():
    page = f"""<!DOCTYPE html><html><head><title>no</title><style>p{{}}</style><script>var t="</p>";</script></head>
    <body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
    <article><header><h2>Title &amp; more</h2></header><p><b>{P1}<br><p>Short.</p><div class="cookie-notice">We use cookies</div>
    <p>{P2}\n &nbsp; <i>in</i>line</p><aside>See also</aside><form>Name <input></form><section id="comments"><p>First!</p></section></article>
    <aside class="sidebar">More</aside><footer>&copy; x</footer></body>"""
    assert html.main_text(page) == f"Title & more\n\n{P1}\n\nShort.\n\n{P2} inline"


def test_surge_and_dive_without_a_mark():
    links = "".join(f'<li><a href="/{i}">Link number {i}</a></li>' for i in range(12))
    page = f"<body><div><ul>{links}</ul></div><div><p>{P1}</p><p>Yes.</p><p>{P2}</p></div><div><ul>{links}</ul></div><p>Top</p>"
    assert html.main_text(page) == f"{P1}\n\nYes.\n\n{P2}"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body></body></html>", ""),
        ("<article></article>", ""),
        ("<article>a &lt; b &#x41;&#66; &unknown; 3 < 4</article>", "a < b AB &unknown; 3 < 4"),
        ("<article><p>one<p>two</p></i></div>three", "one\n\ntwo\n\nthree"),
        ("<article>x<!-- <p>no</p> -->y<![CDATA[z]]></article>", "xyz"),
        ("<article><p title='a>b' class=lead>kept</p><p hidden>gone</p></article>", "kept"),
        ("<main><div>m</div></main><div>out</div>", "m"),
        ("<article><pre>a\n\n b\tc</pre></article>", "a b c"),
        ("<article><script>if (a < b) { document.write('<p>x</p>') }</script>t<style>u", "t"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
    ],
)
def test_small_pages(page, text):
    assert html.main_text(page) == text


def test_very_long_and_deep_pages():
    deep = "<div>" * 20_000 + "<article>" + "<p>w</p>" * 20_000 + "</article>"
    assert html.main_text(deep).count("w") == 20_000
    assert html.main_text("<article>" + "word " * 200_000) == " ".join(["word"] * 200_000)
    assert html.main_text("<" * 50_000) == "<" * 50_000 and html.main_text("<" * 50) == ""
    assert html.main_text('<a b="' * 3_001)
    assert html.main_text("<article>t" + "<p " * 3_000) == "t" + " ".join(["<p"] * 3_000)


def test_whole_table_against_the_marked_articles(spark, small):
    rows = {r["page_id"]: r for r in main_text(spark, small).collect()}
    pages = spark.read.parquet(f"{small}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page["html"], re.S).group(1)
        blocks = [unescape(re.sub(r"</?b>|<br>", " ", b)) for b in re.split(r"</?p>|</?h1>", article)]
        wanted = "\n\n".join(" ".join(b.split()) for b in blocks if b.strip())
        got = rows[page["page_id"]]
        assert (got["text"], got["n_chars"], got["url"]) == (wanted, len(wanted), page["url"])


def test_odd_rows(spark):
    rows = [(1, None, None, "x"), (1, None, None, "x"), (None, "u", "<article>a</article>", "y"), (2, "", "", None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = html.extract(frame).collect()
    assert sorted(r["text"] for r in found) == ["", "", "", "a"]
    assert html.extract(frame.filter("page_id > 5")).count() == 0


@pytest.mark.parametrize(
    "name",
    ["has-sidebar", "right-sidebar", "comments-open", "widget-content", "no-banner", "search-result", "layout sidebar", "Widget"],
)
def test_containers_with_a_marking_word_keep_the_article(name):
    page = f"<body><div class='{name}'><nav>Home</nav><article><p>{P1}</p></article><aside>More</aside></div></body>"
    assert html.main_text(page) == P1
    assert html.main_text(f"<body><div id='{name}'><p>{P1}</p><p>{P2}</p></div></body>") == f"{P1}\n\n{P2}"
    assert html.main_text(f"<body><main><div role='{name}'><p>{P1}</p></div></main></body>") == P1


def test_form_around_the_page_and_comments_that_are_articles():
    page = f"<body><form><main><p>{P1}</p></main><div class='site-footer'>Imprint</div></form></body>"
    assert html.main_text(page) == P1
    comments = "".join(f"<article class='comment'>{P2}</article>" for _ in range(9))
    assert html.main_text(f"<article><p>{P1}</p><div class='comment-list'>{comments}</div></article>") == P1


@pytest.mark.parametrize("name", ["ad-box", "cookie-notice", "site-footer", "sidebar_widget", "share-buttons", "top-nav", "comments"])
def test_marked_names_are_dropped(name):
    assert html.main_text(f"<article><p>{P1}</p><div class='x {name}'>Gone</div></article>") == P1


def test_implied_end_tags():
    page = f"<article><p>{P1}<p class=ad>Buy<p>{P2}<ul><li>a<li class=ad>Buy<li>b</ul><p class=ad>Buy<div>c</div></article>"
    assert html.main_text(page) == f"{P1}\n\n{P2}\n\na\n\nb\n\nc"
    page = "<article><table><tr><td>a<td class=ad>Buy<td>b<tr class=ad><td>Buy<tr><td>c</table><dl><dt>d<dd class=ad>Buy<dt>e</dl></article>"
    assert html.main_text(page) == "a\n\nb\n\nc\n\nd\n\ne"
    nested = "<article><ul><li class=ad>Buy<ul><li>Buy</ul>Buy<li>kept</ul></article>"
    assert html.main_text(nested) == "kept"
