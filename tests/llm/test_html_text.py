"""Blocks, the tree, and whole pages."""

from __future__ import annotations

import re
from html import unescape

import numpy as np

from pairloom.llm import html_text as ht

TREE = ht.grow(np.array(ht.TRAINING, float))

PAGE = """<!DOCTYPE html><html><head><meta charset=utf-8><title>A &amp; B</title><style>p{a:b}</style>
<script>var t = "</p><p>not this"; if (a < b) track();</script></head><body>
<!-- <p>nor this</p> --><header><a href="/">Home</a> Site name</header>
<nav><ul><li><a href="/x">x</a><li><a href='/y > z'>y</a></ul></nav>
<div class="cookie-notice">We use cookies, and this text is long enough to be a paragraph of its own.</div>
<div id="main"><article><header><h1>The  title&nbsp;here</h1></header><p>First<br>line of <b>it</b> &lt;tag&gt; caf&eacute; &#x1F600; &copy
<p>Second.</p><p>Third <a href="#">with a link</a> inside.</p><aside>See also this and that</aside>
<form><label>Mail</label><input name=q><button>Send it</button></form><ul><li>one<li>two</ul>
<section class="comments"><p>I liked this article very much, thanks for writing such a long text.</p></section>
<p>Last one</article></div><footer>&copy; 2024 <p>All rights</p></footer></body></html>"""


def test_page():
    assert ht.main_text(PAGE, TREE).split("\n\n") == [
        "The title here", "First line of it <tag> café 😀 ©", "Second.", "Third with a link inside.", "one", "two", "Last one",
    ]


def test_articles_of_others_and_headers_of_articles():
    page = (
        "<div class='ad'>Buy now<article><div class='article-header'><h2>Head</h2></div><p>Mine"
        "<div id=comments><article class=c><p>Not mine, though it is a whole paragraph of words</article></div>"
        "<p>Mine too</article><aside><article><p>A teaser</article></aside><div class='related-posts'><main>More</main></div>"
    )
    assert ht.main_text(page, TREE).split("\n\n") == ["Head", "Mine", "Mine too"]


def test_tree_fits_its_table():
    assert all(ht.keep(TREE, row[:-1]) == bool(row[-1]) for row in ht.TRAINING)


def test_without_containers():
    menu = "".join(f"<div><a href=/{i}>Item {i}</a></div>" for i in range(6))
    body = "".join(f"<div>{'word ' * n}</div>" for n in (60, 45, 5, 70))
    found = ht.main_text(f"<body>{menu}{body}{menu}</body>", TREE)
    assert [len(b.split()) for b in found.split("\n\n")] == [60, 45, 5, 70]


def test_broken_markup_and_special_rows(spark):
    pages = ["", None, "<", "<p", "<p class='x", "<script>never closed", "a &amp; b", "<article>x<p>y", "<!-- open", "<p>" * 3000, "<article>" + "<p>w &amp;lt; </p>" * 20_000]
    rows = [(i, "u", p, "clash", 9) for i, p in enumerate(pages)] + [(None, None, "<article>z</article>", None, None)] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    found = {r["page_id"]: r["text"] for r in ht.extract(df).collect()}
    assert [found[i] for i in (0, 1, 3, 5, 7, 8, 9)] == ["", "", "", "", "x\n\ny", "", ""] and found[None] == "z"
    assert found[10].count("\n\n") == 19_999 and "w &lt;" in found[10]
    assert ht.extract(df).columns == ["page_id", "url", "text", "n_chars"] and ht.extract(df.limit(0)).collect() == []
    assert ht.extract(df).count() == len(rows)


def test_given_pages(spark):
    """In these pages the article element holds the main text and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    sources = {r["page_id"]: r["html"] for r in pages.collect()}
    for row in ht.extract(pages).collect():
        inside = re.search(r"<article>(.*)</article>", sources[row["page_id"]], re.S)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inside))
        assert row["text"] == "\n\n".join(p for p in parts if p) and row["n_chars"] == len(row["text"])


def test_letters_that_change_length_in_lower_case():
    page = "<article><p>" + "\u0130stanbul " * 60 + "</p><script>var a = 1</ſcript> 2</SCRIPT><p>After the script.</p></article>"
    found = ht.main_text(page, TREE).split("\n\n")
    assert found[1:] == ["After the script."] and found[0].count("\u0130") == 60


def test_unclosed_elements_take_linear_time():
    import time

    took = []
    for n in (4_000, 16_000):
        page = "<article>" + "<p>some words here<button>\u0130" * n
        began = time.perf_counter()
        ht.main_text(page, TREE)
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5


def test_misleading_names_do_not_lose_the_article():
    body = "<p>" + "a sentence of the story with quite a few words in it " * 6 + "</p>"
    for name in ("promo story", "widget", "search", "form-guide", "legal", "social", "share-prices", "notice", "banner"):
        page = f"<nav><a href=/>Home</a></nav><div class='{name}'>{body}{body}</div><footer>all rights</footer>"
        assert ht.main_text(page, TREE).count("sentence") == 12, name
    notice = "<div class='notice'>Please note our terms</div><div class=share><a href=/x>Share this</a></div>"
    assert ht.main_text(f"<article>{body}</article>{notice}", TREE).count("\n\n") == 0


def test_pages_without_telling_names():
    links = "".join(f"<li><a href=/{i}>Topic {i}</a></li>" for i in range(8))
    paragraphs = "".join(f"<div class=x{i}>" + "plain words of a paragraph " * n + "</div>" for i, n in enumerate((12, 20, 9)))
    page = f"<table><tr><td><ul>{links}</ul></td><td>{paragraphs}</td></tr></table><div><a href=/>Back</a> | <a href=/s>Map</a></div>"
    found = ht.main_text(page, TREE).split("\n\n")
    assert [len(b.split()) for b in found] == [60, 100, 45]
