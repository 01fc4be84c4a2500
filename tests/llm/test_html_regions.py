"""Main text of pages: malformed markup, long pages, and regions that only the clusters tell apart."""

import time

import numpy as np
import pytest

from copse.llm import html_text

LONG = "This is a long paragraph of the article that goes on for quite a while, with commas, and ends at last."
TEASERS = "".join(f"<article><h3><a href=x>Teaser {i}</a></h3><p>Short teaser.</p></article>" for i in range(30))
ITEMS = "".join(f"<li>item {i} of a list</li><li>it</li>" for i in range(30))

REGIONS = [
    (f"<main><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p><p>End.</p></div></main><div>{TEASERS}</div>", f"T {LONG} {LONG} End."),
    (f"<article><ul>{ITEMS}</ul></article><article><h1>T</h1><p>{LONG}</p><p>{LONG}</p></article>", f"T {LONG} {LONG}"),
    (f"<main><article><h1>T</h1><p>{LONG}</p><p>b</p></article><div><p>Read also these</p><ul><li><a>x y z</a></ul></div></main>", f"T {LONG} b"),
]


@pytest.mark.parametrize(("html", "text"), REGIONS)
def test_clusters_select_the_region(html, text, monkeypatch):
    assert html_text.main_text(html) == text
    monkeypatch.setattr(html_text, "_upper", lambda smooth: np.ones(len(smooth), bool))
    assert html_text.main_text(html) != text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<div><a>Home</a> <a>News</a></div><div><h1>T</h1><p>{LONG}</p><p>Short.</p><ul><li><a>one</a><li><a>two</a></ul><p>{LONG}</p></div><div>Contact | Imprint</div>", f"T {LONG} Short. one two {LONG}"),
        (f"<main><h1>T</h1><article><p>{LONG}</p><p>b</p></article></main>", f"T {LONG} b"),
        (f"<article><h1 id='social-history'>S</h1><p>{LONG}</p><section id='discussion'><h2 id='related-work'>D</h2><p>{LONG}</p><p>{LONG}</p></section><div class='related-posts'><ul><li><a>x</a></ul></div><ul><li><a>y</a></ul><div class='notice'>{LONG}</div><section class='comments'><p>{LONG}</p></section></article>", f"S {LONG} D {LONG} {LONG} y"),
    ],
)
def test_evidence_beside_the_clusters(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<![foo[x]]><p>a b c</p>", "a b c"),
        ("<p>a<![if !IE]>b<![endif]--> c</p>", "ab c"),
        ("<p>a &#" + "9" * 6000 + "; &#0000000065;</p>", "a � A"),
        ("<p>a</p><!-- no end <p>b</p>", "a"),
        ("<p>a</p><p>b <a href='x", "a b"),
        ("<p>a < b && c > d</p>", "a < b && c > d"),
        ("<p>a<![CDATA[x > y]]>b</p>", "ab"),
    ],
)
def test_malformed(html, text):
    assert html_text.main_text(html) == text


@pytest.mark.parametrize(
    "html",
    ["<i><p>" + "<b>" * 150_000 + "</i>" * 150_000, "<p><button>" + "<span>" * 90_000 + "<h1></h1>" * 50_000, "<a " * 300_000, "<!--" * 200_000 + ">", "<![CDATA[" * 100_000 + ">", "<p a='" * 150_000, "</" * 400_000, "<div>" * 200_000 + "x", "<p>" + "word " * 200_000],
)
def test_a_megabyte_takes_linear_time(html):
    start = time.process_time()
    html_text.main_text(html)
    assert time.process_time() - start < 4
