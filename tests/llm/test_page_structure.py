"""Which parts of a page are its text: adverts, notices, comments, hidden and nested elements, and names that wrap the text itself."""

from __future__ import annotations

import pytest

from letterspark.llm.html_text import extract_text, kept_text, page_lines

MAIN = "The main text of this page is here and it is long enough."
INSIDE = ("sponsored", "share", "newsletter", "cookie-banner", "related", "advert-box", "ad-slot", "ad", "notice", "social_links", "Article-Footer")
CASES = [
    ('<div class="widget"><p>The only text</p></div>', "The only text"),
    ('<div id="search"><p>Main text</p></div>', "Main text"),
    ('<h1>T</h1><div id="search"><p>Main text that is long</p></div>', "T Main text that is long"),
    *((f'<article><p>{MAIN}</p><div class="{c}"><p>gone</p></div><p>end</p></article>', f"{MAIN} end") for c in INSIDE),
    (f'<article><p>{MAIN}</p><article class="comment">Reader says</article></article>', MAIN),
    (f'<article><p>{MAIN}</p></article><section id="comments"><article>Reader says</article></section>', MAIN),
    (f'<article><p>{MAIN}</p><section class="comments"><article class="comment">Reader</article></section></article>', MAIN),
    (f'<article><p>{MAIN}</p><p hidden>x</p><p style="color:red; display: none">y</p><p class="hidden-gem">z</p></article>', f"{MAIN} z"),
    (f'<div class="site-nav">a b</div><p>{MAIN}</p><div class="site-footer">c</div>', MAIN),
    (f'<body class="comments-open share"><article><p>{MAIN}</p></article></body>', MAIN),
    (f'<div class="comments"><article><p>{MAIN}</p></article></div>', MAIN),
    (f'<article><div class="share-box"><p>{MAIN}</p></div></article>', MAIN),
    (f"<header>site</header><article><header><h1>T</h1></header><p>{MAIN}</p></article>", f"T {MAIN}"),
    (f'<article><p>{MAIN}</p></article><div class="comments">unclosed', f"{MAIN} unclosed"),
]


@pytest.mark.parametrize(("html", "text"), CASES)
def test_text_of_a_page(html, text):
    assert kept_text(page_lines(html), []) == text


def test_shared_lines_decide_where_a_name_wraps_the_text(spark):
    rows = [(k, f"http://h.example/{k}", f'<div class="widget"><p>menu of the site</p><p>{MAIN} {k} {"words " * k}</p></div>') for k in range(5)]
    got = {r.page_id: r.text for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"{MAIN} {k} {'words ' * k}".strip() for k in range(5)}


def test_very_long_page(spark):
    words = " ".join(f"w{k}" for k in range(200_000))
    long = "<nav>" + "<a>x</a>" * 20_000 + "</nav><article>" + "".join(f"<p>line {k}</p>" for k in range(60_000)) + f"<p>{words}</p></article>"
    rows = [(1, "http://h.example/a", long), (2, "http://h.example/b", long.replace("line 7<", "other<")), (3, "http://h.example/c", "<p>short</p>")]
    got = {r.page_id: r for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = " ".join(f"line {k}" for k in range(60_000)) + " " + words
    assert got[1].text == want and got[2].text == want.replace("line 7 ", "other ", 1) and got[1].n_chars == len(want) and got[3].text == "short"
