"""Main text where class names or copies of a page could take it away."""

import pytest

from panelspark.llm import html_text

ARTICLE = "<article><p>Own text of the page, of some length</p></article>"


@pytest.mark.parametrize("page,want", [
    (f'<div class="content-sidebar-wrap">{ARTICLE}</div><div class="sidebar">Side</div>', "Own text of the page, of some length"),
    ('<div class="layout no-sidebar"><p>Plain text of the page</p></div><div class="share">Share</div>', "Plain text of the page"),
    ('<div id="nav-page"><main><p>Text</p></main></div><div class="promo"><p>Buy this and that and more</p></div>', "Text"),
    ('<article><div class="related-body"><p>A long piece of text</p></div><div class="related">More</div></article>', "A long piece of text"),
    (f'{ARTICLE}<div class="related"><article><p>Card</p></article></div>', "Own text of the page, of some length"),
    (f'{ARTICLE}<div id="comments"><article class="comment"><p>{"very long comment " * 9}</p></article></div>', "Own text of the page, of some length"),
    ('<article class="ad"><p>Only text</p></article>', "Only text"),
])
def test_names_do_not_take_the_main_text(page, want):
    assert html_text.main_text(html_text.read(page), set()) == want


def test_copies_of_a_page_count_once(spark):
    menu = "<div><span>Menu of C</span></div>"
    rows = [(i, f"http://c.example/{i}", f"{menu}<div><section>Same text</section></div>") for i in range(30)]
    rows += [(30 + i, f"http://c.example/{30 + i}", f"{menu}<div><section>Own text {i}</section></div>") for i in range(9)]
    rows += [(50 + i, f"http://d.example/{i}", "<div>All of a small site</div>") for i in range(12)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = {p: "Same text" if p < 30 else f"Own text {p - 30}" if p < 50 else "All of a small site" for p, *_ in rows}
    assert {r.page_id: r.text for r in out} == want


def test_names_of_article_text_drop_nothing():
    def text(html):
        return html_text.main_text(html_text.read(html), set())
    assert text('<article><p class="share-price">The share price rose</p><p>Other news</p></article>') == "The share price rose\nOther news"
    assert text('<article><h2 id="related-work">Related work</h2><p>Text</p></article>') == "Related work\nText"
    assert text('<article><p>Text</p><div class="related"><p>More</p></div><ul class="comments"><li>first</ul></article>') == "Text"
    assert text('<p class="notice">Cookies</p><article><p>Text</p></article>') == "Text"
