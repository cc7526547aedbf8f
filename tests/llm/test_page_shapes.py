"""Main text of pages in several shapes, with the expected text written by hand."""

import pytest

from sparkweft.llm.html_text import main_text

LINE = "A paragraph with some words, commas, and an end that makes it long enough to count as prose."
NAV = "<nav><ul><li><a href='/'>Home</a></li></ul></nav>"
FOOT = "<footer><p>All rights reserved, of course, by the owners of this page, for ever.</p></footer>"


def paragraphs(n):
    return [f"{i} {LINE * 4}" for i in range(n)]


def tags(lines):
    return "".join(f"<p>{line}</p>" for line in lines)


@pytest.mark.parametrize("n", [1, 2, 5, 15, 30, 200])
def test_sections_of_an_article_at_any_length(n):
    first, second = paragraphs(n), paragraphs(2)
    page = (
        f"<body>{NAV}<article><header><h1>Title</h1><p>by line</p></header><section>{tags(first)}</section>"
        f"<section>{tags(second)}</section><ul><li>one</li><li>two</li></ul><aside><p>{LINE}</p></aside>"
        f"<table><tr><td>a</td><td>1</td></tr></table><figure><figcaption>Caption</figcaption></figure></article>{FOOT}</body>"
    )
    assert main_text(page) == "\n".join(["Title", *first, *second, "one", "two", "a", "1", "Caption"])


@pytest.mark.parametrize("n", [2, 5, 15, 30, 200])
@pytest.mark.parametrize("wrap", ["<div id='wrap'>{}</div>", "<main>{}</main>", "{}"])
def test_no_article_at_any_length(n, wrap):
    first, second = paragraphs(n), paragraphs(1)
    inner = (
        f"<div class='part'>{tags(first)}</div><table><tr><td>a</td><td>1</td></tr></table>"
        f"<figure><img src='x'><figcaption>Caption</figcaption></figure><section>{tags(second)}</section>"
        f"<ul><li><a href='1'>Next page</a></li></ul><div class='site-footer'><p>{LINE}</p></div>"
    )
    page = f"<body>{NAV}{wrap.format(inner)}{FOOT}</body>"
    assert main_text(page) == "\n".join([*first, "a", "1", "Caption", *second])


@pytest.mark.parametrize("n", [2, 15, 60])
def test_parts_below_different_parents(n):
    first, second = paragraphs(n), paragraphs(1)
    page = (
        f"<body><div id='page'><div class='row'><section>{tags(first)}</section></div><div class='row'><section>{tags(second)}"
        f"</section></div><div class='row'><a href='1'>{LINE}</a></div></div></body>"
    )
    assert main_text(page) == "\n".join([*first, *second])


@pytest.mark.parametrize("name", ["share-price", "related-work", "header-note", "menu-of-the-day", "social-policy", "noticeOfDeath"])
def test_names_of_topics_stay(name):
    page = f"<article><p>{LINE}</p><p class='{name}'>{LINE}</p><div id='{name}'><p>Short.</p></div></article>"
    assert main_text(page) == f"{LINE}\n{LINE}\nShort."


@pytest.mark.parametrize(
    "name",
    ["share", "share-buttons", "social-icons", "related-posts", "site-header", "cookie-banner", "newsletter-signup", "ad-slot-300x250",
     "comment-list", "main-menu", "topNav", "sidebar-left", "promo-of-the-day", "notice", "advert large"],
)
def test_names_of_extras_go(name):
    page = f"<article><p>{LINE}</p><div class='{name}'><p>{LINE}</p></div></article>"
    assert main_text(page) == LINE


def test_layout_table_and_loose_text():
    page = f"<table><tr><td><a href='1'>Menu</a><td><p>{LINE}</p><p>{LINE}</p></table>"
    assert main_text(page) == f"{LINE}\n{LINE}"
    page = f"<div>Loose words before it.<section><p>{LINE}</p><p>{LINE}</p></section>Loose words behind it.</div>"
    assert main_text(page) == f"Loose words before it.\n{LINE}\n{LINE}\nLoose words behind it."


def test_other_articles_on_the_page():
    page = f"<main><article>{tags(paragraphs(9))}</article><article><p>Teaser.</p></article><p><a href='1'>More of it</a></p></main>"
    assert main_text(page) == "\n".join(paragraphs(9))
