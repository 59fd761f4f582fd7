"""Pages without a main element: lists between paragraphs, short pages, comments without a label, menus alone."""

import pytest

from vellum.llm.html_text import extract

LONG = "This paragraph of the page goes on for a while, with words enough to be read as running text by anyone who reads it."


def text(page):
    return extract(page)[0]


def test_lists_between_paragraphs_stay():
    items = "".join(f"<li>{n} item</li>" for n in ("one", "two", "three", "four", "five", "six"))
    for tag in ("ul", "ol"):
        assert text(f"<body><p>{LONG}</p><{tag}>{items}</{tag}><p>{LONG}</p></body>").split("\n\n")[1:-1] == [f"{n} item" for n in ("one", "two", "three", "four", "five", "six")]
    table = "<table><tr><th>Town</th><th>Year</th></tr><tr><td>Cork</td><td>1641</td></tr></table>"
    assert text(f"<div><p>{LONG}</p>{table}<p>{LONG}</p></div>").split("\n\n") == [LONG, "Town", "Year", "Cork", "1641", LONG]


@pytest.mark.parametrize("page, want", [("<p>Hello</p>", "Hello"), ("Hello", "Hello"), ("just some plain text &amp; more", "just some plain text & more"), ("<html><body><h1>Title</h1></body></html>", "Title"), ("<div>Short one</div>", "Short one"),
                                        ("<p>Hello</p><p>you</p>", "Hello\n\nyou")])
def test_short_pages_have_their_text(page, want):
    assert text(page) == want


def test_menus_alone_have_none():
    assert text('<nav><a href="/">Home</a></nav><footer>© us, all rights reserved</footer>') == ""
    assert text('<ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul>') == ""
    assert text("") == "" and text("<script>x()</script>") == ""


@pytest.mark.parametrize("heading", ["Comments", "3 Comments", "Comments (12)", "Leserkommentare", "Commentaires", "Comentarios:", "Leave a reply"])
def test_comments_without_a_label_go(heading):
    post = f'<div class="post"><p>{LONG} So says a reader.</p></div>'
    page = f'<div class="content"><h1>A head line of some words</h1><p>{LONG}</p><p>{LONG}</p><h2>{heading}</h2>{post}{post}</div>'
    assert text(page) == f"A head line of some words\n\n{LONG}\n\n{LONG}"
    after = f'<div class="content"><p>{LONG}</p><div><h3>{heading}</h3>{post}</div><h2>More of the story itself</h2><p>{LONG}</p></div>'
    assert text(after) == f"{LONG}\n\nMore of the story itself\n\n{LONG}"


def test_headings_that_only_mention_comments_stay():
    page = f"<article><h1>Comments</h1><p>{LONG}</p><h2>Comments on the weather of 1641</h2><p>{LONG}</p></article>"
    assert text(page) == f"Comments\n\n{LONG}\n\nComments on the weather of 1641\n\n{LONG}"


def test_lists_of_links_around_the_text_go():
    menu = "<ul>" + "".join(f'<li><a href="/{i}">Menu entry {i}</a></li>' for i in range(6)) + "</ul>"
    assert text(f"<body>{menu}<div><p>{LONG}</p><p>{LONG}</p></div>{menu}</body>") == f"{LONG}\n\n{LONG}"
