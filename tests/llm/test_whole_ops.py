"""Persons without a title, and pages whose main part lies in an element with a boilerplate name."""

import re

import pytest

from vellum.llm import html_text, surrogates

KEY = b"a key for tests"


def test_later_and_earlier_mentions_of_a_person():
    text = "Smith came. Mr John Smith met JOHN SMITH; John Smith's dog, Smith’s and SMITH. Smithson, Smith-Jones and smith stay."
    new, n, _, kinds = surrogates.replace_text(text, KEY)
    assert n == 6 and kinds == "person:6"
    assert re.findall(r"(?i)\bsmith\S*", new) == ["Smithson,", "Smith-Jones", "smith"] and "john" not in new.lower()
    given, surname = re.search(r"Mr (\w+) (\w+) met", new).groups()
    assert new == text.replace("Smith came", f"{surname} came").replace("John Smith", f"{given} {surname}").replace(
        "JOHN SMITH", f"{given} {surname}".upper()
    ).replace("Smith’s", f"{surname}’s").replace(" SMITH.", f" {surname.upper()}.")


def test_listed_given_names_without_a_title():
    new, n, distinct, kinds = surrogates.replace_text("Gestern sah Anna Weiß den Film. Jean était là. Weiß lachte.", KEY)
    assert (n, kinds) == (2, "person:2") and "Anna" not in new and "Weiß" not in new and "Jean était" in new
    found = re.search(r"sah (\w+) (\w+) den .* (\w+) lachte", new).groups()
    assert found[0] in surrogates.GIVEN_F and found[1] == found[2]
    assert surrogates.replace_text("Peter went home. No name here.", KEY)[1] == 0


def test_possessives_and_mails_of_a_named_person():
    new, n, _, kinds = surrogates.replace_text("Mrs. Mary Fox's mail is mary.fox@a.org. Fox, Mary: 017 555-7713", KEY)
    assert kinds == "email:1,person:3,phone:1" and "Fox" not in new and "Mary" not in new
    given, surname = re.search(r"Mrs\. (\w+) (\w+)'s mail", new).groups()
    assert f"{surname}, {given}:" in new


ARTICLE = "<h1>The head line</h1>" + "".join(
    f"<p>Paragraph {i} of the page goes on here, with words enough to be read as text by anyone.</p>" for i in range(3)
)
NAV = "<nav><ul><li><a href=x>Home</a></li><li><a href=y>About</a></li></ul></nav>"
ASIDE = "<div class=sidebar><p>Paragraph aside of the page goes on here, with words enough to be read as text by anyone.</p></div>"


@pytest.mark.parametrize("part", ["main", "article", "main class='with-sidebar'"])
@pytest.mark.parametrize("around", ["div class='has-sidebar'", "div id='page-header-fixed'", "form action='/'", "form id=search-form"])
def test_main_part_in_a_boilerplate_wrapper(around, part):
    page = f"<html><body>{NAV}<{around}><{part}>{ARTICLE}</{part.split()[0]}>{ASIDE}</{around.split()[0]}><footer><p>All rights reserved.</p></footer></body></html>"
    text = html_text.extract(page)[0]
    assert text.startswith("The head line") and text.count("Paragraph") == 3 and "aside" not in text and "Home" not in text


def test_boilerplate_inside_or_beside_the_main_part_stays_out():
    comments = "<div class=comments><article><p>Paragraph by a reader goes on here, with words enough to be read as text.</p></article></div>"
    form = "<form><p>Paragraph of a form goes on here, with words enough to be read as text by anyone.</p></form>"
    related = "<div class=related><article><p>Paragraph of a teaser goes on here, with words enough to be read.</p></article></div>"
    text = html_text.extract(f"<body><div class=has-sidebar><main>{ARTICLE}{comments}{form}</main>{related}</div></body>")[0]
    assert text.count("Paragraph") == 3 and "reader" not in text and "form" not in text and "teaser" not in text
    hidden = html_text.extract(f"<body><aside><article>{ARTICLE}</article></aside></body>")[0]
    assert hidden == ""
