"""No text stops the surrogates: odd letters, meeting surrogates, one entity in several spellings."""

import random
import re

import duckdb
import pytest

from vellum.llm import surrogates

KEY = b"a key for tests"
BITS = [
    "born ", "3 ", "Auguſt ", "İ", "ı", "ſ", "@", "x.com", "+44", " ", "20", "7946", "-", "Mrs ", "Mr ", "O'", "O’", "Neill", "Jean", "Mary", "1641", "password=", "²",
    "١٢", "K", "ß", "é", "Street", "12 ", "(0)", "DOB: ", "jan ", "MAY ", "4111 1111 1111 1111", "1.2.3.4", "GB29NWBK60161331926819", "deadbeef" * 4, "\n", ".", "'s",
]


def odd_text(rng):
    ranges = [(32, 0x250), (0x370, 0x530), (0x2000, 0x2200), (0x1F600, 0x1F640)]
    return "".join(rng.choice(BITS) if rng.random() < 0.8 else chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randrange(40)))


@pytest.mark.parametrize("seed", range(4))
def test_no_text_raises_and_no_two_entities_meet(seed):
    rng = random.Random(seed)
    for _ in range(2_000):
        _, made, _, titles = surrogates.replacements(odd_text(rng), KEY)
        surrogates.check(made, titles)


def test_the_two_texts_that_stopped_a_job():
    new, n, _, kinds = surrogates.replace_text("He was born 3 Auguſt 1941 in Cork", KEY)
    assert (n, kinds) == (1, "born:1") and re.fullmatch(r"He was born \d{1,2} [A-Z][a-z]+ (19|20)\d\d in Cork", new) and "1941" not in new
    new, n, distinct, _ = surrogates.replace_text("İb@x.com and iab@x.com", KEY)
    assert (n, distinct) == (2, 2) and len(set(new.lower().split(" and "))) == 2


def test_entities_that_meet_walk_on(monkeypatch):
    monkeypatch.setattr(surrogates, "_surrogate", lambda kind, text, key: {"1.1.1.1": "9.9.9.9", "2.2.2.2": "9.9.9.9", "9.9.9.9": "8.8.8.8"}.get(text, "9.9.9.9"))
    new = surrogates.replace_text("1.1.1.1 then 2.2.2.2 then 1.1.1.1", KEY)[0]
    assert new == "9.9.9.9 then 8.8.8.8 then 9.9.9.9"
    monkeypatch.setattr(surrogates, "_surrogate", lambda kind, text, key: "9.9.9.9")
    monkeypatch.setattr(surrogates, "WALK", 5)
    parts = surrogates.replace_text("1.1.1.1 then 2.2.2.2", KEY)[0].split(" then ")
    assert len(set(parts)) == 2


def test_one_number_in_several_spellings():
    new = surrogates.replace_text("+442079460958, +44 20 7946 0958, 020 7946 0958; +1 212 555 0123", KEY)[0]
    a, b, c, d = (re.sub(r"\D", "", x) for x in re.split("[,;]", new))
    assert a == b and a[:2] == "44" and c == "0" + a[2:] and a != "442079460958" and d[0] == "1"


def test_irish_names():
    new, n, _, kinds = surrogates.replace_text("Mr O'Neill met Mrs Mary O’Brien. O'Neill's dog, O’BRIEN.", KEY)
    assert (n, kinds) == (4, "person:4") and "Neill" not in new and "Br" not in new
    a, b, c, d = re.search(r"Mr O'(\w+) met Mrs \w+ O’(\w+)\. O'(\w+)'s dog, O’(\w+)\.", new).groups()
    assert a == c and b.upper() == d and a != b


def test_a_title_decides_the_gender():
    new = surrogates.replace_text("Jean came. Mrs Jean Valjean and Mrs Mary Pym met Jean.", KEY)[0]
    first, given, other, last = re.search(r"(\w+) came\. Mrs (\w+) \w+ and Mrs (\w+) \w+ met (\w+)\.", new).groups()
    assert given in surrogates.GIVEN_F and first == given == last and other in surrogates.GIVEN_F and other != given
    everyone = " ".join(f"Mrs {n} Pym." for n in surrogates.GIVEN_F + surrogates.GIVEN_M)
    _, made, _, titles = surrogates.replacements(everyone, KEY)
    surrogates.check(made, titles)


def test_surrogates_of_the_whole_table():
    """Distinct within every document; an address or a card by itself the same in all documents."""
    texts = [r[0] for r in duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.1/documents.parquet' WHERE text IS NOT NULL").fetchall()]
    seen: dict = {}
    for text in texts:
        _, made, _, titles = surrogates.replacements(text, KEY)
        surrogates.check(made, titles)
        for (kind, old), new in made.items():
            if kind in ("ip", "card", "ssn", "iban", "secret", "email"):
                assert seen.setdefault((kind, old), new) == new
    assert len(seen) > 100
