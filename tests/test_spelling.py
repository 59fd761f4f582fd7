"""The spelling of single words by rules against the expressions, and texts put together from their pieces."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import lexicon as L
from vellum.operators import normalize

#: What the rules look at, to be put together at random.
_PARTS = ("vv", "w", "ff", "i", "oi", "ie", "es", "v", "u", "eing", "e", "aa", "ee", "oo", "uu", "shanon", "b", "t", "a", "o", "th", "á", "Ó", "'s", "’s", "n")


def made_words() -> list[str]:
    rng = random.Random(8)
    words = {"".join(rng.choice(_PARTS) for _ in range(rng.randint(1, 4))).strip("'’") for _ in range(3_000)}
    words |= {*map("".join, itertools.product(_PARTS[:16], repeat=2)), "cor’k", "o’neill", "oneill", "agree", "doe", "yr", "McDonald", "the", "love"}
    listed = {w for w in (*L.OVERRIDES, *L.PLACE_SPELLINGS, *L.PLACE_NAMES, *L.SURNAMES, *L.PREFIXES, *L.FIRST_NAMES) if " " not in w}
    some = {w for w in words | listed if normalize._PIECES.fullmatch(w)}
    return sorted({*some, *map(str.upper, some), *map(str.capitalize, some), *(w[:1] + w[1:].upper() for w in some)})


def test_words_are_spelt_as_the_expressions_spell_them(spark):
    words = made_words()
    table = spark.createDataFrame([(w,) for w in words], "tok string")
    want = {r.tok: r.out for r in normalize.normalize_words(table).collect()}
    assert {w: normalize.spelt(w) for w in words} == want
    c = normalize.spelling_candidates(F.lower("tok"), F.substring("tok", 1, 1) != F.lower(F.substring("tok", 1, 1)))
    for r in table.select("tok", c.alias("c")).collect():
        assert normalize.candidates_of(r.tok.lower(), r.tok[0] != r.tok[0].lower()) == r.c


def test_rules_take_one_pass_without_an_exchange(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(i, "The olde towne of Corke") for i in range(50)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    table = spark.read.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(normalize, "settle", lambda _: pytest.fail("the words of all texts are brought together"))
    monkeypatch.setattr(normalize, "spread", lambda rows: rows)
    made = normalize.normalize(table)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert {r.normalized for r in made.collect()} == {"The old town of Corke"}


def test_long_texts_in_stretches_and_few_known_pieces(monkeypatch):
    rng = random.Random(3)
    words = ["O", "o", "Neill", "neale", "haue", "VLSTER", "corke", "I", "12", "-", "  ", "\n\n", "O'", "é", "paide", "Ó", "ie"]
    texts = [" ".join(rng.choice(words) for _ in range(200)) for _ in range(20)] + ["", "I", "I am", "O", "O Neill", "O 7 Neill", "O . Neill"]
    known = normalize.Pieces(normalize.spelt, True)
    want = [normalize.put_together(t, known) for t in texts]
    monkeypatch.setattr(normalize, "STRETCH", 20)
    monkeypatch.setattr(normalize, "KNOWN", 5)
    for t, (text, at) in zip(texts, want):
        again, places = normalize.put_together(t, known)
        known.trim()
        assert again == text and places.tolist() == at.tolist() and len(at) == len(text)
    assert len(known) <= 5 and len(known.moved) <= len(known)


def test_changed_words_by_frequency_are_sent_or_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "the horse loue"), (1, "loue"), (None, "loue"), (2, None)], "doc_id long, text string")
    zipf = spark.createDataFrame([("love", 5.0), ("horse", 5.0), ("the", 6.0)], "word string, zipf double")
    got = lambda: sorted(map(str, normalize.normalize(docs, "frequency", zipf).select("doc_id", "normalized", "char_map").collect()))
    sent = got()
    assert "the horse love" in sent[0] + sent[1] + sent[2]
    monkeypatch.setattr(normalize, "SENT_WORDS", 0)
    assert got() == sent
