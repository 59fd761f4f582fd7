"""The analysis brings spans together with their texts, and sends them to Python, only where it must."""

from pyspark.sql import functions as F

from vellum.operators import chunk, tag

TEXTS = [(1, "Then The said John Kelly esquire and Cork came. Major Byrne, Of Derry; Hugh Major"), (2, None), (3, ""), (4, "Séan met Sligo" + " and Ann Fox" * 300), (None, "Mayo"), (1, "Down")]
SPANS = "doc_id long, text string, label string, score double, start int, end int"


def test_rules_spans_do_not_meet_their_texts_again(spark, monkeypatch):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = lambda: sorted(map(str, tag.analyze(docs).collect()))
    made = tag.analyze(docs.filter("doc_id > 2"))
    assert "Join" not in made._jdf.queryExecution().optimizedPlan().toString()
    found = rows()
    monkeypatch.setattr(tag.capital_tagger, "exact", False)
    assert rows() == found and len(found) > 300


def test_trimming_with_and_without_the_expressions(spark, monkeypatch):
    words = ["Kelly", "The said Kelly", "said Kelly", "ſaid Kelly", "Kelly Esquire", "Kelly, esqr.", "Kelly MAJOR", " Kelly", "Kelly\n", " Kelly", "County of Cork", "of Cork", "OF Cork", "Cork", "", "of ", "É", "Ke"]
    rows = [(i, w, label, 1.0, *at) for i, w in enumerate(words) for label in ("PER", "LOC", "ORG") for at in ((0, len(w)), (None, None))]
    made, texts = spark.createDataFrame(rows, SPANS), spark.createDataFrame([(i, w) for i, w in enumerate(words)], "doc_id long, full string")
    trimmed = lambda t: sorted(map(str, tag.trim_affixes(made, t).collect()))
    short = trimmed(texts)
    monkeypatch.setattr(tag, "_bare", lambda _: F.lit(False))
    assert trimmed(texts) == short


def test_only_documents_with_word_pieces_go_through_python(spark):
    rows = [(1, "Mc", "PER", 0.5, 0, 2), (1, "##Guire", "PER", 1.0, 2, 7), (2, "b", "LOC", None, 5, 6), (2, "a", "PER", 0.25, 0, 1), (2, "a", "PER", 0.25, 0, 1), (3, None, "PER", 1.0, 0, 1)]
    merged = tag.merge_wordpieces(spark.createDataFrame(rows, SPANS))
    assert "startswith" in merged._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(map(tuple, merged.collect()), key=str) == sorted([(1, "McGuire", "PER", 0.75, 0, 7), *rows[2:]], key=str)


def test_chunks_of_odd_texts(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.chunk_no, r.off, r.chunk) for r in chunk.chunks(docs).collect())
    assert got == sorted((i or 0, k, a, t[a:b]) for i, t in TEXTS if t for k, (a, b) in enumerate(chunk.chunk_offsets(t)))
