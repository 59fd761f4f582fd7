"""Normaliser, chunker, tagger and sources on small literal tables."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import strings as S
from vellum.operators import chunk, normalize, tag
from vellum.sources import documents as sources


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first().y


def normal(spark, text, **kw):
    return normalize.normalize(spark.createDataFrame([(1, text)], "doc_id long, text string"), **kw).first()


def test_tokens_cover_the_text(spark):
    text = "I saw O Neale, 12 VVill’s «mähre»\n\n…"
    toks = normalize.tokens(
        spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    ).orderBy("doc_id", "pos").collect()
    assert "".join(t.tok for t in toks) == text
    assert all(text[t.start : t.start + len(t.tok)] == t.tok for t in toks)
    kinds = {t.tok: t.kind for t in toks}
    assert kinds["VVill’s"] == "word" and kinds["12"] == "digits" and kinds["ä"] == "other" and kinds["\n\n"] == "space"


@pytest.mark.parametrize(
    "text, out",
    [
        ("I met a man", "I, met a man"), ("He said I", "He said I"), ("O Neale went", "O'Neill went"), (
            "O, Neill went", "O'Neill went"
        ), ("O 5 Neill", "O 5 Neill"), (
            "the vniuersitie", "the university"
        ), ("a horse", "a hors"), ("VVILL", "WILL"), ("Vvill", "Will"),
        (
            "in dublin towne", "in Dublin town"
        ), ("a\n\nb  c\nd", "a\nb c d"), ("  lead", " lead"), (
            "”quoted“ — `x", '"quoted" -- \'x'
        ), ("ﬁne ſhip", "fin ship"), ("Murphy", "Murphy"), ("", ""), ("curly ’ stays", "curly ’ stays"),
    ],
)
def test_normalize(spark, text, out):
    assert normal(spark, text).normalized == out


def test_normalize_maps_every_character(spark):
    row = normal(spark, "O Neale of the vniuersitie, again I.")
    assert len(row.char_map) == len(row.normalized)
    assert row.normalized.startswith("O'Neill") and row.char_map[:7] == [0, 0, 2, 3, 4, 5, 6]
    at = row.normalized.index("university")
    assert row.char_map[at : at + 10] == [15 + j * 10 // 9 for j in range(10)]
    assert normal(spark, None).normalized is None


def test_normalize_by_frequency(spark):
    zipf = spark.createDataFrame([("horse", 5.0), ("hors", 1.0), ("love", 6.0), ("loue", 1.0)], "word string, zipf double")
    assert normal(spark, "the horse loue", mode="frequency", frequencies=zipf).normalized == "the horse love"
    assert normal(spark, "the horse", mode="heuristic").normalized == "the hors"
    with pytest.raises(ValueError):
        normal(spark, "x", mode="frequency")


def test_spelling_candidates_keep_the_rules_order(spark):
    rows = spark.createDataFrame(
        [("vvie", False), ("ffee", False), ("bees", True), ("seruaunt", False), ("subiect", False)], "w string, p boolean"
    )
    got = {r.w: r.c for r in rows.select("w", normalize.spelling_candidates(F.col("w"), F.col("p")).alias("c")).collect()}
    assert got["vvie"] == ["vvie", "wie", "vvy", "vvye", "uvie", "vvi"]
    assert got["ffee"] == ["ffee", "fee", "ffe"]
    assert got["bees"] == ["bees"]
    assert got["seruaunt"] == ["seruaunt", "servavnt"]
    assert got["subiect"] == ["subiect", "subyect", "svbiect"]


def chunks_by_hand(text, size, overlap):
    """The rule step by step over characters."""
    out, start = [], 0
    while start < len(text):
        limit = min(start + size, len(text))
        stops = [i + 1 for i in range(start, limit) if text[i] in ".!?"]
        blanks = [i for i in range(start, limit) if text[i] == " "]
        cut = limit
        if stops and stops[-1] - start > 40:
            cut = stops[-1]
        elif blanks and blanks[-1] > start + 40:
            cut = blanks[-1]
        out.append((start, cut))
        start = cut if cut - overlap <= start else cut - overlap
        while start < len(text) and text[start].isspace():
            start += 1
    return out


@pytest.mark.parametrize(
    "text",
    [
        "", "short", "x" * 1200, "x" * 2500, "word " * 700, "A sentence of some words. " * 120, "Early. " + "no stop here " * 150,
        "  \n lead " * 200, "a.b" * 900
    ]
)
def test_chunks(spark, text):
    assert chunk.chunk_offsets(text) == chunks_by_hand(text, 1200, 100)
    assert chunk.chunk_offsets(text, 600, 80) == chunks_by_hand(text, 600, 80)
    rows = chunk.chunks(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).collect()
    assert [(r.off, r.off + len(r.chunk)) for r in sorted(rows, key=lambda r: r.chunk_no)] == chunk.chunk_offsets(text)


def spans(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, label string, score double, start int, end int")


def test_tagger_offsets(spark):
    text = "John Smith went to Cork. Then Mary came."
    got = tag.analyze(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert {(r.text, r.label) for r in got} == {("John Smith", "PER"), ("Cork", "LOC"), ("Then Mary", "PER")}
    assert all(text[r.start : r.end] == r.text for r in got)
    with pytest.raises(ValueError):
        tag.analyze(spark.createDataFrame([(1, text)], "doc_id long, text string"), tagger="none")


def test_trim_affixes(spark):
    full = "the County of Cork and the said said Phelim, Esqr. of Dublin"
    t = spark.createDataFrame([(1, full)], "doc_id long, full string")
    rows = [
        (1, "County of Cork", "LOC", 0.9, 4, 18), (1, "the said said Phelim, Esqr.", "PER", 0.9, 23, 50),
        (1, "of Dublin", "LOC", 0.49, 51, 60), (1, "said Owen", "PER", 0.9, None, None), (1, "of", "LOC", 0.9, 51, 53),
        (1, "x", "ORG", 0.9, 0, 3)
    ]
    got = {(r.text, r.start, r.end) for r in tag.trim_affixes(spans(spark, rows), t).collect()}
    assert got == {("Cork", 14, 18), ("Phelim", 37, 43), ("Owen", None, None), ("of", 51, 53), ("x", 0, 3)}


def test_wordpieces_and_labels(spark):
    rows = [(1, "Mag", "PER", 0.8, 0, 3), (1, "##wire", "PER", 0.4, 3, 7), (1, "##x", "LOC", 0.9, 7, 8), (2, "Cork", "PER", 0.9, 0, 4)]
    got = {(r.doc_id, r.text, r.start, r.end, round(r.score, 3)) for r in tag.merge_wordpieces(spans(spark, rows)).collect()}
    assert got == {(1, "Magwire", 0, 7, 0.6), (1, "##x", 7, 8, 0.9), (2, "Cork", 0, 4, 0.9)}
    assert {r.label for r in tag.correct_counties(spans(spark, rows)).filter("text = 'Cork'").collect()} == {"LOC"}
    kept = tag.keep_allowed(spans(spark, rows).withColumn("off", F.lit(10)))
    assert {(r.text, r.start) for r in kept.collect()} == {("Mag", 10), ("Cork", 10)}
    full = "sir Phelim rode in the county near Milton, eldest Owen"
    t = spark.createDataFrame([(1, full)], "doc_id long, full string")
    far = "q" * 45
    t2 = spark.createDataFrame([(1, full), (2, far + " Milton " + far), (3, far + " near Bray " + far)], "doc_id long, full string")
    rows = [(1, "Phelim", "LOC", 0.9, 4, 10), (2, "Milton", "ORG", 0.9, 46, 52), (3, "Bray", "ORG", 0.9, 51, 55)]
    assert {r.text: r.label for r in tag.fix_labels(spans(spark, rows), t2).collect()} == {"Phelim": "PER", "Milton": "LOC", "Bray": "LOC"}
    assert t.count() == 1


def test_dedupe_exact(spark):
    rows = [(1, "a", "PER", 0.5, 0, 1), (1, "a", "PER", 0.7, 0, 1), (1, "a", "LOC", 0.7, 0, 1)]
    assert sorted((r.label, r.score) for r in tag.dedupe_exact(spans(spark, rows)).collect()) == [("LOC", 0.7), ("PER", 0.7)]


def test_strings(spark):
    assert one(spark, S.place_text, "The Towne of Londonderry!") == "londonderry"
    assert one(spark, S.place_text, None) == ""
    assert one(spark, S.split_pipe, " a | |b") == ["a", "b"]
    assert one(spark, S.flip_names, "Cork, Co.|Dublin") == [" Co. Cork", "Dublin"]
    assert one(spark, lambda c: S.uri_segment(c, -2), "http://kg/person/Finch_Martha_c17/x/") == "Finch_Martha_c17"
    assert one(
        spark, S.uri_source, "http://h/a/logainm/5"
    ) == "logainm" and one(spark, S.uri_source, "x") == "External Link" and one(spark, S.uri_source, "") == "Not Known"
    assert one(spark, S.nfkc, "ﬁſ") == "fis"
    assert one(
        spark, lambda c: S.context(F.lit("abc DEF ghi"), c, 2), "def"
    ) == "c def g" and one(spark, lambda c: S.context(F.lit("abc"), c, 2), "zz") == ""
    assert one(spark, lambda c: S.ratio(c, F.lit("armstrong jane")), "jane armstrong") == 64.0
    assert S.ratio_of("jane armstrong", "armstrong jane", "difflib") == 64.0 and S.ratio_of("", "") == 100.0
    assert one(spark, lambda c: S.token_sort_ratio(c, F.lit("jane, Armstrong")), "Armstrong  Jane") == 100.0


def test_lcs_length():
    import random

    rng = random.Random(1)
    for _ in range(100):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
        assert S.lcs_length(a, b) == t[-1][-1]


def test_sources(spark, tmp_path):
    (tmp_path / "up").mkdir()
    (tmp_path / "up" / "a.txt").write_text("plain text", encoding="utf-8")
    (tmp_path / "up" / "b.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "up" / "c.txt").write_bytes(b"")
    (tmp_path / "up" / "d.xml").write_text(
        '<?xml version="1.0"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><text><body><pb n="3"/><p>One &amp; two</p><p>Three</p></body></text></TEI>',
        encoding="utf-8"
    )
    got = {r.doc_id[-5:]: (r.kind, r.visual, r.error) for r in sources.read_uploads(spark, str(tmp_path / "up")).collect()}
    assert got == {"a.txt": ("text", "plain text", None), "b.txt": ("text", None, "not UTF-8"), "d.xml": ("xml", "One & two\nThree", None)}
    kinds = spark.createDataFrame(
        [("a.tei", "x"), ("b", "  <TEI>"), ("c", ""), ("d", "x")], "n string, c string"
    ).select("n", sources.kind_of(F.col("n"), F.col("c")).alias("k"))
    assert {r.n: r.k for r in kinds.collect()} == {"a.tei": "xml", "b": "xml", "c": "empty", "d": "text"}
    (tmp_path / "gold.jsonl").write_text(
        '{"doc_id":"doc2","mention":"Cork","label":"LOC","gold_uri":"u"}\n\n{"doc_id":"d","mention":"","label":"LOC","gold_uri":"u"}\n'
    )
    gold = sources.read_gold(spark, str(tmp_path / "gold.jsonl"))
    assert gold.count() == 2 and sources.validated_gold(gold, fail=False).count() == 1
    with pytest.raises(Exception, match="invalid gold row"):
        sources.validated_gold(gold).collect()
    (tmp_path / "lex.json").write_text('{"places": ["cork", "bray"]}')
    assert {
        (r.kind, r.term) for r in sources.read_lexicon(spark, str(tmp_path / "lex.json")).collect()
    } == {("places", "cork"), ("places", "bray")}
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert sources.read_candidates(spark, str(tmp_path / "cands"), make).count() == 3
    assert made == [1]
    m = spark.createDataFrame(
        [("1", "f", 1, "raw", 2, 2, 1, 1, 1, 0.5, 0.5, 0.5)],
        "record string, filename string, entry int, mode string, gold_count int, pred_count int, tp_count int, fp_count int, fn_count int, precision double, recall double, f1 double"
    )
    sources.write_metrics_csv(m, str(tmp_path / "m"))
    assert spark.read.option("header", True).csv(str(tmp_path / "m")).first().f1 == "0.5000"


def test_sparql_source_reads_bindings():
    from vellum.sources import sparql

    answer = {"results": {"bindings": [{"a": {"value": "1"}}, {"a": {"value": "2"}, "b": {"value": "x"}}]}}
    assert list(sparql.bindings(answer, ["a", "b"])) == [("1", None), ("2", "x")]
    assert [
        p.first for p in sparql.SparqlReader({"columns": "a", "partitions": "3", "endpoint": "", "query": ""}).partitions()
    ] == [0, 1, 2]


def test_stream(spark, tmp_path):
    from vellum.streaming.pipeline import annotate_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"doc_id": "1", "text": "John Smith lived in Cork with Mary Jones."}\n')
    annotate_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert {(r.text, r.label) for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {("Cork", "LOC")}
