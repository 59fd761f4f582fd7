"""The pipeline's stages against brute force on a small table."""

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import fixtures
from tests.llm.test_native_ops import contained
from tests.llm.test_python_ops import WORD, components
from vellum.llm import language

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    rows = {r.doc_id: r for r in docs.collect()}

    kept = stages["language_id"](spark, docs, SF)
    assert kept.columns == docs.columns
    scores = {r.doc_id: r for r in language.identify(docs, docs.filter(~language.held_out())).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, r in scores.items() if r.lang_pred != "und" and r.score > 0}

    one = stages["near_duplicates"](spark, kept, SF)
    own = [(r.doc_id, r.text) for r in kept.collect()]
    want = {i for i, (_, c) in components(own).items() if i == c}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == want

    clean = stages["decontamination"](spark, one, SF)
    bad = {d for d, *_ in contained([(r.doc_id, r.text) for r in one.collect()], items)}
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == want - bad

    mixed = stages["mixing"](spark, clean, SF).collect()
    words = Counter()
    for r in mixed:
        assert r.text in " ".join(WORD.findall(rows[r.doc_id].text)) and r.source == rows[r.doc_id].source and r.lang == rows[r.doc_id].lang
        words[r.doc_id] += len(r.text.split(" "))
    assert all(n <= 3 * len(WORD.findall(rows[i].text)) for i, n in words.items())
    total = sum(len(WORD.findall(r.text)) for r in clean.collect())
    assert abs(sum(words.values()) - total) < 0.1 * total

    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.text) for r in out) == Counter((r.doc_id, r.text) for r in mixed)
    sizes = Counter(r.shard for r in out)
    assert max(sizes.values()) - min(sizes.values()) <= 1


def test_language_stage_takes_its_decisions(spark):
    """The stage fills labels and rejects what no language explains best, which is not a test for letters."""
    known = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.lang: r.text for r in known.dropDuplicates(["lang"]).collect()}
    extra = [
        (10**6 + i, t, None if i % 2 else " ") for i, t in enumerate(texts.values())
    ] + [(10**7, "Q", None), (10**7 + 1, "123 !?", "en"), (10**7 + 2, None, None)]
    docs = known.select("doc_id", "text", "lang").union(spark.createDataFrame(extra, "doc_id long, text string, lang string"))
    kept = dict(corpus_pipeline.STAGES)["language_id"](spark, docs, SF)
    got = {r.doc_id: r.lang for r in kept.collect()}
    assert [got[10**6 + i] for i in range(len(texts))] == list(texts)
    assert not {10**7, 10**7 + 1, 10**7 + 2} & set(got)  # one letter tells no language
    assert got == got | {r.doc_id: r.lang for r in known.collect() if r.doc_id in got} and len(got) > 0.99 * known.count()


def test_stages_write_awkward_and_empty_tables(spark, tmp_path):
    clashing = "slot long, block long, mix_shard int, from_word long, kept string, law string, row_number long, _bad string, _away string, _gone string, SIZE_ string"
    for k, make in enumerate((fixtures.docs, fixtures.empty)):
        docs = make(spark)
        for c in clashing.split(", "):
            name, kind = c.split(" ")
            docs = docs.withColumn(name, F.lit("7").cast(kind))
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            path = f"{tmp_path}/{name}{k}"
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
            if name != "sharding":
                assert docs.columns == before.columns and docs.dtypes == before.dtypes
                if "slot" in docs.columns and docs.count():
                    assert docs.filter("slot <> 7 OR kept <> '7' OR mix_shard <> 7").count() == 0
        assert {"slot_", "law_", "size_"} <= set(docs.columns) and (docs.count() > 0) == (k == 0)
