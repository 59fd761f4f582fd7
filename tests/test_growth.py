"""What a task or a worker holds does not follow the table: batches, tasks of their own number, texts read once."""

import numpy as np
from pyspark.sql import functions as F

from vellum.operators import chunk, evaluate, normalize, rows, spans, tag, vectors
from vellum.plans import text_queries

SPANS = "doc_id long, text string, label string, score double, start int, end int"
RECORDS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


def test_texts_reach_python_in_small_batches(spark):
    docs = spark.createDataFrame([(1, "The olde towne")], "doc_id long, text string")
    pieces = docs.select("doc_id", F.lit(0).alias("off"), F.col("text").alias("chunk"))
    made = spark.createDataFrame([(1, "olde", "PER", 1.0, 4, 8)], SPANS)
    texts = docs.select("doc_id", F.col("text").alias("full"))
    before = {c: spark.conf.get(c) for c in (RECORDS, BYTES)}
    try:
        for run in (lambda: normalize.tokens(docs), lambda: chunk.chunks(docs), lambda: tag.capital_tagger(pieces), lambda: spans.beside(made, texts), lambda: spans.merge_adjacent(made, texts)):
            spark.conf.set(RECORDS, "10000")
            spark.conf.set(BYTES, "2147483647")
            run()
            assert int(spark.conf.get(RECORDS)) <= 1_000 and int(spark.conf.get(BYTES).rstrip("bB")) <= 4_000_000
        spark.conf.set(RECORDS, "10")
        rows.in_batches(docs)
        assert spark.conf.get(RECORDS) == "10"
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_contained_spans_and_differences_are_dealt_over_tasks_by_the_input(spark, tmp_path, monkeypatch):
    made = [(d, "x", "PER", 1.0, s, s + n) for d in range(5) for s, n in ((0, 9), (2, 3), (2, 3), (8, 4))]
    spark.createDataFrame(made, SPANS).write.parquet(str(tmp_path / "s"))
    table = spark.read.parquet(str(tmp_path / "s"))
    other = table.filter("start <> 8").withColumn("label", F.when(F.col("doc_id") == 4, "LOC").otherwise(F.col("label")))
    keys = lambda t: sorted(map(tuple, t.collect()))
    few, differ = keys(spans.drop_contained(table)), keys(evaluate.span_difference(table, other, ["doc_id"]))
    monkeypatch.setattr(rows, "DEALT", 10)
    dealt = [spans.drop_contained(table), evaluate.span_difference(table, other, ["doc_id"])]
    assert [keys(t) for t in dealt] == [few, differ]
    for t in dealt:
        assert "RepartitionByExpression" in t._jdf.queryExecution().analyzed().toString()
    assert len(few) == 10 and len(differ) == 5 + 2 + 2
    assert dealt[1]._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2  # each side is made once


def test_words_by_frequency_read_the_texts_once(spark, tmp_path):
    spark.createDataFrame([(1, "loue Loue love of VVar war"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = text_queries.choose_by_frequency(spark, str(tmp_path))
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.w for r in found.collect()} == {"loue", "love", "of", "vvar", "war"}


def test_nearest_cells_in_small_steps(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(7, 3))
    table = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=3)]) for i in range(40)], "id long, v array<double>")
    cells = lambda: [r.c for r in table.select("id", vectors.nearest_cells(F.col("v"), centres, 3).alias("c")).orderBy("id").collect()]
    want = cells()
    monkeypatch.setattr(vectors, "AT_ONCE", 20)
    assert cells() == want


def test_a_map_with_nulls_leaves_spans_out(spark):
    made = spark.createDataFrame([(1, "b", "PER", 1.0, 0, 2), (1, "c", "PER", 1.0, 1, 3), (1, "d", "PER", 1.0, None, 2), (1, "e", "PER", 1.0, 2, 4)], SPANS)
    maps = spark.createDataFrame([(1, [1, 2, None, 4], "abcdef")], "doc_id long, char_map array<int>, raw string")
    assert [tuple(r)[1:] for r in spans.project_to_raw(made, maps).collect()] == [("bc", "PER", 1.0, 1, 3)]
