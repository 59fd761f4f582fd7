"""The fitted tagger: decoding against brute force, what it learns, and odd input."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import evaluate, perceptron, tag
from vellum.plans import tagger_queries

KINDS = ("PER", "LOC")


@pytest.mark.parametrize("seed", range(5))
def test_viterbi_by_brute_force(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 5, 7)
    first = np.concatenate([[0], np.cumsum(sizes)])
    e = rng.normal(size=(int(first[-1]), 5))
    move = rng.normal(size=(6, 5)) + np.where(perceptron.forbidden(KINDS), -1e9, 0)
    found = perceptron.viterbi(e, move, first)
    worth = lambda path, at: sum(e[at + t, y] + move[path[t - 1] if t else 5, y] for t, y in enumerate(path))
    for a, b in zip(first, first[1:]):
        best = max(itertools.product(range(5), repeat=b - a), key=lambda p: worth(p, a))
        assert tuple(found[a:b]) == best
        assert not perceptron.forbidden(KINDS)[[5, *best[:-1]], list(best)].any()


def test_gold_labels_and_back():
    texts = ["John Kelly of Cork. Mary", "", "x" * 300 + " Anne\nO'Neill went"]
    spans = [[(0, 10, "PER"), (14, 18, "LOC"), (20, 24, "PER"), (3, 3, "PER"), (5, 8, "DATE")], [], [(301, 305, "PER"), (306, 313, "PER")]]
    s = perceptron.sentences(texts)
    gold = perceptron.gold_labels(s, spans, KINDS)
    named = [(int(n), perceptron.label_names(KINDS)[g], texts[n][a:b]) for n, g, a, b in zip(s.text, gold, s.start, s.end) if g]
    assert named == [(0, "B-PER", "John"), (0, "I-PER", "Kelly"), (0, "B-LOC", "Cork"), (0, "B-PER", "Mary"), (2, "B-PER", "Anne"), (2, "B-PER", "O'Neill")]
    assert len(perceptron.sentences([""]).words) == 0 and len(perceptron.sentences(["a " * 200]).first) == 5


@pytest.fixture(scope="module")
def planted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts, gold = tagger_queries.planted(docs)
    return texts.cache(), gold.cache()


@pytest.fixture(scope="module")
def model(planted):
    return tagger_queries.fitted(*planted)


def test_planted_spans_are_where_they_say(planted):
    texts, gold = planted
    rows = gold.join(texts.select("doc_id", "text"), "doc_id").select(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start")).alias("s"), "label").collect()
    assert rows and all(r.s[0].isupper() and r.s == r.s.strip() for r in rows)
    assert {r.label for r in rows} == {"PER", "LOC"} and texts.filter("held_out").count() > 20


def test_better_than_the_rules_on_held_out_documents(planted, model):
    texts, gold = planted
    perceptron.register("fitted-test", model)
    pieces = texts.filter("held_out").select("doc_id", F.lit(0).alias("off"), F.col("text").alias("chunk"))
    f1 = {}
    for name in ("fitted-test", "rules"):
        found = tag.keep_allowed(tag.TAGGERS[name](pieces))
        f1[name] = evaluate.span_scores(gold.filter("held_out"), found, ["doc_id"]).filter("doc_id IS NULL").first().f1
    assert f1["fitted-test"] > 0.9 and f1["fitted-test"] > f1["rules"] + 0.3


def test_the_whole_analysis_runs_with_it(spark, model):
    perceptron.register("fitted-test", model)
    docs = spark.createDataFrame([(1, "The said John Kelly of Cork deposeth. Mr Murphy late of Dublin came before us."), (2, None), (3, ""), (None, "Sir Byrne sent his men to Derry")], "doc_id long, text string")
    got = {(r.doc_id, r.text, r.label) for r in tag.analyze(docs, "fitted-test").collect()}
    assert {(1, "John Kelly", "PER"), (1, "Cork", "LOC"), (1, "Murphy", "PER"), (1, "Dublin", "LOC"), (None, "Byrne", "PER"), (None, "Derry", "LOC")} <= got
    assert all(0 < e[2] <= 1 for e in model.tag(["Mr Murphy late of Dublin came before us with his wife"])[0])


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, None), (None, "text")], "doc_id long, text string")
    spans = spark.createDataFrame([(1, 0, 2, "PER"), (1, None, 2, "PER")], "doc_id long, start int, end int, label string")
    model = perceptron.fit(docs, spans)
    assert not model.weights.any() and model.tag(["John Kelly", ""]) == [[], []]


def test_fitting_twice_gives_the_same_model(planted, model):
    texts, gold = planted
    again = tagger_queries.fitted(texts.repartition(3), gold.repartition(5))
    assert np.allclose(again.weights, model.weights, atol=1e-4)
