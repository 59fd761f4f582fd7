"""What the fitted tagger does for each word, sentence and set of spans, against plain versions."""

import itertools
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from vellum.operators import evaluate, perceptron
from vellum.plans import tagger_queries

TEXTS = ["John Kelly of Cork. Mary!", "", "x y " * 100 + "Anne\nO'Neill went? ", "\n\n.", "é Ó’Brien’s 12th ſ ͏ a_b", "a " * 64 + "b", "Ab aB AB A a abc ABC Abc Ab1 " + "W" * 50]


def plain_shape(word):
    kinds = ("A" if c.isupper() else "a" if c.islower() else "0" if c.isdigit() else c for c in word[:40])
    return re.sub(r"(.)\1+", r"\1\1", "".join(kinds))


def plain_features(word):
    low, form = word.lower(), plain_shape(word)
    own = ["b", f"w{word}", f"l{low}", f"s{form}", f"p{low[:3]}", f"e{low[-3:]}", f"c{word[:1].isupper()}{len(word) > 1}", *[f"{k}{low in v}" for k, v in perceptron._LISTS.items()]]
    return tuple([zlib.crc32(x.encode("utf-8", "surrogatepass")) % perceptron.BUCKETS for x in names] for names in (own, [f"<l{low}", f"<s{form}"], [f">l{low}", f">s{form}"]))


def plain_sentences(texts):
    """(word, start, end, text) of each token, and the first token of each sentence."""
    out, first = [], [0]
    for n, t in enumerate(texts):
        for m in re.finditer(r"\w+(?:['’]\w+)*|[^\w\s]|\n", t):
            if m[0] != "\n":
                out.append((m[0], m.start(), m.end(), n))
            if (m[0] in ".!?\n" or len(out) - first[-1] >= perceptron.LONGEST) and len(out) > first[-1]:
                first.append(len(out))
        if len(out) > first[-1]:
            first.append(len(out))
    return out, first


def test_tokens_and_features():
    for texts in (TEXTS, [], [""], TEXTS[2:3], ["\n"], TEXTS[::-1] * 3):
        s, (want, first) = perceptron.sentences(texts), plain_sentences(texts)
        v = perceptron.Vocabulary()
        words = perceptron.cut(texts, v)[0]
        assert [(v.words[w], a, b, n) for w, a, b, n in zip(words, s.start, s.end, s.text)] == want and s.first.tolist() == first
        assert [list(map(tuple, f[s.words])) for f in (s.own, s.left, s.right)] == [[tuple(plain_features(w[0])[k]) for w in want] for k in range(3)]


def test_many_sentences_are_decoded_as_each_alone():
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 9, 300)
    first = np.concatenate([[0], np.cumsum(sizes)])
    e = rng.integers(-2, 3, (int(first[-1]), 5)).astype(np.float32)  # with many ties
    move = rng.integers(-1, 2, (6, 5)).astype(np.float32) + np.where(perceptron.forbidden(("PER", "LOC")), np.float32(-1e9), np.float32(0))
    alone = [perceptron.viterbi(e[a:b], move, np.array([0, b - a])) for a, b in itertools.pairwise(first)]
    assert perceptron.viterbi(e, move, first).tolist() == np.concatenate(alone).tolist()


def test_a_word_is_looked_up_once_by_a_tagger(monkeypatch):
    rng = np.random.default_rng(5)
    model = perceptron.Model(("PER", "LOC"), rng.normal(size=(perceptron.BUCKETS, 5)).astype(np.float32), np.zeros((6, 5), np.float32))
    s, e = model.read(TEXTS)
    assert np.array_equal(e, model.emission(perceptron.sentences(TEXTS)))
    want = model.tag(TEXTS)
    assert any(want)
    calls = []
    monkeypatch.setattr(perceptron, "features", lambda w, f=perceptron.features: calls.append(w) or f(w))
    assert model.tag(TEXTS * 2) == want * 2 and calls == []
    monkeypatch.setattr(perceptron, "KNOWN", 3)
    monkeypatch.setattr(perceptron, "TOGETHER", 2)
    assert model.tag(TEXTS) == want and len(calls) < 5 * len(perceptron.sentences(TEXTS).words)


def test_all_scores_in_one_exchange_of_spans(spark):
    rng = np.random.default_rng(6)
    some = lambda n: [(int(d) if d else None, int(a), int(a + b) if b < 4 else None, "PL"[c] if c < 2 else None) for d, a, b, c in rng.integers(0, [40, 4, 5, 3], (n, 4))]
    kind = "doc_id long, start int, end int, label string"
    gold, found = spark.createDataFrame(some(150), kind), {n: spark.createDataFrame(some(150), kind) for n in ("a", "b")}
    want = set()
    for name, p in found.items():
        for held in (True, False):
            own = tagger_queries.held_out() if held else ~tagger_queries.held_out()
            for r in evaluate.span_scores(gold.filter(own), p.filter(own), ["doc_id"]).filter("doc_id IS NULL").drop("doc_id").collect():
                want.add((*r, name, held))
    both = [p.withColumn("tagger", F.lit(n)) for n, p in found.items()]
    got = tagger_queries.overall_scores(gold.withColumn("tagger", F.explode(F.array(F.lit("a"), F.lit("b")))), both[0].unionByName(both[1]), ["tagger", "held_out"])
    assert set(map(tuple, got.collect())) == want and len(want) == 4
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0
