"""Infilling, exact top-k search and importance resampling against brute force, and on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm import fixtures
from vellum.llm import infill, resample, topk

TOKEN = re.compile(r"[A-Za-z]+|[^A-Za-z]")
ODD = ["", "a", "abc", "1", "a1b2", "é", "aé b\n\nc  Zz", "word " * 300, "x" * 5000, "ſK", "\U0001f600ab\U0001f600", "<P", "a<S>b", "tab\tand\x00nul"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# infilling


@pytest.mark.parametrize("text", ODD)
def test_every_token_end_can_be_selected(text, monkeypatch):
    ends = [m.end() for m in TOKEN.finditer(text)]
    for size in (1 << 20, 1, 2, 3, 7):
        monkeypatch.setattr(infill, "SLICE", size)
        assert [int(x) for e in infill.token_ends(text) for x in e] == ends
        chosen = infill.Selector(infill.elias_fano(text))
        assert (chosen.n, [chosen.end(i) for i in range(chosen.n + 1)]) == (len(ends), [0, *ends])


def test_lists_are_small():
    text = " ".join("word" * (1 + i % 3) for i in range(10_000))
    n = len(TOKEN.findall(text))
    assert len(infill.elias_fano(text)) * 8 < n * (2 + math.ceil(math.log2(len(text) / n))) + 200


def infilled(doc_id, text, seed="1"):
    text = text or ""
    tokens = TOKEN.findall(text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    pre, mid, suf = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(tokens), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(tokens), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(tokens), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("hot", [1_000, 3])
def test_infilling_by_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(infill, "HOT", hot)
    rows = [(i, random.Random(i).choice(ODD)) for i in range(300)] + [(None, "no id here"), (7, "twice"), (7, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    if hot == 3:  # also where the hot texts are too many to send
        monkeypatch.setattr(infill, "small_or_not", lambda df, n: (df, n != 100_000))
    got = infill.fill_in_middle(docs).withColumn("back", infill.restored(F.col("output"), F.col("form")))
    want = Counter((i, *infilled(i, t), t or "") for i, t in rows)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {f for _, _, f, *_ in want} == {"plain", "psm", "spm"}


def test_infilling_of_awkward_rows(spark):
    docs = fixtures.docs(spark).withColumnRenamed("bucket", "form").withColumnRenamed("size", "n")
    got = infill.fill_in_middle(docs, keep=["form", "n", "lang"])
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "form_", "n_", "lang"]
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got.collect()) == Counter(
        (i, *infilled(i, t)) for i, t, *_ in fixtures.rows()
    )
    assert infill.fill_in_middle(fixtures.empty(spark)).collect() == []


def test_texts_that_share_a_digest_are_an_error(spark):
    rows = spark.createDataFrame([("text",), ("other",)], "text string").withColumns({"size": F.lit(4), "check": F.xxhash64(F.lit("text"))})
    assert infill._checked(rows.filter("text = 'text'")).count() == 1
    with pytest.raises(Exception, match="two texts share a digest"):
        infill._checked(rows).collect()


def test_texts_are_shuffled_once(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    plan = infill.fill_in_middle(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


# top-k


def ranked(vectors, every=50, k=5):
    """(query id, rank, id, score) by full comparison; vectors: rows (id, list or None)."""
    whole = [(i, [math.floor(256 * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (i, v) in enumerate(whole):
        if i is not None and i % every == 0:
            rest = [(sum(a * b for a, b in zip(v, w)), j) for r, (j, w) in enumerate(whole) if r != q and len(w) == len(v)]
            rest.sort(key=lambda x: (-x[0], x[1] is None, x[1]))
            out += [(i, n + 1, j, s) for n, (s, j) in enumerate(rest[:k])]
    return Counter(out)


def clustered(n, seed=0, dim=16, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    return [(i, (centres[i % 12] + spread * rng.normal(size=dim)).astype(np.float32).tolist()) for i in range(n)]


@pytest.mark.parametrize("pass_rows", [16_384, 3])
def test_top_k_by_brute_force(spark, pass_rows):
    vectors = clustered(700) + [(i, [float(i % 3)] * 16) for i in range(700, 760)]  # many ties
    got = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), every=20, pass_rows=pass_rows)
    assert Counter(tuple(r) for r in got.collect()) == ranked(vectors, 20)


def test_top_k_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [
        (0, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [1.0, 2.0]), (50, [3.0, -2.0]), (None, [1.0, 2.0]), (None, [9.0, 9.0]), (100, None), (150, [1.0, None]), (200, [nan, 1.0]),
        (250, [inf, 1.0]), (300, []), (301, []), (350, [1.0]), (400, [0.5, 0.25, 0.125]), (401, [-0.001, 0.001, 0.0]), (-50, [0.0, 0.0]), (7, [1.0, 2.0])
    ]
    schema = "vec_id long, embedding array<double>, rank int, score string, `v` int"
    frame = spark.createDataFrame([(*v, 1, "s", 2) for v in vectors], schema)
    assert Counter(tuple(r) for r in topk.top_k(frame).collect()) == ranked(vectors)
    assert topk.top_k(frame.limit(0)).collect() == []
    alone = topk.top_k(frame.filter("vec_id = 350")).collect()
    assert alone == []


def test_top_k_of_wide_numbers(spark):
    rng = random.Random(3)
    vectors = [(i, [rng.uniform(-1e6, 1e6) for _ in range(3)]) for i in range(120)] + [(1000, [1e300, -1e300, 0.0])]
    got = topk.top_k(spark.createDataFrame(vectors[:-1], "vec_id long, embedding array<double>")).collect()
    assert Counter(tuple(r) for r in got) == ranked(vectors[:-1])
    wide = topk.top_k(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")).collect()
    assert {r.query_id for r in wide} == {0, 50, 100, 1000} and all(abs(r.score) < 2**63 for r in wide)


def blocks_in_memory(vectors):
    order = sorted(vectors, key=lambda r: (int(np.argmax(r[1])), int(np.argmin(r[1])), r[0]))
    whole = np.floor(256 * np.array([v for _, v in order])).astype(np.int64)
    ids = np.array([i for i, _ in order])
    out = []
    for b in range(0, len(whole), topk.BLOCK):
        x = whole[b : b + topk.BLOCK]
        out.append((b // topk.BLOCK, ids[b : b + topk.BLOCK], x, x.max(0), x.min(0)))
    return whole, ids, out


@pytest.mark.parametrize("exact", [np.float64, object])
def test_pruning_keeps_the_best_and_skips_blocks(exact):
    n = 4_000 if exact is np.float64 else 500
    whole, ids, blocks = blocks_in_memory(clustered(n))
    rows = np.arange(0, n, 50)
    s = topk.Search(whole[rows], rows, np.full(len(rows), -np.inf), 5, exact)
    for at in range(0, len(blocks), 16):
        s.take(blocks[at : at + 16])
    for q, row in enumerate(rows):
        scores = whole @ whole[row]
        best = sorted((j for j in range(n) if j != row), key=lambda j: (-scores[j], ids[j]))[:5]
        assert [(int(a), int(b)) for a, b in zip(s.ids[q], s.scores[q])] == [(int(ids[j]), int(scores[j])) for j in best]
    assert s.seen == len(rows) * len(blocks)
    if exact is np.float64:
        assert s.scored < s.seen / 2


# resampling


WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, width=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORDS.findall(low)
    return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % 10_000 for k in range(1, width + 1) for i in range(len(w) - k + 1)]


def resampled(docs, target, percent=5, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(grams(text)[1])
    for text in target:
        t.update(grams(text)[1])
    n, m = float(sum(s.values())), float(sum(t.values()))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10_000) / ((s[b] + 1) * (m + 10_000)))) for b in range(10_000)]
    rows = []
    for i, text in docs:
        words, own = grams(text)
        weight = sum(gain[b] for b in own)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    drawn = order[: percent * len(order) // 100]
    return Counter((*r, drawn.index(r) + 1 if r in drawn else None) for r in rows)


def made_texts(n, seed=5):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "é", "x9", "the", "of", "W" * 70, "straße", "1999", "Ωmega"]
    return [(i, rng.choice([" ", ", ", "\n", "-"]).join(rng.choice(words) for _ in range(rng.randrange(60)))) for i in range(n)]


@pytest.mark.parametrize("chunk", [65_536, 40, 1])
def test_resampling_by_brute_force(spark, chunk):
    docs, target = made_texts(150), [t for _, t in made_texts(20, 9)]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = resample.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"), chunk=chunk, percent=30)
    assert Counter(tuple(r) for r in got.collect()) == resampled(docs, target, 30)


def test_resampling_of_awkward_rows(spark):
    rows = [(i, t) for i, t, *_ in fixtures.rows()]
    docs = fixtures.docs(spark).withColumnRenamed("bucket", "weight").withColumnRenamed("hash", "_in")
    target = spark.createDataFrame([(fixtures.BASE,), (None,), ("",)], "text string")
    for chunk in (65_536, 100):
        got = resample.resample(docs, target, keep=["weight", "_in", "lang"], percent=50, chunk=chunk)
        assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank", "weight_", "_in_", "lang"]
        found = got.collect()
        assert Counter(tuple(r)[:6] for r in found) == resampled(rows, [fixtures.BASE], 50)
        assert Counter(r.lang for r in found) == Counter(r[2] for r in fixtures.rows()) and all(r.weight_ == 1 and r._in_ == "h" for r in found)
    assert resample.resample(fixtures.empty(spark), target).collect() == []
    none = resample.resample(docs, target.limit(0), percent=50).collect()
    assert Counter(tuple(r) for r in none) == resampled(rows, [], 50)


def test_drawn_documents_come_whole(spark):
    docs = spark.createDataFrame(made_texts(100), "doc_id long, text string").withColumn("n", F.length("text"))
    drawn = resample.drawn_documents(docs, docs.limit(5), percent=20).collect()
    assert sorted(r["rank"] for r in drawn) == list(range(1, len(drawn) + 1)) and drawn
    texts = dict(made_texts(100))
    assert all(r.text == texts[r.doc_id] and r.n == len(r.text) for r in drawn)


@pytest.mark.parametrize("chunk", [1, 7, 100])
def test_chunks_own_every_start_once(spark, chunk):
    texts = [t for _, t in made_texts(20)] + ["", "one", "-- !", "x" * 500, "ends here ", " a b c d e f g h"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.struct(F.lit(0).alias("end")))
    chunks = resample.split_long(docs, 3, chunk).collect()
    for i, text in enumerate(texts):
        own = [r for r in chunks if r.doc_id == i]
        assert sum(r.owned for r in own) == grams(text)[0] and [r.kept is not None for r in own] == [True] + [False] * (len(own) - 1)
        found = []
        for *_, hashed in resample.features(pa.array([r.text for r in own]), pa.array([r.owned for r in own], pa.int64()), 10_000, 3):
            found += hashed.tolist()
        assert Counter(found) == Counter(grams(text)[1])
