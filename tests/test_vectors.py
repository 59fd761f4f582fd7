"""The inverted file against full comparison."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellum.operators import score, vectors

SF = "/root/testdata/sf0.1"


def exact(rows, queries, k=5):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = x @ x[ids == q][0]
        neural = np.round((s + 1) / 2, 5)
        out[q] = sorted((-n, i) for n, i in zip(neural, ids) if i != q)[:k]
    return out


def clustered(n, dim=12, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim))
    return [(i, (centres[i % 10] + 0.3 * rng.normal(size=dim)).tolist()) for i in range(n)]


def as_queries(rows, every=100):
    return rows.filter(F.col("id") % every == 0).select(F.col("id").alias("q"), "v")


@pytest.mark.parametrize("part", [20_000, 7])
def test_all_cells_are_exact(spark, monkeypatch, part):
    monkeypatch.setattr(vectors, "PART", part)
    monkeypatch.setattr(vectors, "BLOCK", 3)
    made = clustered(400) + [(i, [1.0] * 12) for i in range(400, 430)]  # a cell of copies
    rows = vectors.usable(spark.createDataFrame(made, "vec_id long, embedding array<double>"))
    centres = vectors.fit_centres(rows, cells=8)
    index = vectors.assign(rows, centres)
    assert index.count() == len(made) and len(centres) == 8
    got = vectors.search(index, as_queries(rows, 50), centres).collect()
    want = exact(made, range(0, 430, 50))
    for q, best in want.items():
        own = sorted((r["rank"], r.id, r.neural) for r in got if r.q == q)
        assert [(i, pytest.approx(n, abs=1.1e-5)) for _, i, n in own] == [(i, -n) for n, i in best]


def test_recall_on_the_whole_table(spark):
    """Against the full comparison of every hundredth vector, as cosine_rank does it."""
    rows = vectors.usable(spark.read.parquet(f"{SF}/embeddings.parquet"))
    centres = vectors.fit_centres(rows)
    index = vectors.assign(rows, centres)
    probes = vectors.calibrate(index, rows.filter("id % 100 <> 0").select(F.col("id").alias("q"), "v"), centres)
    got = {(r.q, r.id) for r in vectors.search(index, as_queries(rows), centres, probes=probes).collect()}
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    asked = table.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))
    true = {(r.q, r.vec_id) for r in score.nearest(table, asked).collect()}
    assert len(got & true) / len(true) >= 0.9 and len(got) == len(true) and probes < len(centres)


def test_few_cells_do_where_vectors_lie_in_groups(spark):
    made = clustered(2_000)
    rows = vectors.usable(spark.createDataFrame(made, "vec_id long, embedding array<double>"))
    centres = vectors.fit_centres(rows, cells=40)
    index = vectors.assign(rows, centres)
    probes = vectors.calibrate(index, as_queries(rows, 7), centres)
    assert probes <= 10
    got = {(r.q, r.id) for r in vectors.search(index, as_queries(rows), centres, probes=probes).collect()}
    want = {(q, i) for q, best in exact(made, range(0, 2_000, 100)).items() for _, i in best}
    assert len(got & want) >= 0.9 * len(want)


def test_awkward_vectors(spark):
    nan = float("nan")
    made = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [1.0, None]), (None, [1.0, 1.0]), (6, [1.0, 1.0]), (7, [1.0, 1.0]), (8, [1e200, 1e200]), (9, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(*r, 1, "v") for r in made], "vec_id long, embedding array<double>, cell int, v string")
    rows = vectors.usable(frame)
    assert sorted(r.id for r in rows.collect()) == [6, 7, 8, 9]
    centres = vectors.fit_centres(rows.filter("size(v) = 2"))
    index = vectors.assign(rows, centres)
    got = sorted((r.q, r.id, r.neural) for r in vectors.search(index, rows.select(F.col("id").alias("q"), "v"), centres).collect())
    assert got == [(a, b, 1.0) for a in (6, 7, 8) for b in (6, 7, 8) if a != b]
    none = rows.limit(0)
    assert vectors.search(vectors.assign(none, centres), none.select(F.col("id").alias("q"), "v"), centres).collect() == []
    assert len(vectors.fit_centres(none)) == 0


def test_nearest_by_products_equals_the_score_of_each_pair(spark):
    rng = np.random.default_rng(3)
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0, 0.0, 0.0], [nan, 1.0, 2.0], [1.0, None, 2.0], [inf, 1.0, 1.0], [1e200, 1e200, 1e200], [1.0, 2.0], [1e-200, 0.0, 0.0]]
    made = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(60)] + [(100 + i, v) for i, v in enumerate(odd)] + [(200 + i, [1.0, 2.0, 3.0]) for i in range(20)] + [(None, [1.0, 2.0, 3.0])]
    table = spark.createDataFrame(made, "vec_id long, embedding array<double>").repartition(3)
    asked = table.filter("vec_id IS NOT NULL").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))
    pairs = asked.join(table, F.col("q") != F.col("vec_id")).withColumn("neural", F.round(score.neural_score(F.col("embedding"), F.col("vector")), 5))
    want = score.top_k(pairs.select("q", "vec_id", "neural"), ["q"], 5, "neural", "vec_id").collect()
    got = score.nearest(table, asked, block=20)
    assert sorted(map(tuple, got.select("q", "vec_id", "neural", "rank").collect())) == sorted((r.q, r.vec_id, r.neural, r.rank) for r in want)
    assert "join" not in got._jdf.queryExecution().optimizedPlan().toString().lower()  # pairs are no rows
