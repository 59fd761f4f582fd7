"""As-of join, sketches, variants and the SQL functions against plain versions."""

import json
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vellum import sql
from vellum.operators import asof, sketches, variants
from vellum.operators.chunk import chunk_offsets

BASE = datetime(2024, 5, 1)
LEFT, RIGHT = "id long, k long, ts timestamp, r string", "k long, at timestamp, v int, `_t` string"


def made(seed, n=300, m=120):
    rng = random.Random(seed)
    time = lambda: BASE + timedelta(seconds=rng.randrange(500)) if rng.random() > 0.05 else None
    key = lambda: rng.choice([1, 1, 1, 1, 2, 3, None])
    return [(i, key(), time(), "x") for i in range(n)] + [(0, 1, BASE, "x")] * 2, [(key(), time(), v, "y") for v in range(m)] + [(1, BASE + timedelta(seconds=9), 3, None)]


def joined(left, right, tolerance, strict):
    out = Counter()
    for row in left:
        _, k, t, _ = row
        before = [r for r in right if k is not None and t is not None and r[0] == k and r[1] is not None and (r[1] < t or (r[1] == t and not strict))]
        best = max(before, key=lambda r: (r[1], r[2]), default=None)
        if best and tolerance is not None and t - best[1] > timedelta(seconds=tolerance):
            best = None
        out[row, best[:3] if best else None] += 1
    return out


@pytest.mark.parametrize("hot", [50_000, 7])
@pytest.mark.parametrize("tolerance, strict", [(None, False), (20, True), (0, False)])
def test_asof_by_brute_force(spark, monkeypatch, hot, tolerance, strict):
    monkeypatch.setattr(asof, "HOT", hot)
    left, right = made(hot)
    got = asof.asof_join(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["k"], "ts", "at", ["v"], tolerance, strict)
    assert got.columns == ["l", "r"]
    assert Counter((tuple(x.l), tuple(x.r)[:3] if x.r else None) for x in got.collect()) == joined(left, right, tolerance, strict)


def test_asof_of_empty_tables(spark):
    left, right = (spark.createDataFrame(x, s) for x, s in zip(made(1), (LEFT, RIGHT)))
    assert asof.asof_join(left.limit(0), right, ["k"], "ts", "at").collect() == []
    assert [x.r for x in asof.asof_join(left, right.limit(0), ["k"], "ts", "at").collect()] == [None] * left.count()


def test_a_hot_key_is_dealt_over_slices(spark, monkeypatch):
    monkeypatch.setattr(asof, "HOT", 100)
    seen = []
    plain = asof._filled
    monkeypatch.setattr(asof, "_filled", lambda rows, *a: seen.append(rows) or plain(rows, *a))
    rows = spark.range(5_000).select("id", F.lit(1).cast("long").alias("k"), F.timestamp_seconds(F.col("id")).alias("ts"))
    asof.asof_join(rows, rows, ["k"], "ts", "ts").collect()
    sizes = [r["count"] for r in seen[0].groupBy("_slice").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 800


def test_sketches_merge_and_keep_their_bounds(spark):
    rows = spark.range(60_000).select(F.pmod("id", F.lit(7)).alias("a"), F.pmod("id", F.lit(3)).alias("b"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("user"), F.rand(3).alias("x"))
    rows = rows.unionByName(spark.createDataFrame([(99, 0, None, None)], "a long, b long, user long, x double"))
    fine = sketches.sketch(rows, ["a", "b"], "user", "x")
    for by in (["a"], []):
        up = sketches.merged(fine, by).select(*by, "n", sketches.distinct_estimate(F.col("users")).alias("u"), sketches.quantile(F.col("spread"), 0.9).alias("q"))
        exact = rows.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct("user").alias("u"), F.percentile("x", 0.9).alias("q"))
        want = {tuple(r[c] for c in by): r for r in exact.collect()}
        for r in up.collect():
            w = want.pop(tuple(r[c] for c in by))
            assert r.n == w.n and abs(r.u - w.u) <= max(1, w.u * sketches.DISTINCT_ERROR)
            assert (r.q is None and w.q is None) or abs(r.q - w.q) < 2 * sketches.RANK_ERROR  # values are ranks here
        assert not want


def test_variants_of_any_shape(spark):
    texts = ['{"k": 1, "s": "a"}', '{"k": 2, "deep": {"x": 1}}', '{"k": "three"}', "no json", None, "[1, 2]", "{}", '{"odd \'name": true}', '{"k": null}']
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, props string").repartition(3)
    v = variants.parsed(rows, "props")
    assert v.filter("v IS NULL").count() == 2
    only = v.filter("id IN (0, 1, 6, 7)")
    flat = variants.flatten(only, "v", "p_")
    assert set(flat.columns) == {"id", "props", "v", "p_k", "p_s", "p_deep", "p_odd 'name"}
    assert {r.id: (r.p_k, r.p_s, r["p_odd 'name"]) for r in flat.collect()} == {0: (1, "a", None), 1: (2, None, None), 6: (None, None, None), 7: (None, None, True)}
    assert variants.flatten(v, "v").columns == v.columns  # objects and an array have no fields in common
    got = {r["key"]: (r.n, r.types, r.total) for r in variants.fields_of(v.filter("id <> 5"), "v", []).collect() if r["key"]}
    assert got["k"][0] == 4 and got["k"][2] == 3 and "STRING" in got["k"][1] and got["deep"][0] == 1


def test_functions_in_sql(spark):
    sql.register(spark)
    sql.register(spark)  # again, as another query of the session may do
    long = "One sentence of Corke. " * 200
    spark.createDataFrame([(1, long), (2, None), (3, ""), (None, "John Kelly")], "id long, t string").createOrReplaceTempView("sql_docs")
    got = spark.sql("SELECT * FROM vellum_chunks(TABLE(SELECT id, t FROM sql_docs))").collect()
    want = [(1, i, a, long[a:b]) for i, (a, b) in enumerate(chunk_offsets(long))] + [(None, 0, 0, "John Kelly")]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    tags = spark.sql("SELECT * FROM vellum_tags(TABLE(SELECT id, t FROM sql_docs)) WHERE doc_id IS NULL").collect()
    assert [tuple(r) for r in tags] == [(None, "John Kelly", "PER", 0, 10)]
    whole = spark.sql("SELECT doc_id, count(*) AS n, sum(length(token)) AS chars FROM vellum_tokens(TABLE(SELECT id, t FROM sql_docs)) GROUP BY doc_id").collect()
    assert {r.doc_id: r.chars for r in whole} == {1: len(long), None: 10}
    assert spark.sql("SELECT vellum_ratio('Corke', 'Cork') AS a, vellum_token_sort_ratio('Kelly, John', 'john kelly') AS b, vellum_ratio(NULL, 'x') AS c").first() == (89.0, 100.0, None)
    assert spark.sql("SELECT * FROM vellum_tags(TABLE(SELECT id, t FROM sql_docs WHERE false))").collect() == []
    assert json.loads(spark.sql("SELECT to_json(collect_list(label)) AS j FROM vellum_tags(TABLE(SELECT 1, 'Cork'))").first().j) == ["LOC"]
