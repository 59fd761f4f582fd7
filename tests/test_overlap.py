"""Interval joins against brute force, their growth, and what they do with odd rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from vellum.operators import overlap

SCHEMA = "doc_id long, start int, end int, label string"


def made(n, seed, long=0.05):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        start = rng.randrange(3_000)
        size = rng.choice([1, 5, 63, 64, 65, 511, 513, 5_000]) if rng.random() < long else rng.randrange(1, 12)
        out.append((rng.choice([1, 2, None]), start, start + size, rng.choice(["PER", "LOC"])))
    return out + [(1, None, 5, "PER"), (1, 5, None, "PER"), (1, 9, 9, "PER"), (1, -4, 6, "LOC"), (2, 7, 3, "LOC")]


def ok(r):
    return r[0] is not None and r[1] is not None and r[2] is not None and 0 <= r[1] < r[2]


@pytest.mark.parametrize("least", [1, 4])
def test_pairs_by_brute_force(spark, least):
    a, b = made(300, 1), made(300, 2, 0.3)
    got = overlap.overlap_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["doc_id"], least=least)
    want = Counter(
        (x, y, min(x[2], y[2]) - max(x[1], y[1])) for x in a for y in b
        if ok(x) and ok(y) and x[0] == y[0] and min(x[2], y[2]) - max(x[1], y[1]) >= least
    )
    assert Counter((tuple(r.l), tuple(r.r), r.n_shared) for r in got.collect()) == want and want


def test_left_join_keeps_every_row(spark):
    a, b = made(60, 3) * 2, made(40, 4)
    got = overlap.overlap_join(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), ["doc_id", "label"], "left").collect()
    want = Counter()
    for x in a:
        partners = [y for y in b if ok(x) and ok(y) and (x[0], x[3]) == (y[0], y[3]) and x[1] < y[2] and y[1] < x[2]]
        want.update([(x, y, min(x[2], y[2]) - max(x[1], y[1])) for y in partners] or [(x, None, 0)])
    assert Counter((tuple(r.l), tuple(r.r) if r.r else None, r.n_shared) for r in got) == want
    empty = spark.createDataFrame([], SCHEMA)
    assert overlap.overlap_join(empty, empty, ["doc_id"]).collect() == []
    assert overlap.overlap_join(spark.createDataFrame(a, SCHEMA), empty, ["doc_id"], "left").count() == len(a)


def test_columns_may_have_any_names(spark):
    a = spark.createDataFrame([(1, 0, 5, "x", 1, 2)], "doc_id long, start int, end int, `_bucket` string, `_k0` int, l int")
    got = overlap.overlap_join(a, a.withColumnRenamed("l", "n_shared"), ["doc_id"]).first()
    assert got.l._bucket == "x" and got.r.n_shared == 2 and got.n_shared == 5


def test_one_long_document_makes_no_pairs_but_its_own(spark):
    """Spans side by side in one document: the rows that meet follow the number of spans, not its square."""
    def met(n):
        s = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") * 10).cast("int").alias("start"), (F.col("id") * 10 + 8).cast("int").alias("end"), F.lit("PER").alias("label"))
        joined = overlap.overlap_join(s, s, ["doc_id"])
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        listed = s.withColumn("_bucket", F.explode(overlap._buckets(F.col("start"), F.col("end"), overlap.width_for(8))))
        per_bucket = listed.groupBy("_bucket").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
        return joined.count(), per_bucket
    (few, small), (many, large) = met(2_000), met(8_000)
    assert (few, many) == (2_000, 8_000) and large < 4.2 * small


def test_spans_are_listed_three_times_at_most(spark):
    rng = random.Random(5)
    for longest in (5, 300, 100_000):
        rows = [(s, s + rng.choice([1, 3, longest])) for s in (rng.randrange(10_000) for _ in range(500))]
        width = overlap.width_for(sum(e - s for s, e in rows) / len(rows))
        assert sum((e - 1) // width - s // width + 1 for s, e in rows) <= 3 * len(rows)
    assert overlap.width_for(None) == overlap.WIDTH


def test_partial_scores_of_a_small_case(spark):
    gold = spark.createDataFrame([(1, 0, 5, "PER"), (1, 10, 15, "PER"), (1, 20, 25, "LOC"), (1, 0, 5, "PER")], SCHEMA)
    pred = spark.createDataFrame([(1, 0, 5, "PER"), (1, 12, 18, "PER"), (1, 20, 25, "PER"), (2, 0, 5, "LOC")], SCHEMA)
    got = {r.label: r.asDict() for r in overlap.partial_scores(gold, pred, ["doc_id"]).collect()}
    assert (got["PER"]["gold_exact"], got["PER"]["gold_partial"], got["PER"]["missing"], got["PER"]["spurious"]) == (1, 1, 0, 1)
    assert got["PER"]["precision"] == 0.5 and got["PER"]["recall"] == 0.75 and got["LOC"]["recall"] == 0 and got[None]["recall"] == 0.5
    assert overlap.partial_scores(gold.limit(0), pred, ["doc_id"]).filter("label = 'PER'").first().recall == 0


def test_partial_scores_by_brute_force(spark):
    a, b = made(250, 7, 0.2), made(250, 8, 0.2)
    sides = [{r for r in x if r[1] is not None and r[2] is not None and r[1] < r[2] and r[1] >= 0} for x in (a, b)]
    frames = [spark.createDataFrame([r for r in x if r[1] is None or r[1] >= 0], SCHEMA) for x in (a, b)]
    got = {r.label: tuple(r)[1:7] for r in overlap.partial_scores(*frames, ["doc_id"]).collect()}

    def counts(x, y, label):
        out = [0, 0, 0]
        for d, s, e, lab in x:
            if label in (None, lab):
                near = [r for r in y if d is not None and r[0] == d and r[3] == lab and r[1] < e and s < r[2]]
                out[0 if (d, s, e, lab) in near else 1 if near else 2] += 1
        return tuple(out)

    assert got == {label: counts(*sides, label) + counts(*sides[::-1], label) for label in ("PER", "LOC", None)}


def test_coverage_by_brute_force(spark):
    rows = [r for r in made(200, 6) if r[0] is not None]
    got = overlap.coverage(spark.createDataFrame(rows, SCHEMA), ["doc_id"]).collect()
    for r in got:
        own = sorted((a, b) for d, a, b, _ in rows if d == r.doc_id and ok((d, a, b, None)))
        islands, reach = 0, -1
        for a, b in own:
            islands += a > reach
            reach = max(reach, b)
        assert (r.n_spans, r.n_covered, r.n_islands) == (len(own), len({p for a, b in own for p in range(a, b)}), islands)
