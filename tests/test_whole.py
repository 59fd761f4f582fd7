"""Registered queries on small tables that reach past the ids they once stopped at, against brute force."""

import difflib
import math
import random

import pytest

from vellum.operators import retrieve
from vellum.plans import registry


@pytest.fixture
def run(spark, tmp_path):
    """run(query, table=(rows, schema), ...): the query's rows over these tables."""

    def go(query, **tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
        return registry.queries()[query](spark, str(tmp_path)).collect()

    return go


def test_retrieve_blocked_looks_up_every_customer(run):
    customers = [(i, f"Customer#{i:09d}") for i in (1, 2, 12, 399, 400, 401, 402, 1500, 15000)]
    suppliers = [(i, f"Supplier#{i:09d}") for i in (1, 12, 401, 402, 1500, 99999)]
    got = run(
        "retrieve_blocked", customer=(customers, "c_custkey long, c_name string"), supplier=(suppliers, "s_suppkey long, s_name string")
    )
    want = [(c[9:].lower(), k) for _, c in customers for k, s in suppliers if c[13:].lower() in s.lower()]
    assert sorted((r.mention, r.supplier) for r in got) == sorted(want) and {"000000401", "000001500"} <= {m for m, _ in want}


def test_semantic_filter_takes_the_whole_table(run):
    parts = [(k, f"brand{k % 3}" if k <= 900 else "late", "red widget") for k in range(1, 908)]
    got = run("semantic_filter", part=(parts, "p_partkey long, p_brand string, p_name string"))
    want = []
    for b in ("brand0", "brand1", "brand2", "late"):
        group = sorted((-round(0.6 * (k % 21) * 5 + 0.4 * 100, 1), k) for k, x, _ in parts if x == b)  # no edits: 100 percent
        want += [(b, k, -h) for h, k in (group if len(group) <= 10 else [x for x in group if x[0] <= -70][:8])]
    assert sorted((r.b, r.k, r.hybrid) for r in got) == sorted(want) and max(k for _, k, _ in want) == 907


def test_every_part_name_is_retrieved_and_ranked(run):
    names = ["red widget", "old widget", "Widget", "blue gear", "pale gearbox", "x"]
    parts = [(k, names[k % 4] if k <= 200 else names[4 + k % 2]) for k in range(1, 210)]
    table = {"part": (parts, "p_partkey long, p_name string")}
    met = {m: sorted((k, n) for k, n in parts if m.split()[-1].lower() in n.lower()) for m in names}
    got = run("retrieve_person", **table)
    assert sorted((r.mention, r.person, r.full_name) for r in got) == sorted((m, k, n) for m in names for k, n in met[m][:30])

    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    order = lambda s: " ".join(sorted(s.split()))
    by_hand = lambda a, b: round(0.5 * (a == b) + 0.3 * ratio(a, b) + 0.2 * ratio(order(a), order(b)), 6)
    want = []
    for m in names:
        best = sorted((-by_hand(m.lower(), n.lower()), k) for k, n in met[m])[:5]
        want += [(m, k, -s, i + 1) for i, (s, k) in enumerate(best)]
    assert sorted(
        (r.mention, r.k, r.score, r.rank) for r in run("baseline_rank", **table)
    ) == [(m, k, pytest.approx(s), i) for m, k, s, i in sorted(want)]


def test_cosine_rank_asks_every_hundredth_vector(run):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(302)]
    rows[3] = (3, list(rows[0][1]))
    got = run("cosine_rank", embeddings=(rows, "vec_id long, embedding array<float>"))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
    want = []
    for q in (0, 100, 200, 300):
        best = sorted((-(cos(e, rows[q][1]) + 1) / 2, i) for i, e in rows if i != q)[:5]
        want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted((r.q, r["rank"], r.vec_id, r.neural) for r in got) == [
        (q, k, i, pytest.approx(s, abs=1e-4)) for q, k, i, s in sorted(want)
    ]
    assert {r.vec_id for r in got if r.q == 0} & {3}


def test_xml_paragraphs_keeps_markup_characters(run):
    texts = ["a < b & c > d\n\n&amp; stays &lt;p&gt;", "<p>x</p>\n  <!-- y -->", "]]> & <![CDATA[z]]>", "plain\ntext", "&"]
    got = run("xml_paragraphs", documents=(list(enumerate(texts)), "doc_id long, text string"))
    lines = [[x for x in t.split("\n") if x.strip()] for t in texts]
    assert sorted((r.doc_id, r.n_paragraphs, r.text) for r in got) == [(i, len(x), "\n".join(x)) for i, x in enumerate(lines)]


def test_retrieve_place_keeps_all_candidates(run):
    nations = [(i, f"NATION_{i}", i % 5) for i in range(25)]
    regions = [(i, f"R{i}") for i in range(5)]
    got = run(
        "retrieve_place", nation=(nations, "n_nationkey long, n_name string, n_regionkey long"),
        region=(regions, "r_regionkey long, r_name string")
    )
    of_one = sorted(r.place for r in got if r.doc_id == 0 and r.mention == "nation_1")
    assert of_one == [1, *range(10, 20)]


def test_small_place_limit(spark):
    places = spark.createDataFrame([(f"u{i}", "Cork") for i in range(9)], "place string, name string")
    mentions = spark.createDataFrame([("cork",)], "mention string")
    assert sorted(r.place for r in retrieve.retrieve_places(mentions, places, ["mention"], most=7).collect()) == [f"u{i}" for i in range(7)]
    assert retrieve.retrieve_places(mentions, places, ["mention"]).count() == 9
