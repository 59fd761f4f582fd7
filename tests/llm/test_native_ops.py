"""Sharding, mixing, fingerprints and decontamination against brute force and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import fixtures
from vellum.llm import decontaminate, merkle, mixing, sharding
from vellum.llm.common import feistel, feistel_inverse

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 7, 10, 101, 1000])
def test_feistel_is_a_permutation(spark, n):
    rows = spark.range(n).select("id", feistel(F.col("id"), F.lit(n).cast("long"), F.lit("k")).alias("p"))
    rows = rows.withColumn("back", feistel_inverse(F.col("p"), F.lit(n).cast("long"), F.lit("k"))).collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.back == r.id for r in rows)


def test_sharding_places_every_row_once(spark):
    got = sharding.shard_documents(fixtures.docs(spark), shards=4).collect()
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in fixtures.rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    sizes = Counter(r.shard for r in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and set(sizes) == {0, 1, 2, 3}
    for k, n in sizes.items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(n))
    again = sharding.shard_documents(fixtures.docs(spark).repartition(7), shards=4).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.text_crc32, r.shard, r.slot)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sharding.shard_documents(fixtures.empty(spark)).count() == 0


def test_kept_columns_of_any_type_and_name(spark):
    docs = fixtures.docs(spark).withColumn("tags", F.create_map(F.lit("k"), F.col("lang"))).withColumn("law", F.array(F.struct("n_chars")))
    keep = [c for c in docs.columns if c != "doc_id"]
    got = sharding.shard_documents(docs, shards=4, keep=keep)
    assert len(set(map(str.lower, got.columns))) == len(got.columns) and {"law_", "shard_", "size_", "tags"} <= set(got.columns)
    rows = got.collect()
    assert len(rows) == len(fixtures.rows()) and all(
        r.law == "rows" and r.tags == {"k": r.lang} and r.law_[0].n_chars == r.n_chars for r in rows
    )
    key = lambda rs: sorted((str(r.doc_id), r.text_crc32, str(r.lang), r.shard, r.slot) for r in rs)
    assert key(rows) == key(sharding.shard_documents(docs.repartition(7), shards=4, keep=keep).collect())


def test_shard_and_slot_lead_back_to_the_row(spark):
    got = sharding.shard_documents(fixtures.docs(spark), shards=4)
    n = len(fixtures.rows())
    assert got.filter(sharding.locate(F.col("shard"), F.col("slot"), n, 4) != F.col("row_number")).count() == 0


def water(sizes, weights, most=3):
    """Targets by the rule as it is written: share by weight, stop at the limit, share the excess again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, stopped = float(sum(sizes.values())), {}
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(stopped.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s] + 1e-9]
        if not over:
            return {**stopped, **share}
        for s in over:
            stopped[s] = float(most * sizes[s])


def test_mixing_targets_and_counts(spark):
    got = mixing.mix_counts(fixtures.docs(spark), block=4).collect()
    sizes = Counter()
    for _, t, _, s, *_ in fixtures.rows():
        sizes[s] += len(WORD.findall(t or ""))
    want = water(sizes, mixing.WEIGHTS)
    taken = Counter()
    assert len(got) == len(fixtures.rows())
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, target in want.items():
        assert abs(taken[s] - target) <= 3 * 4, s
    key = lambda rs: sorted(((r.doc_id or -1, r.size, r.taken) for r in rs))
    assert key(got) == key(mixing.mix_counts(fixtures.docs(spark).repartition(5), block=4).collect())
    assert mixing.mix_counts(fixtures.empty(spark)).count() == 0


def test_mixing_targets_when_sources_stop(spark):
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate([("a", 10), ("b", 1000), ("c", 500), (None, 2000), ("d", 3)])]
    sizes = spark.createDataFrame([(s, len(t.split())) for _, t, s in rows], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got == pytest.approx(water({s: len(t.split()) for _, t, s in rows}, mixing.WEIGHTS))


def test_mixed_pieces_agree_with_the_counts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = {r.doc_id: r.taken for r in mixing.mix_counts(docs, block=16).collect()}
    mixed = mixing.mix_documents(docs, block=16, keep=["lang"]).collect()
    words = Counter()
    texts = {r.doc_id: WORD.findall(r.text) for r in docs.select("doc_id", "text").collect()}
    for r in mixed:
        own = r.text.split(" ")
        assert own == texts[r.doc_id][r.from_word : r.from_word + len(own)]
        words[r.doc_id] += len(own)
    assert {k: v for k, v in counts.items() if v} == dict(words)
    kept = mixing.mix_documents(fixtures.docs(spark), block=4, keep=["bucket", "shard", "source"]).collect()
    assert kept and all((r.kept.bucket, r.kept.shard) == (1, 2) and r.kept.source == r.source for r in kept)


def test_repeated_rows_are_mixed_each_for_itself(spark):
    text = " ".join(f"w{i}" for i in range(10))
    docs = spark.createDataFrame([(1, text, "a")] * 40 + [(2, "x y z", "b")] * 5, "doc_id long, text string, source string")
    counts = mixing.mix_counts(docs, block=8).collect()
    mixed = mixing.mix_documents(docs, block=8).collect()
    assert len(counts) == 45 and sum(r.taken for r in counts) == sum(len(r.text.split(" ")) for r in mixed)


def test_shards_draw_their_source_counts():
    import numpy as np

    for n_slots in ([1], [5, 3], [1000, 10, 0, 77], [10**13, 3 * 10**12, 1], list(range(1, 60))):
        n = np.array(n_slots, np.int64)
        by = mixing.dealt(n, 8, 5)
        assert (by >= 0).all() and by.sum(axis=0).tolist() == n_slots
        sizes = by.sum(axis=1)
        assert sizes.max() - sizes.min() <= 1 and (by == mixing.dealt(n, 8, 5)).all()
    by = mixing.dealt(np.array([4000, 2000, 2000], np.int64), 8, 6)
    assert by.std(axis=0).min() > 3  # drawn, not dealt out evenly


LEAF = re.compile(r"[^\n.!?]{1,120}[\n.!?]*|[\n.!?]+")


def leaves(text):
    return [hashlib.md5(p.encode()).hexdigest()[:16] for p in LEAF.findall(text)]


def sections(own):
    out, now = [], []
    for i, leaf in enumerate(own):
        now.append(leaf)
        if leaf[0] == "0" or i == len(own) - 1:
            out.append(hashlib.md5(",".join(now).encode()).hexdigest()[:16])
            now = []
    return out


def print_of(text):
    own = leaves(text)
    return hashlib.md5(",".join(sections(own)).encode()).hexdigest() + ":" + ",".join(own)


def near(a, b):
    x, y = (set(leaves(t)) | {("section", s) for s in sections(leaves(t))} for t in (a, b))
    return 1.0 if not x and not y else 2 * len(x & y) / (len(x) + len(y))


def in_order(rows):
    """Ascending ids, null first; equal ids by the hash of their texts, then texts."""
    signed = lambda t: int.from_bytes(xxhash.xxh64(t.encode(), seed=42).digest(), "big", signed=True)
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]), r[1]))


def test_merkle_against_brute_force(spark):
    rows = in_order([(i, t or "") for i, t, *_ in fixtures.rows()])
    got = sorted(
        merkle.compare_with_edited(fixtures.docs(spark)).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.fingerprint)
    )
    want = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append(
            (i, len(t), hashlib.sha256(edited.encode()).hexdigest(), print_of(t), print_of(edited), near(t, edited), near(t, after))
        )
    want.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[3]))
    assert [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in got] == [w[:5] for w in want]
    for r, w in zip(got, want):
        assert r.near_edited == pytest.approx(w[5]) and r.near_next == pytest.approx(w[6])
    assert merkle.compare_with_edited(fixtures.empty(spark)).count() == 0
    assert "".join(LEAF.findall(fixtures.LONG)) == fixtures.LONG


def test_next_documents_in_clusters_and_repeats(spark, monkeypatch):
    import random

    monkeypatch.setattr(merkle, "STRETCH", 7)
    rng = random.Random(11)
    ids = [rng.randrange(50) for _ in range(60)] + [
        10**15 + rng.randrange(40) for _ in range(60)
    ] + [77] * 80 + [None] * 60 + [-(2**62), 2**62]
    rows = in_order([(i, f"text {k % 90}") for k, i in enumerate(ids)])
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = merkle.with_next(df).collect()
    assert Counter((r.doc_id, r.text, r.next_text) for r in got) == Counter(
        (i, t, rows[(k + 1) % len(rows)][1]) for k, (i, t) in enumerate(rows)
    )


def test_merkle_locates_edits(spark):
    import random

    rng = random.Random(3)
    words = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(6)) + ". "
    before, after, want = [(None, "No id."), (5, None)], [(None, "No id. Now longer."), (5, "New. Text."), (6, "New."), (7, None)], set()
    for i in range(10, 30):
        own = [words() for _ in range(rng.randint(1, 120))]
        new, at = list(own), sorted(rng.sample(range(len(own)), min(len(own), rng.randint(0, 3))), reverse=True)
        for k in at:
            new[k : k + rng.randint(0, 1)] = [words()]  # put in, or put in its place
        before.append((i, "".join(own)))
        after.append((i, "".join(new)))
    for i, t in after:
        old = {x for j, u in before if j == i for x in leaves(u or "")}
        at = 0
        for k, p in enumerate(LEAF.findall(t or "")):
            if hashlib.md5(p.encode()).hexdigest()[:16] not in old:
                want.add((i, k, at, at + len(p)))
            at += len(p)
    table = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = merkle.located_edits(table(before), table(after)).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    twice = merkle.located_edits(table(before), table(after + after)).collect()
    assert sorted(map(str, twice)) == sorted(map(str, got))  # rows that repeat whole are one
    assert merkle.located_edits(table(after), table(after)).count() == 0 and merkle.located_edits(table([]), table([])).count() == 0
    prints = {r.doc_id: r for r in merkle.fingerprint_documents(table(after)).collect()}
    assert all(prints[i].fingerprint == print_of(t or "") for i, t in after)


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()), w


def contained(docs, items):
    out = set()
    for i, t in items:
        own, _ = shingles(t)
        if not own:
            continue
        for d, x in docs:
            _, w = shingles(x)
            k = sum(any(tuple(w[j : j + len(s)]) == s for j in range(len(w))) for s in own)
            if k >= 0.75 * len(own):
                out.add((d, i, k, len(own)))
    return out


def test_decontamination_against_brute_force(spark):
    item = " ".join(f"q{i}" for i in range(24))
    items = [
        (1, item), (2, "one two"), (3, None), (4, ""), (5, "Word7, word8! word9 word10 word11 word12"),
        (6, " ".join(fixtures.LONG.split()[100:130])), (None, "text without an id")
    ]
    most = " ".join(item.split()[:20])
    less = " ".join(item.split()[:15])
    docs = [(i, t) for i, t, *_ in fixtures.rows() if i is not None] + [
        (30, f"before {item} after"), (31, f"a {most} b"), (32, f"a {less} b"), (33, item.upper()), (34, f"{item} {item}")
    ]
    got = decontaminate.contained_items(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    ).collect()
    by_doc = {}
    for d, t in docs:  # equal ids are one document
        by_doc.setdefault(d, []).append(t)
    want = set()
    for d, ts in by_doc.items():
        for t in ts:
            want |= contained([(d, t)], items)
    assert {(r.doc_id, r.item_id) for r in got} == {w[:2] for w in want}
    assert (32, 1) not in {w[:2] for w in want} and (31, 1) in {w[:2] for w in want}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(fixtures.docs(spark), none).count() == 0
    assert decontaminate.contained_items(fixtures.empty(spark), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_decontamination_reports_items_without_an_id(spark):
    item = " ".join(f"q{i}" for i in range(12))
    items = spark.createDataFrame([(None, item), (7, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"a {item} b"), (None, item)], "doc_id long, text string")
    got = decontaminate.contained_items(docs, items).collect()
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in got} == {(d, i, 8, 8) for d in (1, None) for i in (7, None)}
    assert decontaminate.clean_documents(docs, items).count() == 0


def test_decontamination_keeps_clean_documents(spark):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    kept = decontaminate.clean_documents(fixtures.docs(spark), items)
    assert kept.columns == fixtures.docs(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *_ in fixtures.rows() if i not in (8, 9, 20))


def test_decontamination_without_broadcast(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = set(decontaminate.contained_items(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert set(decontaminate.contained_items(docs, items).collect()) == want
