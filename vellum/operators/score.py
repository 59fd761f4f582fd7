"""Feature scores of candidates as Column expressions. Arrays of places are compared in place_text() form."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import lexicon as L
from vellum.functions.strings import context, cosine, filled, lit_set, place_text, ratio, token_sort_ratio

YEAR, ERA = 1641, L.EARLY_MODERN
PERSON_WEIGHTS = {"name": 0.32, "era": 0.20, "residence": 0.18, "floruit": 0.12, "neural": 0.18}
PLACE_WEIGHTS = {"name": 0.25, "hierarchy": 0.25, "type_match": 0.18, "historical": 0.12, "neural": 0.20}


def _d(x: float) -> Column:
    return F.lit(float(x))


def weighted(features: dict[str, Column], weights: dict[str, float]) -> Column:
    """Sum of weight * feature in the order of the weights."""
    total = None
    for name, w in weights.items():
        term = _d(w) * features[name]
        total = term if total is None else total + term
    return total


def display_name(label: Column) -> Column:
    """`Surname_Forename_c17` as `forename surname`, lower case: century parts go, the first part moves to the end."""
    low = F.lower(F.trim(label))
    parts = F.filter(F.split(low, "_"), lambda p: (p != "") & ~p.rlike(r"^c\d{1,2}$"))
    moved = F.concat_ws(
        " ", F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), " "), F.try_element_at(parts, F.lit(1))
    )
    return F.when(F.size(parts) >= 2, moved).otherwise(F.replace(low, F.lit("_"), F.lit(" ")))


def name_score(mention: Column, label: Column, similar=ratio, similar_sorted=token_sort_ratio) -> Column:
    """0 unless the last words agree; else .5 last + .35 first + .15 whole, rounded half-even to 3 places."""
    m, n = F.lower(F.trim(F.coalesce(mention, F.lit("")))), display_name(F.coalesce(label, F.lit("")))
    words = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")
    first = lambda c: F.coalesce(F.try_element_at(words(c), F.lit(1)), F.lit(""))
    last = lambda c: F.coalesce(F.try_element_at(words(c), F.lit(-1)), F.lit(""))
    full = _d(0.5) * (similar(last(m), last(n)) / 100) + _d(0.35) * (
        similar(first(m), first(n)) / 100
    ) + _d(0.15) * (similar_sorted(m, n) / 100)
    return F.when(
        (m == "") | (F.trim(F.coalesce(label, F.lit(""))) == ""), _d(0)
    ).when((last(m) != "") & (last(n) != "") & (last(m) != last(n)), _d(0)).otherwise(F.bround(full, 3))


def place_name_score(mention: Column, english: Column, similar_sorted=token_sort_ratio) -> Column:
    m, n = place_text(mention), place_text(english)
    r = similar_sorted(m, n)
    return F.when((m == "") | (n == ""), _d(0)).when(m == n, _d(1)).when(
        F.contains(n, m) | F.contains(m, n), _d(0.8)
    ).when(r >= 85, _d(0.8)).when(r >= 70, _d(0.5)).otherwise(_d(0))


def era_score(label: str, era: Column, document_era: str | None = ERA) -> Column:
    """Unknown .3, equal 1; a place of the present day .4; else 0. Without a document era .5."""
    if not document_era:
        return _d(0.5)
    known = F.when(filled(era).isNull(), _d(0.3)).when(F.lower(era) == document_era, _d(1))
    if label == "LOC" and document_era != L.PRESENT:
        known = known.when(F.lower(era) == L.PRESENT, _d(0.4))
    return known.otherwise(_d(0))


def era_of_year(year: Column) -> Column:
    return F.when(
        year.between(1500, 1749), L.EARLY_MODERN
    ).when(year.between(1750, 1922), L.MODERN).when(year.between(1923, 2100), L.PRESENT)


def residence_score(locations: Column, labels: Column, residences: Column, ancestors: Column) -> Column:
    """Direct match 1, an ancestor .75, none known .3, else 0; .5 where the document names no places."""
    here = F.transform(F.filter(F.coalesce(locations, F.array().cast("array<string>")), lambda x: x != ""), place_text)
    own = F.coalesce(labels, F.array().cast("array<string>"))
    up = F.coalesce(ancestors, F.array().cast("array<string>"))
    return (
        F.when(F.size(F.coalesce(locations, F.array().cast("array<string>"))) == 0, _d(0.5))
        .when((F.size(own) == 0) & filled(F.replace(F.coalesce(residences, F.lit("")), F.lit("|"), F.lit(""))).isNull(), _d(0.3))
        .when(F.arrays_overlap(F.transform(own, place_text), here), _d(1))
        .when(F.arrays_overlap(F.transform(up, place_text), here), _d(0.75))
        .otherwise(_d(0))
    )


def score_candidates(label: Column, person: dict[str, Column], place: dict[str, Column], person_weights=PERSON_WEIGHTS, place_weights=PLACE_WEIGHTS) -> Column:
    """The score of a candidate of any label: persons and places by the features and weights of their own, 0 for another label or none."""
    return F.when(label == "PER", weighted(person, person_weights)).when(label == "LOC", weighted(place, place_weights)).otherwise(_d(0))


def floruit_score(earliest: Column, latest: Column, year: int | None = YEAR) -> Column:
    """Within 1, within 5 years .8, 20 years .6, else .1; missing .4, unreadable .3; .5 without a year."""
    if not year:
        return _d(0.5)
    a, b = (F.trim(F.substring_index(c, "-", 1)).try_cast("int") for c in (earliest, latest))
    y = F.lit(year)
    gap = F.when(y < a, a - y).otherwise(y - b)
    return (
        F.when(
            F.coalesce(earliest, F.lit("")).isin("") | F.coalesce(latest, F.lit("")).isin(""), _d(0.4)
        ).when(a.isNull() | b.isNull(), _d(0.3))
        .when((a <= y) & (y <= b), _d(1)).when(gap <= 5, _d(0.8)).when(gap <= 20, _d(0.6)).otherwise(_d(0.1))
    )


def type_score(near: Column, types: Column) -> Column:
    """near: lower-case text around the mention. The first keyword found decides; without one the types' own weights."""
    kinds = F.lower(F.array_join(F.coalesce(types, F.array().cast("array<string>")), " "))
    has = lambda c, w: F.contains(c, F.lit(w))
    out = F.when(F.size(F.coalesce(types, F.array().cast("array<string>"))) == 0, _d(0.3))
    for words, kind, miss in (
        (("county",), "county", 0.3), (("city", "citty"), "city", 0.2), (("town", "towne"), "town", 0.2), (("parish",), "parish", 0.2),
        (("barony",), "barony", 0.2), (("province", "prouince"), "province", 0.2)
    ):
        found = has(near, words[0])
        for w in words[1:]:
            found = found | has(near, w)
        out = out.when(found, F.when(has(kinds, kind), _d(1)).otherwise(_d(miss)))
    for test, value in (
        (has(kinds, "county") | has(kinds, "province"), 1.0), (has(kinds, "town") & ~has(kinds, "townland"), 0.7),
        (has(kinds, "barony"), 0.6), (has(kinds, "parish"), 0.5), (has(kinds, "townland"), 0.3)
    ):
        out = out.when(test, _d(value))
    return out.otherwise(_d(0.5))


def hierarchy_score(mention: Column, english: Column, parents: Column, children: Column, locations: Column) -> Column:
    """How a place fits the other places that the document names."""
    none = F.array().cast("array<string>")
    m, n = place_text(mention), place_text(english)
    named = F.coalesce(locations, none)
    others = F.array_remove(F.array_distinct(F.transform(named, place_text)), m)
    up, down = F.transform(F.coalesce(parents, none), place_text), F.transform(F.coalesce(children, none), place_text)
    both = (m != "") & (n != "")
    words = lambda c: F.array_distinct(F.split(c, " "))
    steps = [
        F.when(both & (m == n), _d(0.2)), F.when(both & (F.contains(n, m) | F.contains(m, n)), _d(0.35)),
        F.when(both & (F.size(F.array_intersect(words(m), words(n))) * 2 >= F.size(words(m))), _d(0.65)),
        F.when(F.exists(others, lambda p: (p != "") & (F.contains(n, p) | F.contains(p, n))), _d(0.7)),
        F.when(F.arrays_overlap(up, others), _d(0.8)), F.when(F.arrays_overlap(down, others), _d(0.7)),
    ]
    best = F.greatest(_d(0), *[F.coalesce(s, _d(0)) for s in steps])
    provinces = lit_set(L.PROVINCES)
    said, own = F.array_intersect(others, provinces), F.array_intersect(up, provinces)
    ruled = F.when(
        (F.size(said) > 0) & (F.size(own) > 0),
        F.when(F.arrays_overlap(said, own), F.greatest(best, _d(0.95))).otherwise(F.least(best, _d(0.35)))
    ).otherwise(best)
    return F.when(F.size(named) == 0, _d(0.5)).when(F.size(others) == 0, _d(0.5)).when(
        (n != "") & F.array_contains(others, n), _d(1)
    ).otherwise(ruled)


def historical_score(links: Column) -> Column:
    return F.when(F.size(F.coalesce(links, F.array().cast("array<string>"))) == 0, _d(0.3)).when(
        F.exists(links, lambda u: F.contains(F.lower(F.coalesce(u, F.lit(""))), F.lit(f"/{L.EARLY_MODERN}/"))), _d(1)
    ).otherwise(_d(0.7))


def profile_text(label: str, fields: dict[str, Column]) -> Column:
    """Filled fields joined by ` | `; fields that are arrays are joined by a blank first."""
    names = ("label", "eras", "floruitEarliest", "floruitLatest") if label == "PER" else ("english", "irish", "era")
    lists = ("residencesLabels",) if label == "PER" else ("types", "parentLabels", "historicalApproximations")
    parts = [F.nullif(fields[c], F.lit("")) for c in names] + [
        F.nullif(F.array_join(F.filter(fields[c], lambda x: x != ""), " "), F.lit("")) for c in lists
    ]
    return F.concat_ws(" | ", *parts)


def query_text(mention: Column, full_text: Column) -> Column:
    near = context(full_text, mention, 120)
    return F.when(near != "", F.concat(F.trim(mention), F.lit(". context: "), near)).otherwise(F.trim(mention))


def neural_score(a: Column, b: Column) -> Column:
    """(cosine + 1) / 2 within 0..1; .5 where an embedding is missing."""
    c = cosine(a, b)
    return F.when(c.isNull(), _d(0.5)).otherwise(F.least(F.greatest((c + 1) / 2, _d(0)), _d(1)))


#: Vectors and queries that meet in one task, about, and scores that it holds at a time.
PART, BLOCK, AT_ONCE = 10_000, 4_096, 1_000_000
#: Scores are rounded, so what is so little behind the k-th may tie with it.
TIE = 2e-5


def _dense(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, with zeros behind them, and their lengths; -1 for null and for those with a null."""
    values, at = vectors.values, vectors.offsets.to_numpy()
    nulls = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    whole = vectors.is_valid().to_numpy(zero_copy_only=False) & (nulls[at[1:]] == nulls[at[:-1]])
    sizes = np.where(whole, np.diff(at), -1)
    x, flat = np.zeros((len(sizes), dim)), values.to_numpy(zero_copy_only=False)
    for n in np.unique(sizes[sizes > 0]):
        own = np.flatnonzero(sizes == n)
        x[own, :n] = flat[at[own][:, None] + np.arange(n)]
    return x, sizes


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows summed term by term, as cosine() does."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total = total + a[:, d] * b[:, d]
    return total


def _scores(dots: np.ndarray, norms: np.ndarray, alike: np.ndarray) -> np.ndarray:
    """neural_score() of products and norms; alike: whole vectors of one length."""
    s = (dots / norms + 1) / 2
    s = np.where(np.isnan(s), 1.0, np.clip(s, 0.0, 1.0))  # to Spark NaN is greater than any number
    return np.where(alike & (norms != 0), s, 0.5)


def _best(ids: pa.Array, vectors: pa.Array, qs: pa.Array, asked: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query's row, vector's row, score): of each query all that may be among its k best.

    A matrix product tells what is surely behind the k-th; the scores of the rest are made anew, term by term. Of equal scores those of the k smallest ids stay.
    """
    order = pc.sort_indices(ids)
    ids, vectors = ids.take(order), vectors.take(order)
    dim = max(pc.max(pc.list_value_length(c)).as_py() or 0 for c in (vectors, asked))
    (x, nx), (y, ny) = _dense(vectors, dim), _dense(asked, dim)
    known = pc.unique(qs)
    own_x, own_y = (pc.fill_null(pc.index_in(c, known), -1).to_numpy() for c in (ids, qs))
    out = []
    with np.errstate(all="ignore"):
        lx, ly = np.sqrt(_dots(x, x)), np.sqrt(_dots(y, y))
        step = max(1, AT_ONCE // len(x))
        for at in range(0, len(y), step):
            to = slice(at, at + step)
            s = _scores(y[to] @ x.T, ly[to, None] * lx, (ny[to, None] == nx) & (nx >= 0))
            s[own_y[to, None] == own_x] = -1
            kth = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
            q, v = np.nonzero((s >= kth[:, None] - TIE) & (s >= 0))
            q += at
            s = _scores(_dots(x[v], y[q]), ly[q] * lx[v], (ny[q] == nx[v]) & (nx[v] >= 0))
            rank = np.lexsort((v, -s, q))
            q, v, s = q[rank], v[rank], s[rank]
            fresh = np.flatnonzero((np.diff(q, prepend=-1) != 0) | (np.diff(s, prepend=-1) != 0))
            first = np.arange(len(q)) - np.repeat(fresh, np.diff(fresh, append=len(q))) < k
            out.append((q[first], order.to_numpy()[v[first]], s[first]))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK
) -> DataFrame:
    """(q, id, neural, rank): for each of queries(q, vector) the k nearest vectors but itself, ties by id.

    Vectors are dealt in parts of about PART rows and queries in blocks of about `block`; each part meets each block in one task, by matrix products, so what a task
    holds has a bound, and nothing is broadcast. The pairs remain as many as they are.
    """
    parts, blocks = (max(1, -(-rows.count() // most)) for rows, most in ((vectors, PART), (queries, block)))
    kinds = {"q": queries.schema["q"].dataType, "id": vectors.schema[id_col].dataType, "score": T.DoubleType()}
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = vectors.filter(F.col(id_col).isNotNull()).select(
        dealt(id_col, parts).alias("_p"), each(blocks).alias("_b"), F.col(id_col).alias("_id"), F.col(vector_col).cast("array<double>").alias("_x")
    )
    right = queries.filter("q IS NOT NULL").select(
        each(parts).alias("_pq"), dealt("q", blocks).alias("_bq"), F.col("q").alias("_q"), F.col("vector").cast("array<double>").alias("_y")
    )

    def best(own: pa.Table, asked: pa.Table) -> pa.Table:
        ids, x, qs, y = (t.column(c).combine_chunks() for t, c in ((own, "_id"), (own, "_x"), (asked, "_q"), (asked, "_y")))
        q, v, s = _best(ids, x, qs, y, k) if len(ids) and len(qs) else ([], [], [])
        rows = [pa.array(n, pa.int64()) for n in (q, v)]
        return pa.table({"q": qs.take(rows[0]), "id": ids.take(rows[1]), "score": pa.array(s, pa.float64())})

    found = left.groupBy("_p", "_b").cogroup(right.groupBy("_pq", "_bq")).applyInArrow(best, T.StructType([T.StructField(c, t) for c, t in kinds.items()]))
    return top_k(found.select("q", F.col("id").alias(id_col), F.round("score", 5).alias("neural")), ["q"], k, "neural", id_col)


def hashed_ngrams(text: Column, size: int = 64, n: int = 3) -> Column:
    """A stand-in for a model: counts of character n-grams by the first digits of their MD5, native. Null for blank text."""
    low = F.lower(text)
    digits = lambda g: F.conv(F.substring(F.md5(g), 1, 7), 16, 10).cast("long")
    at = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(low) - (n - 1), F.lit(1))),
        lambda i: F.pmod(digits(F.substring(low, i, F.lit(n))), F.lit(size))
    )
    return F.when(
        filled(text).isNotNull(),
        # The array of one array names the grams, so they are made once and not for each k.
        F.transform(F.array(at), lambda a: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda k: (F.size(a) - F.size(F.array_remove(a, k.cast("long")))).cast("double")))[0]
    )


def embed_distinct(frame: DataFrame, text_cols: list[str], embedder=hashed_ngrams) -> DataFrame:
    """frame with an embedding column `<text>_emb` for each text column, each different text embedded once."""
    texts = None
    for c in text_cols:
        own = frame.select(F.col(c).alias("_text"))
        texts = own if texts is None else texts.union(own)
    made = texts.filter(filled(F.col("_text")).isNotNull()).distinct().withColumn("_emb", embedder(F.col("_text")))
    for c in text_cols:
        frame = frame.join(made.select(F.col("_text").alias(c), F.col("_emb").alias(f"{c}_emb")), c, "left")
    return frame


def confidence(score: Column) -> Column:
    return F.when(score > 0.75, "High confidence").when(score >= 0.5, "Medium Confidence").otherwise("Low confidence")


def semantic_filter(
    pairs: DataFrame, by: list[str], semantic: str, mention: str, candidate: str, order: str, weights=(0.5, 0.25, 0.25),
    threshold: float = 70.0, most: int = 8, least: int = 10, similar=ratio
) -> DataFrame:
    """Mentions with `least` candidates or fewer keep them all; others the best `most` by hybrid similarity of threshold or above.

    semantic is a cosine in -1..1; the rest is edit similarity and ratio of the lower-case strings, all in percent.
    """
    a, b = F.lower(F.col(mention)), F.lower(F.col(candidate))
    edit = (1 - F.coalesce(F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), _d(0))) * 100
    hybrid = F.bround(F.col(semantic) * 100 * weights[0] + edit * weights[1] + similar(a, b) * weights[2], 1)
    w = Window.partitionBy(*by)
    scored = pairs.withColumns({"hybrid": hybrid, "_n": F.count("*").over(w)})
    ranked = scored.withColumn("_rank", F.row_number().over(w.orderBy((F.col("hybrid") < threshold), F.desc("hybrid"), order)))
    return ranked.filter((F.col("_n") <= least) | ((F.col("hybrid") >= threshold) & (F.col("_rank") <= most))).drop("_n", "_rank")


def redistribute(base: dict[str, float], target: str, value: float) -> dict[str, float]:
    """Weights with `target` set to value and the rest scaled in proportion, so they sum to 1 again."""
    rest = sum(v for k, v in base.items() if k != target)
    return {k: value if k == target else v * (1 - value) / rest for k, v in base.items()}


def top_k(scored: DataFrame, by: list[str], k: int = 5, score: str = "score", order: str = "ord") -> DataFrame:
    """The k best of each mention with their rank; ties keep the order of retrieval; k=0 keeps all."""
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), order)))
    return ranked.filter(F.col("rank") <= k) if k else ranked
