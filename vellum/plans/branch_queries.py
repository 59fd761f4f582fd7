"""Rows for every branch of the scores of places, for the requests that stop after tagging, and for the plain engine."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellum.functions import lexicon as L
from vellum.functions.strings import ratio
from vellum.operators import explain, score, tag
from vellum.plans import registry, span_queries
from vellum.plans.durable import shared_folder
from vellum.plans.registry import query
from vellum.plans.span_queries import star_sql
from vellum.plans.text_queries import SQL_CHUNKS, docs, sql_list
from vellum.sources import documents as sources

_ANALYZED = registry._ORACLES["analyze_documents"]
_EVERY = _ANALYZED.replace("z AS (SELECT DISTINCT doc_id", "z AS (SELECT doc_id").replace(
    'd AS (SELECT doc_id, label, text, start, "end", max(score) AS score FROM k GROUP BY ALL)', "d AS (SELECT * FROM k)"
).replace("SELECT doc_id, label, count(*) AS n", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, label, count(*) AS n")


@query("ner_requests", _EVERY)
def ner_requests(spark, sf_dir):
    """Requests for tagging alone, a JSON object a line: what overlapping chunks find twice stays twice."""
    path = f"{shared_folder(spark)}/requests-{uuid.uuid4().hex}"
    docs(spark, sf_dir).select(F.to_json(F.struct("doc_id", "text")).alias("value")).write.text(path)
    found = tag.analyze(sources.read_requests(spark, path), dedupe=False)
    return found.groupBy("doc_id", "label").agg(
        F.count("*").alias("n"), F.sum(F.col("start").cast("long")).alias("sum_start"), F.sum(F.col("end").cast("long")).alias("sum_end"),
        F.countDistinct("text").alias("n_texts"), F.round(F.sum("score"), 3).alias("score")
    )


_PLACES = sql_list(sorted({*L.COUNTIES, *L.PLACE_NAMES}))
_RUN = span_queries._RUN


@query("base_engine", rf"""
WITH RECURSIVE {SQL_CHUNKS.replace("1200", "600").replace("100", "80")},
m AS (SELECT doc_id, no, s, regexp_extract_all(substr(text, s + 1, e - s), '{_RUN}') AS ms, string_split_regex(substr(text, s + 1, e - s), '{_RUN}') AS ps FROM c),
u AS (SELECT doc_id, no, s, unnest(ms) AS t, generate_subscripts(ms, 1) AS i, ps FROM m),
w AS (SELECT doc_id, t, s + sum(length(ps[i])) OVER v + sum(length(t)) OVER v - length(t) AS a FROM u WINDOW v AS (PARTITION BY doc_id, no ORDER BY i)),
l AS (SELECT doc_id, t AS text, CASE WHEN lower(t) IN ({_PLACES}) THEN 'LOC' ELSE 'PER' END AS label, min(a) AS start FROM w GROUP BY doc_id, t)
SELECT doc_id, text, label, CASE WHEN label = 'LOC' THEN 0.95e0 WHEN contains(text, ' ') THEN 0.9e0 ELSE 0.6e0 END AS score, CAST(start AS INT) AS start, CAST(start + length(text) AS INT) AS "end" FROM l
""")
def base_engine(spark, sf_dir):
    """Chunks of 600 characters, and the first span of each text and label."""
    return tag.analyze_base(docs(spark, sf_dir))


#: A mention and a candidate for every case of the name's score, with the score.
NAMES = (("Ballymoney", "Ballymoney", 1.0), ("Bally", "Ballymoney", 0.8), ("Ballymonex", "Ballymoney", 0.8), ("Ballymoxyz", "Ballymoney", 0.5), ("Quirke", "Ballymoney", 0.0), ("The", "Ballymoney", 0.0))
#: Words near a mention, and types of candidates.
NEAR = ("in the county of", "in the citty of", "in the towne of", "in the parish of", "in the barony of", "in the prouince of", "beyond the hills of")
TYPES = (("county",), ("city",), ("town",), ("townland",), ("parish",), ("barony",), ("province",), ())
#: Places that the document names, the candidate's parents and children, and the score of mention Corke and candidate Corkaigh.
FITS = (
    ((), (), (), 0.5), (("corke",), (), (), 0.5), (("corke", "corkaigh"), (), (), 1.0), (("munster shire",), ("Munster Shire",), (), 0.8),
    (("youghal",), (), ("Youghal", "Kinsale"), 0.7), (("munster",), ("Munster",), (), 0.95), (("ulster", "kerry"), ("Munster", "Kerry"), (), 0.35), (("naas",), ("Kerry",), ("Kinsale",), 0.0),
    (("munster shire", "a", "b", "c", "d"), ("Munster Shire",), ("A", "B", "C", "D"), 0.8), (("corkaigh bay",), (), (), 0.7),
)


def _strings(xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def _nth(values, at):
    return F.element_at(F.array(*values), at + 1)


_K = "c_custkey"
_SQL_NAME = "CASE " + " ".join(f"WHEN {_K} % {len(NAMES)} = {i} THEN {s}" for i, (_, _, s) in enumerate(NAMES)) + " END"
_SQL_FIT = "CASE " + " ".join(f"WHEN {_K} % {len(FITS)} = {i} THEN {f[3]}" for i, f in enumerate(FITS)) + " END"
_SQL_TYPE = f"""CASE WHEN {_K} % 8 = 7 THEN 0.3 ELSE CASE ({_K} // 8) % 7 WHEN 0 THEN CASE WHEN {_K} % 8 = 0 THEN 1.0 ELSE 0.3 END WHEN 1 THEN CASE WHEN {_K} % 8 = 1 THEN 1.0 ELSE 0.2 END
  WHEN 2 THEN CASE WHEN {_K} % 8 IN (2, 3) THEN 1.0 ELSE 0.2 END WHEN 3 THEN CASE WHEN {_K} % 8 = 4 THEN 1.0 ELSE 0.2 END WHEN 4 THEN CASE WHEN {_K} % 8 = 5 THEN 1.0 ELSE 0.2 END
  WHEN 5 THEN CASE WHEN {_K} % 8 = 6 THEN 1.0 ELSE 0.2 END ELSE CASE {_K} % 8 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.7 WHEN 3 THEN 0.3 WHEN 4 THEN 0.5 WHEN 5 THEN 0.6 ELSE 1.0 END END END"""


def _branches(spark, sf_dir):
    k = F.col(_K)
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        _K, *[_nth([F.lit(n[i]) for n in NAMES], (k % len(NAMES)).cast("int")).alias(c) for i, c in ((0, "mention"), (1, "english"))],
        _nth([F.lit(x) for x in NEAR], (F.floor(k / 8) % 7).cast("int")).alias("near"), _nth([_strings(x) for x in TYPES], (k % 8).cast("int")).alias("types"),
        *[_nth([_strings(f[i]) for f in FITS], (k % len(FITS)).cast("int")).alias(c) for i, c in ((0, "locations"), (1, "parentLabels"), (2, "childLabels"))]
    )


@query("place_branches", f"SELECT {_K} AS k, CAST({_SQL_NAME} AS DOUBLE) AS name, CAST({_SQL_TYPE} AS DOUBLE) AS type_match, CAST({_SQL_FIT} AS DOUBLE) AS hierarchy FROM customer")
def place_branches(spark, sf_dir):
    """Every case of the scores of a place's name, type and place in the hierarchy, provinces and children among them."""
    return _branches(spark, sf_dir).select(
        F.col(_K).alias("k"), score.place_name_score(F.col("mention"), F.col("english")).alias("name"), score.type_score(F.col("near"), F.col("types")).alias("type_match"),
        score.hierarchy_score(F.lit("Corke"), F.lit("Corkaigh"), F.col("parentLabels"), F.col("childLabels"), F.col("locations")).alias("hierarchy")
    )


@query("explain_children", f"""
SELECT {_K} AS k, CASE WHEN {_K} % {len(FITS)} = 8 THEN 'A, B, C' END AS children, {_K} % {len(FITS)} IN (3, 8) AS parent, {_K} % {len(FITS)} = 2 AS named FROM customer
""")
def explain_children(spark, sf_dir):
    """Explanations of places: three named children at most, the parent, and the place itself where the document names it."""
    b = _branches(spark, sf_dir)
    none = F.lit(None).cast("double")
    fit = score.hierarchy_score(F.lit("Corke"), F.lit("Corkaigh"), F.col("parentLabels"), F.col("childLabels"), F.col("locations"))
    b = b.withColumn("hierarchy", fit)
    said = explain.explain_place(
        F.lit("Corkaigh"), F.lit(0.8), {"name": none, "hierarchy": F.col("hierarchy"), "type_match": none, "historical": none, "neural": none},
        {c: F.col(c) for c in ("types", "parentLabels", "childLabels")}, F.col("locations"), F.col("near")
    )
    return b.withColumn("said", said).select(
        F.col(_K).alias("k"), F.nullif(F.regexp_extract("said", "child places include (.*?), which are mentioned", 1), F.lit("")).alias("children"),
        F.contains("said", F.lit("its parent place (Munster Shire) is mentioned")).alias("parent"), F.contains("said", F.lit("directly mentioned elsewhere")).alias("named")
    )


#: Weights of the features, as they are published.
_PER, _LOC = score.PERSON_WEIGHTS, score.PLACE_WEIGHTS


@query("score_labels", f"""
SELECT {_K} AS k, label, CASE label WHEN 'PER' THEN round(0.32 * (({_K} % 11) / 10.0) + 0.68 * (({_K} % 7) / 10.0), 6) WHEN 'LOC' THEN round(0.25 * (({_K} % 11) / 10.0) + 0.75 * (({_K} % 7) / 10.0), 6) ELSE 0.0 END AS score
FROM (SELECT {_K}, CASE {_K} % 4 WHEN 0 THEN 'PER' WHEN 1 THEN 'LOC' WHEN 2 THEN 'ORG' END AS label FROM customer) z
""")
def score_labels(spark, sf_dir):
    """Candidates of any label scored in one call: one feature of each kind of its own, all others alike."""
    k = F.col(_K)
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select(_K, F.when(k % 4 == 0, "PER").when(k % 4 == 1, "LOC").when(k % 4 == 2, "ORG").alias("label"))
    feature = lambda weights: {c: ((k % 11) / 10 if c == "name" else (k % 7) / 10).cast("double") for c in weights}
    total = score.score_candidates(F.col("label"), feature(_PER), feature(_LOC))
    return rows.select(k.alias("k"), "label", F.round(total, 6).alias("score"))


#: A candidate's name by its key: edits from `ballymoney`, which are the parts of the ratio that are missing too.
_VARIANTS = ("ballymoney", "ballymonex", "ballymoxxz", "qqqqqqqqqq")
_ALIKE = (100, 90, 70, 0)


@query("semantic_live", f"""
WITH p AS (SELECT o_custkey AS b, o_orderkey AS k, (o_orderkey % 11) * 5.0 + 0.5 * CASE o_orderkey % 4 {" ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_ALIKE))} END AS hybrid, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY CASE WHEN hybrid < 70 THEN 1 ELSE 0 END, hybrid DESC, k) AS rank FROM p)
SELECT b, k, CAST(hybrid AS DOUBLE) AS hybrid FROM r WHERE n <= 10 OR (hybrid >= 70 AND rank <= 8)
""")
def semantic_live(spark, sf_dir):
    """The semantic filter with its own weights: cosine, edits and ratio."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    pairs = o.select(
        F.col("o_custkey").alias("b"), F.col("o_orderkey").alias("k"), F.lit("Ballymoney").alias("m"), _nth([F.lit(v) for v in _VARIANTS], (F.col("o_orderkey") % 4).cast("int")).alias("c"),
        ((F.col("o_orderkey") % 11) / 10).alias("s")
    )
    return score.semantic_filter(pairs, ["b"], "s", "m", "c", "k", similar=ratio).select("b", "k", "hybrid")
