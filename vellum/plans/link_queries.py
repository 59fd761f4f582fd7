"""Retrieval, scoring, ranking and explanation over the star tables taken as a knowledge graph.

Places are nations with their region for a parent; persons for name scores are parts (`red widget`), for dates
and residences customers. The base tables are SQL that both engines run; everything after them is the library's.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions.strings import context, place_text, token_sort_ratio
from vellum.operators import explain, retrieve, score
from vellum.plans.registry import query
from vellum.plans.span_queries import star_sql

YEAR = 1998
MENTIONS = "(SELECT r_regionkey AS doc_id, 'NATION_' || CAST(r_regionkey * 2 AS VARCHAR(9)) AS mention FROM region UNION ALL SELECT r_regionkey, 'NATION_' || CAST(r_regionkey AS VARCHAR(9)) FROM region UNION ALL SELECT r_regionkey, 'nation_1' FROM region)"
PLACES = """(SELECT n_nationkey AS place, n_name AS english, r_name AS parent, n_nationkey % 4 AS kind, n_nationkey % 3 AS past FROM nation JOIN region ON n_regionkey = r_regionkey)"""
#: What a document says: its region by name, a county or town near one mention.
TEXTS = "(SELECT r_regionkey AS doc_id, 'In ' || r_name || ' the ' || CASE WHEN r_regionkey % 2 = 0 THEN 'county' ELSE 'towne' END || ' of NATION_' || CAST(r_regionkey * 2 AS VARCHAR(9)) || ', and far from there, beyond the hills and the wide river which nobody crossed, NATION_' || CAST(r_regionkey AS VARCHAR(9)) || ' and nation_1' AS \"full\", r_name FROM region)"
KIND = {0: ["county"], 1: ["town", "parish"], 2: ["townland"], 3: []}
PAST = {0: ["kg/early-modern-1500-1749/x"], 1: ["kg/modern-1750-1922/y"], 2: []}


def _choice(col: str, values: dict[int, list[str]]):
    out = None
    for k, v in values.items():
        a = F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")
        out = F.when(F.col(col) == k, a) if out is None else out.when(F.col(col) == k, a)
    return out


def place_features(spark, sf_dir):
    """One row a document, mention and candidate with the feature scores and what they come from."""
    mentions = star_sql(spark, sf_dir, f"SELECT DISTINCT doc_id, mention FROM {MENTIONS} m")
    texts = star_sql(spark, sf_dir, f'SELECT doc_id, "full", r_name FROM {TEXTS} t')
    said = mentions.groupBy("doc_id").agg(F.collect_set(F.lower("mention")).alias("_said")).join(texts, "doc_id")
    said = said.select("doc_id", "full", F.array_sort(F.array_union("_said", F.array(F.lower("r_name")))).alias("locations"))
    places = star_sql(spark, sf_dir, f"SELECT * FROM {PLACES} p")
    met = retrieve.retrieve_places(mentions, places, ["doc_id", "mention"], name="english")
    met = met.join(said, "doc_id").withColumns(
        {
            "types": _choice("kind", KIND), "historicalApproximations": _choice("past", PAST), "parentLabels": F.array("parent"),
            "childLabels": F.array().cast("array<string>"), "near": context(F.col("full"), F.col("mention"), 50)
        }
    )
    m, e = F.col("mention"), F.col("english")
    return met.withColumns({
        "name": score.place_name_score(m, e), "hierarchy": score.hierarchy_score(
            m, e, F.col("parentLabels"), F.col("childLabels"), F.col("locations")
        ), "type_match": score.type_score(F.col("near"), F.col("types")),
        "historical": score.historical_score(F.col("historicalApproximations")), "neural": F.lit(0.5)})


def scored_places(spark, sf_dir):
    f = place_features(spark, sf_dir)
    total = score.weighted({c: F.col(c) for c in score.PLACE_WEIGHTS}, score.PLACE_WEIGHTS)
    return f.withColumn("score", F.round(total, 6))


def _norm(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9\\s]', ' ', 'g'), '\\b(the|of|towne|town)\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


#: The scores again in SQL. Names are `nation N`, so the similarity of sorted words is 1 - edits-free share of the digits.
SQL_FEATURES = f"""
mentions AS (SELECT DISTINCT doc_id, mention FROM {MENTIONS} m), texts AS (SELECT * FROM {TEXTS} t), places AS (SELECT * FROM {PLACES} p),
named AS (SELECT doc_id, lower(mention) AS l FROM mentions UNION SELECT doc_id, lower(r_name) FROM texts),
met AS (SELECT m.doc_id, m.mention, p.*, t."full", {_norm('m.mention')} AS mn, {_norm('p.english')} AS en, {_norm('p.parent')} AS pn,
  CASE WHEN instr(lower(t."full"), lower(m.mention)) > 0 THEN substr(lower(t."full"), greatest(instr(lower(t."full"), lower(m.mention)) - 51, 0) + 1,
    least(length(t."full"), instr(lower(t."full"), lower(m.mention)) - 1 + length(m.mention) + 50) - greatest(instr(lower(t."full"), lower(m.mention)) - 51, 0)) ELSE '' END AS near
  FROM mentions m JOIN places p ON contains(lower(p.english), lower(m.mention)) JOIN texts t ON t.doc_id = m.doc_id),
o AS (SELECT m.*, (SELECT list(DISTINCT {_norm('n.l')}) FROM named n WHERE n.doc_id = m.doc_id AND {_norm('n.l')} <> m.mn) AS others FROM met m),
feat AS (SELECT doc_id, mention, place, english, parent, kind, past, near, mn, en,
  CASE WHEN mn = en THEN 1.0 WHEN contains(en, mn) OR contains(mn, en) THEN 0.8 ELSE -1 END AS name,
  CASE WHEN list_contains(others, en) THEN 1.0 ELSE greatest(CASE WHEN mn = en THEN 0.2 ELSE 0 END, CASE WHEN contains(en, mn) OR contains(mn, en) THEN 0.35 ELSE 0 END,
    CASE WHEN 2 * len(list_intersect(string_split(mn, ' '), string_split(en, ' '))) >= len(list_distinct(string_split(mn, ' '))) THEN 0.65 ELSE 0 END,
    CASE WHEN len(list_filter(others, lambda p: contains(en, p) OR contains(p, en))) > 0 THEN 0.7 ELSE 0 END, CASE WHEN list_contains(others, pn) THEN 0.8 ELSE 0 END) END AS hierarchy,
  CASE WHEN kind = 3 THEN 0.3 WHEN contains(near, 'county') THEN CASE WHEN kind = 0 THEN 1.0 ELSE 0.3 END WHEN contains(near, 'town') THEN CASE WHEN kind IN (1, 2) THEN 1.0 ELSE 0.2 END
    WHEN kind = 0 THEN 1.0 WHEN kind = 1 THEN 0.7 ELSE 0.3 END AS type_match,
  CASE past WHEN 0 THEN 1.0 WHEN 1 THEN 0.7 ELSE 0.3 END AS historical FROM o),
scored AS (SELECT *, round(CAST(0.25 * name + 0.25 * hierarchy + 0.18 * type_match + 0.12 * historical + 0.1 AS DOUBLE), 6) AS score FROM feat),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, mention ORDER BY score DESC, place) AS rank FROM scored)
"""
_SQL_CONFIDENCE = "CASE WHEN score > 0.75 THEN 'High confidence' WHEN score >= 0.5 THEN 'Medium Confidence' ELSE 'Low confidence' END"


@query("retrieve_place", f"""
WITH m AS (SELECT DISTINCT doc_id, mention FROM {MENTIONS} m), r AS (SELECT m.doc_id, m.mention, n_nationkey AS place, n_name AS english, row_number() OVER (PARTITION BY doc_id, mention ORDER BY n_nationkey) AS n FROM m JOIN nation ON contains(lower(n_name), lower(mention)))
SELECT doc_id, mention, place, english FROM r WHERE n <= 1000
""")
def retrieve_place(spark, sf_dir):
    mentions = star_sql(spark, sf_dir, f"SELECT DISTINCT doc_id, mention FROM {MENTIONS} m")
    places = star_sql(spark, sf_dir, "SELECT n_nationkey AS place, n_name AS english FROM nation")
    return retrieve.retrieve_places(mentions, places, ["doc_id", "mention"], name="english").select("doc_id", "mention", "place", "english")


@query("retrieve_person", """
WITH m AS (SELECT DISTINCT p_name AS mention FROM part), k AS (SELECT mention, lower(list_extract(string_split(mention, ' '), -1)) AS last FROM m),
r AS (SELECT mention, p_partkey AS person, p_name AS full_name, row_number() OVER (PARTITION BY mention ORDER BY p_partkey) AS n FROM k JOIN part ON contains(lower(p_name), last)) SELECT mention, person, full_name FROM r WHERE n <= 30
""")
def retrieve_person(spark, sf_dir):
    mentions = star_sql(spark, sf_dir, "SELECT DISTINCT p_name AS mention FROM part")
    persons = star_sql(spark, sf_dir, "SELECT p_partkey AS person, p_name AS full_name FROM part")
    return retrieve.retrieve_persons(mentions, persons, ["mention"]).select("mention", "person", "full_name")


@query("retrieve_blocked", """
SELECT lower(substr(c_name, 10)) AS mention, s_suppkey AS supplier FROM customer JOIN supplier ON contains(lower(s_name), lower(substr(c_name, 14)))
""")
def retrieve_blocked(spark, sf_dir):
    """The contains join by 3-gram blocks, as it runs on tables too large to broadcast."""
    mentions = star_sql(spark, sf_dir, "SELECT lower(substr(c_name, 10)) AS mention, substr(c_name, 14) AS tail FROM customer")
    names = star_sql(spark, sf_dir, "SELECT s_suppkey AS supplier, s_name FROM supplier")
    return retrieve.contains_join(mentions, names, "tail", "s_name", blocked=True).select("mention", "supplier")


@query("retrieve_stem", """
SELECT m.c_custkey AS customer, n.c_custkey AS found FROM customer m JOIN customer n ON contains(lower(n.c_name), lower(substr(m.c_name, 2)))
""")
def retrieve_stem(spark, sf_dir):
    """The contains join of keys that all have one stem with names that all have it."""
    mentions = star_sql(spark, sf_dir, "SELECT c_custkey AS customer, substr(c_name, 2) AS tail FROM customer")
    names = star_sql(spark, sf_dir, "SELECT c_custkey AS found, c_name FROM customer")
    return retrieve.contains_join(mentions, names, "tail", "c_name", blocked=True).select("customer", "found")


_PERSON_ROWS = "(SELECT 'kg/person/' || c_name || '/1' AS person, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority || ', ' || o_orderstatus END AS label, 'kg/place/' || n_name || '/x' || CASE WHEN o_orderkey % 2 = 0 THEN '|kg/place/' || n_name || '/y' ELSE '' END AS residences, o_orderkey AS ord FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey)"


@query("enrich_candidates", f"""
WITH r AS (SELECT * FROM {_PERSON_ROWS} z), g AS (SELECT person, arg_min(label, ord) FILTER (WHERE trim(label) <> '') AS label, arg_min(residences, ord) AS residences, any_value(split_part(residences, '/', 3)) AS home FROM r GROUP BY person)
SELECT person, coalesce(trim(split_part(label, ',', 2)) || ' ' || trim(split_part(label, ',', 1)), split_part(person, '/', 3)) AS label, residences, home AS homes FROM g
""")
def enrich_candidates(spark, sf_dir):
    merged = retrieve.merge_persons(star_sql(spark, sf_dir, f"SELECT * FROM {_PERSON_ROWS} z"), [], ["label"])
    return merged.select("person", "label", "residences", F.array_join("residencesLabels", "|").alias("homes"))


@query("group_places", """
SELECT r_name AS place, min(n_name) AS english, array_to_string(list_sort(list_distinct(list(n_name))), ' | ') AS names, array_to_string(list_sort(list_distinct(list(c_mktsegment))), ' | ') AS types FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name
""")
def group_places(spark, sf_dir):
    rows = star_sql(
        spark, sf_dir,
        "SELECT r_name AS place, n_name AS english, n_name AS names, c_mktsegment AS types FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey"
    )
    return retrieve.group_places(rows, single=("english",), many=("names", "types"))


_EDGES = "(SELECT c_name AS child, n_name AS parent FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'WORLD' FROM region UNION SELECT 'WORLD', 'WORLD' FROM region)"


@query("place_closure", f"""
WITH RECURSIVE e AS (SELECT DISTINCT child, parent FROM {_EDGES} z), c AS (SELECT child, parent AS ancestor FROM e UNION SELECT c.child, e.parent FROM c JOIN e ON e.child = c.ancestor) SELECT child, ancestor FROM c
""")
def place_closure(spark, sf_dir):
    return retrieve.transitive_closure(star_sql(spark, sf_dir, f"SELECT DISTINCT child, parent FROM {_EDGES} z"))


@query(
    "score_location",
    f"WITH {SQL_FEATURES} SELECT doc_id, mention, place, CAST(name AS DOUBLE) AS name, CAST(hierarchy AS DOUBLE) AS hierarchy, CAST(type_match AS DOUBLE) AS type_match, CAST(historical AS DOUBLE) AS historical, score FROM scored"
)
def score_location(spark, sf_dir):
    return scored_places(spark, sf_dir).select("doc_id", "mention", "place", "name", "hierarchy", "type_match", "historical", "score")


@query(
    "rank_topk",
    f"WITH {SQL_FEATURES} SELECT doc_id, mention, place, english, score, rank, {_SQL_CONFIDENCE} AS confidence FROM ranked WHERE rank <= 5"
)
def rank_topk(spark, sf_dir):
    top = score.top_k(scored_places(spark, sf_dir), ["doc_id", "mention"], 5, order="place")
    return top.select("doc_id", "mention", "place", "english", "score", "rank", score.confidence(F.col("score")).alias("confidence"))


@query("confidence_buckets", f"WITH {SQL_FEATURES} SELECT {_SQL_CONFIDENCE} AS confidence, count(*) AS n FROM scored GROUP BY 1")
def confidence_buckets(spark, sf_dir):
    return scored_places(spark, sf_dir).groupBy(score.confidence(F.col("score")).alias("confidence")).agg(F.count("*").alias("n"))


@query("explain_scores", f"""
WITH {SQL_FEATURES}, x AS (SELECT *, printf('%s scores %.3f', mention, score + 0.00001) AS a, CASE WHEN name >= 0.95 THEN 'its name is an exact match to the mention' WHEN name >= 0.75 THEN 'its name is a close match to the mention' ELSE 'other' END AS b,
  CASE WHEN instr(lower("full2"), lower(english)) > 0 THEN substr(lower("full2"), greatest(instr(lower("full2"), lower(english)) - 51, 0) + 1, least(length("full2"), instr(lower("full2"), lower(english)) - 1 + length(english) + 50) - greatest(instr(lower("full2"), lower(english)) - 51, 0)) ELSE '' END AS enear,
  CASE kind WHEN 0 THEN 'county' WHEN 1 THEN 'town, parish' WHEN 2 THEN 'townland' END AS kinds FROM (SELECT r.*, t."full" AS full2 FROM ranked r JOIN texts t ON t.doc_id = r.doc_id) y),
y AS (SELECT *, CASE WHEN contains(enear, 'county') THEN 'county' WHEN contains(enear, 'town') THEN 'town' END AS word,
  CASE WHEN hierarchy = 1 THEN 'it is directly mentioned elsewhere in the document' WHEN hierarchy >= 0.75 THEN 'its parent place (' || parent || ') is mentioned in the document' WHEN hierarchy = 0 THEN 'it has no geographic overlap with other locations mentioned in the document' END AS h,
  CASE WHEN historical = 1 THEN 'it has an early-modern historical approximation in KG' WHEN historical >= 0.7 THEN 'it has historical approximation links in KG' ELSE 'it has no historical approximation link' END AS p FROM x),
z AS (SELECT *, CASE WHEN type_match = 1 THEN CASE WHEN word IS NOT NULL THEN 'its type (' || kinds || ') aligns with the document context mentioning ''' || word || '''' END WHEN type_match < 0.5 THEN 'its type (' || coalesce(kinds, 'unknown') || ') does not match the document context' END AS t FROM y)
SELECT doc_id, mention, place, a || ' as ' || array_to_string(list_filter([b, t, h, p], lambda q: q IS NOT NULL), ', ') || ', and its contextual semantic match to the mention is weak.' AS explanation FROM z WHERE rank <= 5
""")
def explain_scores(spark, sf_dir):
    """Scores are shown a hair above their value: engines differ where the third place is a tie."""
    top = score.top_k(scored_places(spark, sf_dir), ["doc_id", "mention"], 5, order="place")
    text = explain.explain_place(
        F.col("mention"), F.col("score") + 0.00001, {k: F.col(k) for k in score.PLACE_WEIGHTS}, {
            "types": F.col("types"), "parentLabels": F.col("parentLabels"), "childLabels": F.col("childLabels")
        },
        F.col("locations"), context(F.col("full"), F.col("english"), 50))
    return top.select("doc_id", "mention", "place", text.alias("explanation"))


def _persons(spark, sf_dir):
    return star_sql(
        spark, sf_dir,
        "SELECT c_custkey AS person, c_name AS label, n_name AS home, r_name AS above, CAST(min(o_orderdate) AS STRING) AS earliest, CAST(max(o_orderdate) AS STRING) AS latest, min(year(o_orderdate)) AS y FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_name, n_name, r_name"
    )


_SQL_FLORUIT = f"CASE WHEN a IS NULL THEN 0.4 WHEN a <= {YEAR} AND {YEAR} <= b THEN 1.0 WHEN greatest(a - {YEAR}, {YEAR} - b) <= 5 THEN 0.8 WHEN greatest(a - {YEAR}, {YEAR} - b) <= 20 THEN 0.6 ELSE 0.1 END"
_SQL_PERSONS = "p AS (SELECT c_custkey AS person, c_name AS label, n_name AS home, r_name AS above, year(min(o_orderdate)) AS a, year(max(o_orderdate)) AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL)"


@query("floruit_score", f"WITH {_SQL_PERSONS} SELECT person, CAST({_SQL_FLORUIT} AS DOUBLE) AS floruit FROM p")
def floruit_score(spark, sf_dir):
    return _persons(spark, sf_dir).select("person", score.floruit_score(F.col("earliest"), F.col("latest"), YEAR).alias("floruit"))


@query(
    "era_bucket",
    "SELECT CASE WHEN y BETWEEN 1500 AND 1749 THEN 'early-modern-1500-1749' WHEN y BETWEEN 1750 AND 1922 THEN 'modern-1750-1922' WHEN y BETWEEN 1923 AND 2100 THEN 'present-day' END AS era, count(*) AS n FROM (SELECT year(o_orderdate) - 120 * (o_orderkey % 5) AS y FROM orders) o GROUP BY 1"
)
def era_bucket(spark, sf_dir):
    y = star_sql(spark, sf_dir, "SELECT year(o_orderdate) - 120 * (o_orderkey % 5) AS y FROM orders")
    return y.groupBy(score.era_of_year(F.col("y")).alias("era")).agg(F.count("*").alias("n"))


@query("score_person", f"""
WITH {_SQL_PERSONS}, m AS (SELECT person, label, CASE person % 3 WHEN 0 THEN label ELSE 'Customer#0' END AS mention, CASE person % 4 WHEN 0 THEN 0.3 WHEN 1 THEN 1.0 ELSE 0.0 END AS era,
  CASE WHEN person % 5 = 0 THEN 0.3 WHEN home IN ('NATION_1', 'NATION_2') THEN 1.0 WHEN above = 'ASIA' THEN 0.75 ELSE 0.0 END AS residence, {_SQL_FLORUIT} AS floruit FROM p)
SELECT person, CAST(CASE WHEN person % 3 = 0 THEN 1.0 ELSE 0.0 END AS DOUBLE) AS name, CAST(era AS DOUBLE) AS era, CAST(residence AS DOUBLE) AS residence, CAST(floruit AS DOUBLE) AS floruit,
  round(CAST(0.32 * CASE WHEN person % 3 = 0 THEN 1.0 ELSE 0.0 END + 0.2 * era + 0.18 * residence + 0.12 * floruit + 0.09 AS DOUBLE), 6) AS score FROM m
""")
def score_person(spark, sf_dir):
    p = _persons(spark, sf_dir)
    locations = F.array(*[F.lit(x) for x in ("nation_1", "nation_2", "asia")])
    none = F.array().cast("array<string>")
    away = F.col("person") % 5 == 0
    f = p.select(
        "person", score.name_score(
            F.when(F.col("person") % 3 == 0, F.col("label")).otherwise(F.lit("Customer#0")), F.col("label")
        ).alias("name"),
        score.era_score(
            "PER", F.when(F.col("person") % 4 == 1, "Early-Modern-1500-1749").when(F.col("person") % 4 == 0, "").otherwise("present-day")
        ).alias("era"),
        score.residence_score(
            locations, F.when(away, none).otherwise(F.array("home")), F.when(away, "").otherwise(F.col("home")),
            F.when(away, none).otherwise(F.array("above"))
        ).alias("residence"),
        score.floruit_score(F.col("earliest"), F.col("latest"), YEAR).alias("floruit"))
    total = score.weighted({**{c: F.col(c) for c in ("name", "era", "residence", "floruit")}, "neural": F.lit(0.5)}, score.PERSON_WEIGHTS)
    return f.withColumn("score", F.round(total, 6))


@query("cosine_rank", """
WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT label AS q, e AS qe FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.q AS q, min(vec_id) AS vec_id, round((list_cosine_similarity(e, qe) + 1) / 2, 5) AS neural FROM v, q WHERE vec_id <> q.q GROUP BY q.q, e, qe),
r AS (SELECT q, vec_id, neural, row_number() OVER (PARTITION BY q ORDER BY neural DESC, vec_id) AS rank FROM s) SELECT q, vec_id, neural, rank FROM r WHERE rank <= 5
""".replace("label AS q", "vec_id AS q"))
def cosine_rank(spark, sf_dir):
    """Every hundredth vector against all others; only the pair of a row with itself is left out."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("q"), F.col("embedding").alias("vector"))
    return score.nearest(v, asked).select("q", "vec_id", "neural", "rank")


@query("semantic_filter", """
WITH p AS (SELECT p_brand AS b, p_partkey AS k, p_name AS c, (p_partkey % 21) / 20.0 AS s FROM part), n AS (SELECT *, 'red widget' AS m, count(*) OVER (PARTITION BY b) AS n FROM p),
h AS (SELECT b, k, n, round_even(CAST(s AS DOUBLE) * 100 * 0.6e0 + (1 - CAST(levenshtein(m, lower(c)) AS DOUBLE) / greatest(length(m), length(c))) * 100 * 0.4e0, 1) AS hybrid FROM n), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY CASE WHEN hybrid < 70 THEN 1 ELSE 0 END, hybrid DESC, k) AS rank FROM h)
SELECT b, k, hybrid FROM r WHERE n <= 10 OR (hybrid >= 70 AND rank <= 8)
""")
def semantic_filter(spark, sf_dir):
    """The filter on the semantic share and the edits; the ratio is tested apart."""
    p = star_sql(
        spark, sf_dir,
        "SELECT p_brand AS b, p_partkey AS k, p_name AS c, 'red widget' AS m, CAST((p_partkey % 21) / 20.0D AS DOUBLE) AS s FROM part"
    )
    return score.semantic_filter(p, ["b"], "s", "m", "c", "k", weights=(0.6, 0.4, 0.0)).select("b", "k", "hybrid")
