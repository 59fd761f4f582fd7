"""Evaluation queries: span scores, ranking and retrieval metrics, weight sweep, baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions.strings import sequence_ratio
from vellum.operators import evaluate, retrieve, score
from vellum.plans.link_queries import SQL_FEATURES, scored_places
from vellum.plans.registry import query
from vellum.plans.span_queries import SQL_SPANS, star_sql, tagged

_SQL_PRED = f"""{SQL_SPANS},
gold AS (SELECT DISTINCT doc_id, start, "end", label FROM spans WHERE length(text) > 3),
pred AS (SELECT DISTINCT doc_id, CASE WHEN start % 7 = 0 THEN start + 1 ELSE start END AS start, "end", CASE WHEN start % 11 = 0 THEN 'LOC' ELSE label END AS label FROM spans WHERE score >= 0.6 AND start % 5 <> 0 AND length(text) > 2),
j AS (SELECT coalesce(g.doc_id, p.doc_id) AS doc_id, g.doc_id IS NOT NULL AS g, p.doc_id IS NOT NULL AS p FROM gold g FULL OUTER JOIN pred p ON g.doc_id = p.doc_id AND g.start = p.start AND g."end" = p."end" AND g.label = p.label)"""


def _sides(spark, sf_dir):
    s = tagged(spark, sf_dir)
    gold = s.filter(F.length("text") > 3)
    pred = s.filter((F.col("score") >= 0.6) & (F.col("start") % 5 != 0) & (F.length("text") > 2))
    pred = pred.withColumns(
        {
            "label": F.when(F.col("start") % 11 == 0, "LOC").otherwise(F.col("label")),
            "start": F.when(F.col("start") % 7 == 0, F.col("start") + 1).otherwise(F.col("start"))
        }
    )
    return gold, pred


@query("span_prf", f"""
WITH {_SQL_PRED}, c AS (SELECT doc_id, count(*) FILTER (WHERE g) AS gold_count, count(*) FILTER (WHERE p) AS pred_count, count(*) FILTER (WHERE g AND p) AS tp_count, count(*) FILTER (WHERE NOT g) AS fp_count, count(*) FILTER (WHERE NOT p) AS fn_count FROM j GROUP BY GROUPING SETS ((doc_id), ())),
r AS (SELECT *, CASE WHEN pred_count = 0 THEN 0.0 ELSE tp_count / pred_count END AS precision, CASE WHEN gold_count = 0 THEN 0.0 ELSE tp_count / gold_count END AS recall FROM c)
SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r
""")
def span_prf(spark, sf_dir):
    return evaluate.span_scores(*_sides(spark, sf_dir), ["doc_id"])


@query("span_difference", f"""
WITH {_SQL_PRED}, d AS (SELECT * FROM (SELECT doc_id, start, "end", label FROM gold EXCEPT SELECT * FROM pred) a, (SELECT 'a' AS side) s UNION ALL SELECT * FROM (SELECT * FROM pred EXCEPT SELECT doc_id, start, "end", label FROM gold) b, (SELECT 'b' AS side) s)
SELECT doc_id, side, count(*) AS n, CAST(sum(start) AS BIGINT) AS sum_start FROM d GROUP BY doc_id, side
""")
def span_difference(spark, sf_dir):
    return evaluate.span_difference(*_sides(spark, sf_dir), ["doc_id"]).groupBy("doc_id", "side").agg(
        F.count("*").alias("n"), F.sum(F.col("start").cast("long")).alias("sum_start")
    )


#: The gold place of a mention: the nation with that very number, in mixed case for some mentions a wrong one.
_GOLD = "CASE WHEN substr(mention, 1, 1) = 'n' THEN 10 ELSE CAST(substr(mention, 8) AS INT) END"
_SQL_LISTS = f"""{SQL_FEATURES}, lists AS (SELECT doc_id, mention, 'LOC' AS label, any_value({_GOLD}) AS gold, list(place ORDER BY rank) FILTER (WHERE rank <= 5) AS uris FROM ranked GROUP BY doc_id, mention),
m AS (SELECT *, CASE WHEN list_contains(uris, gold) THEN 1.0 / list_position(uris, gold) ELSE 0 END AS rr, CAST(list_contains(list_slice(uris, 1, 1), gold) AS INT) AS h1, CAST(list_contains(list_slice(uris, 1, 3), gold) AS INT) AS h3, CAST(list_contains(uris, gold) AS INT) AS h5, len(uris) AS n_c FROM lists)"""


def _metrics(spark, sf_dir):
    top = score.top_k(scored_places(spark, sf_dir), ["doc_id", "mention"], 5, order="place")
    lists = evaluate.ranked_uris(top, ["doc_id", "mention"], "place").withColumns(
        {
            "label": F.lit("LOC"), "ranked_uris": F.transform("ranked_uris", lambda x: x.cast("string")),
            "gold_uri": F.expr(_GOLD).cast("string")
        }
    )
    return evaluate.mention_metrics(lists)


@query(
    "eval_ranking",
    f"WITH {_SQL_LISTS} SELECT label, count(*) AS n, avg(h5) AS coverage, avg(h1) AS acc_1, avg(rr) AS mrr, avg(h1) AS recall_1, avg(h3) AS recall_3, avg(h5) AS recall_5 FROM m GROUP BY GROUPING SETS ((label), ())"
)
def eval_ranking(spark, sf_dir):
    return evaluate.ranking_summary(_metrics(spark, sf_dir))


@query(
    "retrieval_coverage",
    f"WITH {_SQL_LISTS} SELECT label, count(*) AS n, avg(h5) AS set_recall, avg(n_c) AS avg_candidates, coalesce(avg(n_c) FILTER (WHERE h5 = 1), 0) AS avg_when_hit, coalesce(avg(n_c) FILTER (WHERE h5 = 0), 0) AS avg_when_miss FROM m GROUP BY GROUPING SETS ((label), ())"
)
def retrieval_coverage(spark, sf_dir):
    return evaluate.retrieval_summary(_metrics(spark, sf_dir))


_FEATURES = ("name", "hierarchy", "type_match", "historical", "neural")
#: The configurations as they are published: of each label a feature and the weights that it is given. Those of persons leave places' weights alone.
_CONFIGS = """SELECT config, CASE WHEN feature = 'name' THEN w ELSE 0.25e0 * f END AS w1, CASE WHEN feature = 'hierarchy' THEN w ELSE 0.25e0 * f END AS w2, 0.18e0 * f AS w3, 0.12e0 * f AS w4, 0.20e0 * f AS w5 FROM (
  SELECT config, CASE WHEN config LIKE 'LOC%' THEN split_part(split_part(config, ' ', 2), '=', 1) ELSE '' END AS feature, CAST(split_part(config, '=', 2) AS DOUBLE) AS w, CASE WHEN config LIKE 'LOC%' THEN (1 - CAST(split_part(config, '=', 2) AS DOUBLE)) / 0.75e0 ELSE 1e0 END AS f FROM (VALUES
  ('PER name=0.20'), ('PER name=0.25'), ('PER name=0.32'), ('PER name=0.38'), ('PER name=0.44'), ('PER era=0.10'), ('PER era=0.15'), ('PER era=0.20'), ('PER era=0.25'), ('PER era=0.30'),
  ('LOC hierarchy=0.15'), ('LOC hierarchy=0.20'), ('LOC hierarchy=0.25'), ('LOC hierarchy=0.30'), ('LOC hierarchy=0.35'), ('LOC name=0.15'), ('LOC name=0.20'), ('LOC name=0.25'), ('LOC name=0.30'), ('LOC name=0.35')) v(config)) w"""


@query("weight_sweep", f"""
WITH {SQL_FEATURES}, cfg AS ({_CONFIGS}),
s AS (SELECT config, doc_id, mention, place, row_number() OVER (PARTITION BY config, doc_id, mention ORDER BY round(name * w1 + hierarchy * w2 + type_match * w3 + historical * w4 + 0.5 * w5, 9) DESC, place) AS rank FROM feat, cfg),
l AS (SELECT config, doc_id, mention, 'LOC' AS label, any_value({_GOLD}) AS gold, list(place ORDER BY rank) FILTER (WHERE rank <= 5) AS uris FROM s GROUP BY config, doc_id, mention),
m AS (SELECT *, CASE WHEN list_contains(uris, gold) THEN 1.0 / list_position(uris, gold) ELSE 0 END AS rr, CAST(list_contains(list_slice(uris, 1, 1), gold) AS INT) AS h1, CAST(list_contains(list_slice(uris, 1, 3), gold) AS INT) AS h3 FROM l)
SELECT config, label, count(*) AS n, avg(h1) AS acc_1, avg(rr) AS mrr, avg(h3) AS recall_3 FROM m GROUP BY GROUPING SETS ((config, label), (config))
""")
def weight_sweep(spark, sf_dir):
    f = scored_places(spark, sf_dir)
    feats = f.select(
        "doc_id", "mention", F.lit("LOC").alias("label"), F.expr(_GOLD).cast("string").alias("gold_uri"),
        F.col("place").cast("string").alias("uri"), F.col("place").alias("ord"),
        F.create_map(*[x for k in _FEATURES for x in (F.lit(k), F.col(k).cast("double"))]).alias("features")
    )
    return evaluate.weight_sweep(feats, ["doc_id", "mention"])


#: The best matching block of a[alo:ahi] and b[blo:bhi] as one number: its length, then the earlier place in a, then in b.
_SQL_BLOCK = """coalesce(list_max(flatten(list_transform(range(alo, ahi), lambda i: list_transform(range(blo, bhi), lambda j:
  1000000 * len(list_filter(range(1, least(ahi - i, bhi - j) + 1), lambda l: substr(a, CAST(i + 1 AS BIGINT), CAST(l AS BIGINT)) = substr(b, CAST(j + 1 AS BIGINT), CAST(l AS BIGINT)))) + 1000 * (999 - i) + 999 - j)))), 0)"""


def _sql_words(c: str) -> str:
    return f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"


@query("baseline_rank", f"""
WITH RECURSIVE parts AS (SELECT p_partkey AS k, p_name AS c, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS nth FROM part), names AS (SELECT DISTINCT c FROM parts),
m AS (SELECT c AS mention, lower(list_extract(string_split(c, ' '), -1)) AS last FROM names), pr AS (SELECT mention, c, trim(lower(mention)) AS a, trim(lower(c)) AS b FROM m JOIN names ON contains(lower(c), last)),
two AS (SELECT a, b FROM pr UNION SELECT {_sql_words('a')}, {_sql_words('b')} FROM pr),
seg AS (SELECT a, b, {_SQL_BLOCK} AS code FROM (SELECT a, b, CAST(0 AS BIGINT) AS alo, length(a) AS ahi, CAST(0 AS BIGINT) AS blo, length(b) AS bhi FROM two) s0),
blocks AS (SELECT a, b, CAST(0 AS BIGINT) AS alo, length(a) AS ahi, CAST(0 AS BIGINT) AS blo, length(b) AS bhi, CAST(code AS BIGINT) AS code FROM seg
  UNION ALL SELECT a, b, alo, ahi, blo, bhi, CAST({_SQL_BLOCK} AS BIGINT) FROM (SELECT a, b, x.alo AS alo, x.ahi AS ahi, x.blo AS blo, x.bhi AS bhi FROM (
    SELECT a, b, unnest([{{'alo': alo, 'ahi': i, 'blo': blo, 'bhi': j}}, {{'alo': i + n, 'ahi': ahi, 'blo': j + n, 'bhi': bhi}}]) AS x FROM (SELECT *, code // 1000000 AS n, 999 - (code // 1000) % 1000 AS i, 999 - code % 1000 AS j FROM blocks WHERE code >= 1000000) s1) s2 WHERE x.ahi > x.alo AND x.bhi > x.blo) s3),
sim AS (SELECT a, b, 2.0e0 * sum(code // 1000000) / (length(a) + length(b)) AS s FROM blocks GROUP BY a, b),
sc AS (SELECT mention, c, round(0.5e0 * CAST(pr.a = pr.b AS INT) + 0.3e0 * x.s + 0.2e0 * y.s, 6) AS score FROM pr JOIN sim x ON x.a = pr.a AND x.b = pr.b JOIN sim y ON y.a = {_sql_words('pr.a')} AND y.b = {_sql_words('pr.b')}),
r AS (SELECT mention, k, score, row_number() OVER (PARTITION BY mention ORDER BY score DESC, k) AS rank FROM sc JOIN parts USING (c) WHERE nth <= 5)
SELECT mention, k, score, rank FROM r WHERE rank <= 5
""")
def baseline_rank(spark, sf_dir):
    """Every part name as a mention, ranked against the parts whose name contains its last word, as retrieval finds them but without its limit.

    A pair of names is scored once;
    parts of one name score the same, so only the first five of each name can be among a mention's five.
    """
    parts = star_sql(spark, sf_dir, "SELECT p_partkey AS k, p_name AS c FROM part")
    names = parts.select("c").distinct()
    mentions = names.select(F.col("c").alias("mention"), retrieve.last_token(F.col("c")).alias("last"))
    pairs = retrieve.contains_join(mentions, names, "last", "c").select("mention", "c")
    s = pairs.withColumn("score", F.round(evaluate.baseline_score(F.col("mention"), F.col("c"), sequence_ratio), 6))
    s = s.join(retrieve.limit_per(parts, ["c"], ["k"], 5), "c")
    return score.top_k(s, ["mention"], 5, order="k").select("mention", "k", "score", "rank")


_MENTIONS = "(SELECT conv_id AS doc_id, turn AS ord, 'PER' AS label, split_part(text, ' ', 1) AS mention FROM conversations)"


@query("assign_spans", f"""
WITH g AS (SELECT * FROM {_MENTIONS} z WHERE mention <> ''), t AS (SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn, role, text) AS "full" FROM conversations GROUP BY conv_id),
n AS (SELECT g.*, lower("full") AS l, row_number() OVER (PARTITION BY doc_id, label, mention ORDER BY ord) - 1 AS nth, string_split(lower("full"), lower(mention)) AS ps FROM g JOIN t USING (doc_id)),
k AS (SELECT *, CASE WHEN nth < len(ps) - 1 THEN nth ELSE 0 END AS k FROM n)
SELECT doc_id, ord, mention, CAST(list_sum(list_transform(list_slice(ps, 1, k + 1), lambda p: length(p))) + k * length(mention) AS INT) AS start, CAST(list_sum(list_transform(list_slice(ps, 1, k + 1), lambda p: length(p))) + (k + 1) * length(mention) AS INT) AS "end" FROM k
""")
def assign_spans(spark, sf_dir):
    gold = star_sql(spark, sf_dir, f"SELECT * FROM {_MENTIONS} z WHERE mention <> ''")
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    full = c.groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"]), " ").alias("full")
    )
    return evaluate.assign_spans(gold, full).select("doc_id", "ord", "mention", "start", "end")
