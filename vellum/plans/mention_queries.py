"""Queries of span repair, on made mentions: word pieces, labels, Irish names, a model as a tagger, and the span look-up."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vellum.functions import lexicon as L
from vellum.functions.strings import alpha_only, nfkc
from vellum.operators import filters, spans, tag
from vellum.plans.registry import query
from vellum.plans.span_queries import SQL_SPANS, star_sql, tagged
from vellum.plans.text_queries import docs, sql_list

SPAN_COLUMNS = 'doc_id, text, label, CAST(score AS DOUBLE) AS score, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end"'

#: Three pieces for each customer; every third customer's last piece has another label.
PIECES = """(
SELECT c_custkey AS doc_id, 'Cust' AS text, 'PER' AS label, 0.8e0 AS score, 0 AS start, 4 AS "end" FROM customer
UNION ALL SELECT c_custkey, '##omer', 'PER', 0.5e0 + 0.01e0 * (c_custkey % 7), 4, 8 FROM customer
UNION ALL SELECT c_custkey, '##' || substr(c_name, 10), CASE WHEN c_custkey % 3 = 0 THEN 'LOC' ELSE 'PER' END, 0.25e0, 8, 17 FROM customer)"""


@query("join_wordpieces", f"""
WITH p AS (SELECT * FROM {PIECES} z), k AS (SELECT doc_id, doc_id % 3 = 0 AS cut, max(text) FILTER (WHERE start = 8) AS tail, (0.8e0 + max(score) FILTER (WHERE start = 4)) / 2 AS two FROM p GROUP BY doc_id)
SELECT doc_id, 'Customer' || CASE WHEN cut THEN '' ELSE substr(tail, 3) END AS text, 'PER' AS label, CASE WHEN cut THEN two ELSE (two + 0.25e0) / 2 END AS score, 0 AS start, CASE WHEN cut THEN 8 ELSE 17 END AS "end" FROM k
UNION ALL SELECT doc_id, tail, 'LOC', 0.25e0, 8, 17 FROM k WHERE cut
""")
def join_wordpieces(spark, sf_dir):
    return tag.merge_wordpieces(star_sql(spark, sf_dir, f"SELECT {SPAN_COLUMNS} FROM {PIECES} z"))


#: Places and persons of the lists as PER and LOC, some of them twice with different scores.
COUNTIES = f"""(SELECT c_custkey AS doc_id, CASE c_custkey % 4 WHEN 0 THEN 'Cavan' WHEN 1 THEN 'DONEGAL' WHEN 2 THEN 'Athlone' ELSE c_name END AS text, CASE WHEN c_custkey % 8 < 6 THEN 'PER' ELSE 'LOC' END AS label,
  0.5e0 + 0.1e0 * k AS score, 3 AS start, 10 AS "end" FROM customer, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) c WHERE k <= c_custkey % 3)"""


@query("relabel_counties", f"""
SELECT doc_id, text, CASE WHEN label = 'PER' AND lower(text) IN ({sql_list(L.COUNTIES)}) THEN 'LOC' ELSE label END AS label, max(score) AS score, start, "end" FROM {COUNTIES} z GROUP BY ALL
""")
def relabel_counties(spark, sf_dir):
    """Counties are places; spans equal in place, label and text count once."""
    return tag.dedupe_exact(tag.correct_counties(star_sql(spark, sf_dir, f"SELECT {SPAN_COLUMNS} FROM {COUNTIES} z")))


#: A sentence for each nation and manner, its mention, and the label that a tagger gave it.
CONTEXTS = """(SELECT n_nationkey * 10 + k AS doc_id, before || m || after AS "full", m AS text, label, length(before) AS start, length(before) + length(m) AS "end" FROM (
  SELECT n_nationkey, k, before, after, CASE WHEN k % 3 = 0 THEN 'Brennan ' || n_name WHEN k % 3 = 1 THEN 'Carton' ELSE n_name END AS m, CASE WHEN (k + n_nationkey) % 2 = 0 THEN 'PER' ELSE 'LOC' END AS label FROM nation, (
    SELECT 0 AS k, 'Then sir ' AS before, ' came' AS after UNION ALL SELECT 1, 'They met near ', ' by night' UNION ALL SELECT 2, 'The eldest ', ' was gone' UNION ALL SELECT 3, 'It was ', ', no more'
    UNION ALL SELECT 4, 'A word of ', ' and sonn to him' UNION ALL SELECT 5, 'A lord is far away from here, and so is all that we know of ', '; a lord' UNION ALL SELECT 6, 'The castle of ', ' and the bishop of it') s) q)"""


def _sql_says(words) -> str:
    return "(" + " OR ".join(f"contains(near, '{w} ')" for w in words) + ")"


@query("fix_labels", f"""
WITH c AS (SELECT *, substr(lower("full"), greatest(start - 40, 0) + 1, least("end" + 40, length("full")) - greatest(start - 40, 0)) AS near FROM {CONTEXTS} z),
a AS (SELECT *, CASE WHEN {_sql_says(L.PERSON_TITLES)} THEN 'PER' ELSE label END AS l1 FROM c),
b AS (SELECT *, CASE WHEN {_sql_says(L.PLACE_CUES)} AND l1 <> 'PER' THEN 'LOC' ELSE l1 END AS l2 FROM a),
d AS (SELECT *, CASE WHEN regexp_matches(lower(text), '(son|ton|ford|ham|bury)$') AND l2 <> 'PER' THEN 'LOC' ELSE l2 END AS l3 FROM b)
SELECT doc_id, text, CASE WHEN NOT contains(text, ' ') AND substr(text, 1, 1) <> lower(substr(text, 1, 1)) AND (contains(near, 'sonn to') OR contains(near, 'eldest')) THEN 'PER' ELSE l3 END AS label, start, "end" FROM d
""")
def fix_labels(spark, sf_dir):
    """Labels by the words around a mention."""
    c = star_sql(
        spark, sf_dir, f'SELECT doc_id, "full", text, label, CAST(start AS INT) AS start, CAST("end" AS INT) AS "end" FROM {CONTEXTS} z'
    )
    return tag.fix_labels(c.drop("full"), c.select("doc_id", "full")).select("doc_id", "text", "label", "start", "end")


def _words_of_a_list(load=("north", "south", "widget", "the")):
    """A stand-in for a model: the words of a list, without places, as models of whole sentences give them."""

    def model(texts: list[str]) -> list[list[tuple]]:
        return [
            [(m[0], "GPE" if len(m[0]) > 4 else "PERSON", None, None, None) for m in re.finditer(r"\b(?:" + "|".join(load) + r")\b", t)]
            for t in texts
        ]

    return model


@query("model_tagger", r"""
WITH w AS (SELECT doc_id, len(regexp_extract_all(' ' || regexp_replace(text, '[^\w\p{L}]', '  ', 'g') || ' ', ' the ')) AS n, string_split(text, 'the') AS ps FROM documents),
u AS (SELECT doc_id, unnest(list_transform(range(1, n + 1), lambda k: CAST(list_sum(list_transform(list_slice(ps, 1, k), lambda p: length(p))) + 3 * (k - 1) AS BIGINT))) AS start FROM w WHERE n > 0)
SELECT doc_id, 'PER' AS label, count(*) AS n, CAST(sum(start) AS BIGINT) AS sum_start FROM u GROUP BY doc_id
""")
def model_tagger(spark, sf_dir):
    """A registered model's entities without places: each takes the next place where its letters stand. The corpus has `the` of its list only."""
    tag.register_model("listed words", _words_of_a_list)
    whole = docs(spark, sf_dir).select("doc_id", F.lit(0).alias("off"), F.col("text").alias("chunk"))
    found = tag.keep_allowed(tag.TAGGERS["listed words"](whole))
    return found.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.sum(F.col("start").cast("long")).alias("sum_start"))


#: A broken name for each customer: `Bryan og`, something between, and `O'...`, with a label or a gap that forbids the merge for some.
BROKEN = """(SELECT c_custkey AS doc_id, 'Bryan og' || gap || second || ' rode' AS "full", gap, second, other FROM (
  SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN ' e ' WHEN 1 THEN ' -e- ' WHEN 2 THEN ' a ' ELSE ' ' END AS gap, CASE c_custkey % 3 WHEN 0 THEN 'O''neale' WHEN 1 THEN 'o’neale' ELSE 'Neale' END AS second, CASE WHEN c_custkey % 5 = 0 THEN 'LOC' ELSE 'PER' END AS other FROM customer) q)"""
BROKEN_SPANS = f"""(SELECT doc_id, 'Bryan og' AS text, 'PER' AS label, 0.9e0 AS score, 0 AS start, 8 AS "end" FROM {BROKEN} a UNION ALL SELECT doc_id, second, other, 0.8e0, 8 + length(gap), 8 + length(gap) + length(second) FROM {BROKEN} b)"""


@query("og_merge", f"""
WITH b AS (SELECT *, other = 'PER' AND (trim(gap) = '' OR (gap IN (' e ', ' -e- ') AND starts_with(lower(second), 'o'''))) AS one FROM {BROKEN} z),
s AS (SELECT doc_id, 'PER' AS label, CASE WHEN one THEN "full"[1:8 + length(gap) + length(second)] ELSE 'Bryan og' END AS text, 0 AS start FROM b UNION ALL SELECT doc_id, other, second, 8 + length(gap) FROM b WHERE NOT one),
c AS (SELECT *, CASE WHEN label = 'PER' THEN replace(text, '’', '''') ELSE text END AS t FROM s)
SELECT doc_id, label, CASE WHEN label = 'PER' THEN CASE WHEN starts_with(t, 'o''') THEN t ELSE t END ELSE t END AS text, regexp_replace(lower(t), '[^a-z]', '', 'g') AS letters, start, start + length(text) AS "end" FROM c
""".replace("CASE WHEN starts_with(t, 'o''') THEN t ELSE t END", "CASE WHEN contains(t, 'O''n') THEN replace(t, 'O''n', 'O''N') ELSE t END"))
def og_merge(spark, sf_dir):
    """Names that a mark or an `e` has broken, joined where the rule allows it, and written as `O'N...`."""
    made = star_sql(spark, sf_dir, f"SELECT {SPAN_COLUMNS} FROM {BROKEN_SPANS} z")
    merged = filters.canonical(
        spans.merge_adjacent(made, star_sql(spark, sf_dir, f'SELECT doc_id, "full" FROM {BROKEN} z'), max_gap=6, extend_clipped_words=False)
    )
    return merged.select("doc_id", "label", "text", alpha_only(F.col("text")).alias("letters"), "start", "end")


#: `O` or `O'` at the end of a span, and what follows it in the text.
CUT = """(SELECT c_custkey AS doc_id, head || tail || ', and more' AS "full", head, tail, label FROM (
  SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'Shane O' WHEN 1 THEN 'Con O' ELSE 'Owen' END AS head, CASE c_custkey % 4 WHEN 0 THEN '''Neill' WHEN 1 THEN '’Connor' WHEN 2 THEN 'Neill' ELSE '''Widget' END AS tail, CASE WHEN c_custkey % 7 = 0 THEN 'LOC' ELSE 'PER' END AS label FROM customer) q)"""


@query("o_surnames", f"""
WITH c AS (SELECT *, label = 'PER' AND head <> 'Owen' AND doc_id % 4 IN (0, 2) AS longer FROM {CUT} z)
SELECT doc_id, CASE WHEN longer THEN head || tail ELSE head END AS text, label, 0 AS start, CASE WHEN longer THEN length(head) + length(tail) ELSE length(head) END AS "end" FROM c
""")
def o_surnames(spark, sf_dir):
    c = star_sql(
        spark, sf_dir,
        f"""SELECT doc_id, head AS text, label, 0.9e0 AS score, 0 AS start, CAST(length(head) AS INT) AS "end", "full" FROM {CUT} z"""
    )
    return spans.extend_o_surnames(c.drop("full"), c.select("doc_id", "full")).select("doc_id", "text", "label", "start", "end")


@query("spans_lookup", f"""
WITH {SQL_SPANS}, k AS (SELECT * FROM spans WHERE trim(text) NOT IN ({sql_list(L.STOP_PHRASES)}) AND length(trim(text)) >= 3 AND score >= 0.7 AND NOT (label = 'PER' AND regexp_full_match(trim(text), '[Oo][''’][A-Za-z]{{1,3}}')))
SELECT doc_id, text, label, score, start, "end" FROM k
""")
def spans_lookup(spark, sf_dir):
    """Spans grouped to entities and taken apart again are the spans that the filter kept."""
    return spans.spans_from_lookup(filters.unique_entities(tagged(spark, sf_dir))).select(
        "doc_id", "text", "label", "score", "start", "end"
    )


@query("nfkc_texts", """
SELECT n_nationkey AS k, 'fi' || n_name || '2' || 'A1' || '...' || '\u00e9' || 'No' || ' ' || 'IV' AS text FROM nation
""")
def nfkc_texts(spark, sf_dir):
    """A ligature, a raised digit, wide letters, an ellipsis, a letter with its accent apart, a numero sign, a hard blank and a Roman numeral."""
    raw = star_sql(
        spark, sf_dir,
        "SELECT n_nationkey AS k, '\ufb01' || n_name || '\u00b2' || '\uff21\uff11' || '\u2026' || 'e\u0301' || '\u2116' || '\u00a0' || '\u2163' AS text FROM nation"
    )
    return raw.select("k", nfkc(F.col("text")).alias("text"))
