"""Queries of the span algebra. Spans come from the rule tagger over whole documents, and from sentences made of the star tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import lexicon as L
from vellum.operators import filters, spans, tag
from vellum.plans.registry import query
from vellum.plans.text_queries import SQL_CHUNKS, docs, sql_list

_RUN = "[A-Z][a-z]+(?: [A-Z][a-z]+)*"
_PLACES = sql_list(sorted({*L.COUNTIES, *L.PLACE_NAMES}))
SQL_SPANS = f"""
m AS (SELECT doc_id, regexp_extract_all(text, '{_RUN}') AS ms, string_split_regex(text, '{_RUN}') AS ps FROM documents),
u AS (SELECT doc_id, unnest(ms) AS text, generate_subscripts(ms, 1) AS i, ps FROM m),
w AS (SELECT doc_id, text, sum(length(ps[i])) OVER v + sum(length(text)) OVER v - length(text) AS start FROM u WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
spans AS (SELECT doc_id, text, CASE WHEN lower(text) IN ({_PLACES}) THEN 'LOC' ELSE 'PER' END AS label, CAST(CASE WHEN lower(text) IN ({_PLACES}) THEN 0.95 WHEN contains(text, ' ') THEN 0.9 ELSE 0.6 END AS DOUBLE) AS score, CAST(start AS INT) AS start, CAST(start + length(text) AS INT) AS "end" FROM w)
"""


def tagged(spark, sf_dir):
    """Spans of whole documents: one chunk each."""
    whole = docs(spark, sf_dir).select("doc_id", F.lit(0).alias("off"), F.col("text").alias("chunk"))
    return tag.keep_allowed(tag.capital_tagger(whole))


def texts(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.col("text").alias("full"))


@query("tag_capitalised", f"WITH {SQL_SPANS} SELECT * FROM spans")
def tag_capitalised(spark, sf_dir):
    return tagged(spark, sf_dir)


#: Sentences with prefixes, suffixes and a bad offset, in SQL that both engines run.
SENTENCES = """(SELECT c_custkey AS doc_id, 'The County of ' || n_name || ' met the said said ' || c_name || ', Esqr. near the towne.' AS "full", n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
MADE = f"""(
SELECT doc_id, 'County of ' || n_name AS text, 'LOC' AS label, CAST(0.3 + 0.01 * (doc_id % 70) AS DOUBLE) AS score, 4 AS start, 14 + length(n_name) AS "end" FROM {SENTENCES} a
UNION ALL SELECT doc_id, 'the said said ' || c_name || ', Esqr.' AS text, 'PER' AS label, CAST(0.9 AS DOUBLE) AS score, 19 + length(n_name) AS start, 40 + length(n_name) + length(c_name) AS "end" FROM {SENTENCES} b
UNION ALL SELECT doc_id, 'said ' || c_name AS text, 'PER' AS label, CAST(0.8 AS DOUBLE) AS score, CAST(NULL AS INT) AS start, CAST(NULL AS INT) AS "end" FROM {SENTENCES} c)"""


def star_sql(spark, sf_dir, text: str):
    """Run SQL that names the star tables, which are read from sf_dir."""
    for name in (
        "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "labels", "embeddings", "conversations"
    ):
        if name in text:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(text.replace('"', "`"))


@query("trim_span_affixes", f"""
WITH s AS (SELECT x.*, f."full" FROM {MADE} x JOIN {SENTENCES} f USING (doc_id) WHERE score >= 0.5),
o AS (SELECT *, start IS NOT NULL AS usable, CASE WHEN start IS NOT NULL THEN substr("full", start + 1, "end" - start) ELSE text END AS old FROM s),
n AS (SELECT *, trim(CASE WHEN label = 'LOC' THEN regexp_replace(old, '(?i)^\\s*(county\\s+of|of)\\s+', '') ELSE regexp_replace(regexp_replace(old, '(?i)^\\s*(the\\s+)?(said\\s+)+', ''), '(?i)(\\s*[,;:]?\\s*)(esquire|esqr|esq|major)\\.?\\s*$', '') END) AS new FROM o)
SELECT doc_id, new AS text, label, score, CAST(CASE WHEN usable THEN start + instr(old, new) - 1 END AS INT) AS start, CAST(CASE WHEN usable THEN start + instr(old, new) - 1 + length(new) END AS INT) AS "end" FROM n
""".replace("\\\\", "\\"))
def trim_span_affixes(spark, sf_dir):
    made = star_sql(spark, sf_dir, f"SELECT doc_id, text, label, CAST(score AS DOUBLE) AS score, start, `end` FROM {MADE} z")
    return tag.trim_affixes(made, star_sql(spark, sf_dir, f'SELECT doc_id, "full" FROM {SENTENCES} z'))


#: Nested variants of the spans: their first word, and one character less at either end.
SQL_NESTED = f"""{SQL_SPANS},
nested AS (SELECT * FROM spans UNION ALL SELECT doc_id, split_part(text, ' ', 1), label, score, start, CAST(start + length(split_part(text, ' ', 1)) AS INT) FROM spans
  UNION ALL SELECT doc_id, substr(text, 2), CASE WHEN length(text) % 3 = 0 THEN 'LOC' ELSE label END, score, start + 1, "end" FROM spans WHERE length(text) > 4)"""


def nested(spark, sf_dir):
    """Each span with its variants, in one pass."""
    label = F.when(F.length("text") % 3 == 0, "LOC").otherwise(F.col("label"))
    word = F.substring_index("text", " ", 1)
    same = F.struct("text", "label", "start", "end")
    one = F.struct(word.alias("text"), F.col("label"), F.col("start"), (F.col("start") + F.length(word)).cast("int").alias("end"))
    less = F.struct(
        F.substring("text", F.lit(2), F.length("text")).alias("text"), label.alias("label"), (F.col("start") + 1).alias("start"),
        F.col("end")
    )
    each = tagged(spark, sf_dir).select(
        "doc_id", "score", F.explode(F.array_compact(F.array(same, one, F.when(F.length("text") > 4, less)))).alias("v")
    )
    return each.select("doc_id", "v.text", "v.label", "score", "v.start", "v.end")


def _sql_inside(test: str) -> str:
    return f"""WITH {SQL_NESTED}, kept AS (SELECT * FROM nested a WHERE NOT EXISTS (SELECT 1 FROM nested b WHERE b.doc_id = a.doc_id AND b.label = a.label AND b.start <= a.start AND b."end" >= a."end" AND {test}))
SELECT doc_id, label, count(*) AS n, CAST(sum(start) AS BIGINT) AS sum_start, CAST(sum("end") AS BIGINT) AS sum_end, count(DISTINCT text) AS n_texts FROM kept GROUP BY doc_id, label"""


def _counted(s):
    return s.groupBy("doc_id", "label").agg(
        F.count("*").alias("n"), F.sum(F.col("start").cast("long")).alias("sum_start"), F.sum(F.col("end").cast("long")).alias("sum_end"),
        F.countDistinct("text").alias("n_texts")
    )


@query("drop_contained", _sql_inside('b."end" - b.start > a."end" - a.start'))
def drop_contained(spark, sf_dir):
    return _counted(spans.drop_contained(nested(spark, sf_dir)))


@query("drop_contained_same", _sql_inside("b.start < a.start"))
def drop_contained_same(spark, sf_dir):
    return _counted(spans.drop_contained_later(nested(spark, sf_dir)))


@query("merge_adjacent", f"""
WITH {SQL_SPANS}, n AS (SELECT s.*, d.text AS full_text, lag(s."end") OVER v AS pe, lag(s.label) OVER v AS pl FROM spans s JOIN documents d USING (doc_id) WINDOW v AS (PARTITION BY s.doc_id ORDER BY s.start, s."end")),
b AS (SELECT *, CASE WHEN pe IS NOT NULL AND pl = label AND start - pe <= 6 AND regexp_full_match(substr(full_text, pe + 1, start - pe), '(?i)(?:[\\s''’.-]{{0,3}}|\\s+oge\\s+)') THEN 0 ELSE 1 END AS brk FROM n),
g AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id ORDER BY start, "end") AS island FROM b)
SELECT doc_id, label, CAST(min(start) AS INT) AS start, CAST(max("end") AS INT) AS "end", max(score) AS score, substr(any_value(full_text), min(start) + 1, max("end") - min(start)) AS text FROM g GROUP BY doc_id, label, island
""".replace("\\\\", "\\"))
def merge_adjacent(spark, sf_dir):
    """The fold over spans that do not overlap, where it equals gaps and islands; tests hold it against a sequential version on any spans."""
    return spans.merge_adjacent(tagged(spark, sf_dir), texts(spark, sf_dir), max_gap=6, min_score=0.55, extend_clipped_words=False)


@query("clip_spans", f"""
WITH {SQL_SPANS}, c AS (SELECT s.doc_id, s.label, s.score, greatest(least(s.start - 1, length(d.text)), 0) AS a, greatest(least(s."end" + 2, length(d.text)), 0) AS b, d.text AS t FROM spans s JOIN documents d USING (doc_id))
SELECT doc_id, regexp_replace(substr(t, a + 1, b - a), '^\\s+|\\s+$', '', 'g') AS text, label, score, CAST(a AS INT) AS start, CAST(b AS INT) AS "end" FROM c WHERE a < b
""".replace("\\\\", "\\"))
def clip_spans(spark, sf_dir):
    wide = tagged(spark, sf_dir).withColumns({"start": F.col("start") - 1, "end": F.col("end") + 2})
    return spans.clip_to_text(wide, texts(spark, sf_dir))


@query("extend_clipped", f"""
WITH {SQL_SPANS}, c AS (SELECT s.doc_id, s.label, s.score, s.start, CASE WHEN length(s.text) > 4 THEN s."end" - 2 ELSE s."end" END AS e, d.text AS t FROM spans s JOIN documents d USING (doc_id)),
x AS (SELECT *, substr(t, start + 1, e - start) AS own, regexp_extract(substr(t, e + 1), '^[\\p{{L}}''’-]+', 0) AS run FROM c),
y AS (SELECT *, CASE WHEN e < length(t) AND regexp_full_match(right(own, 1), '\\p{{L}}') AND regexp_matches(run, '^(\\p{{L}}|[''’]\\p{{L}})')
  AND regexp_full_match(own || run, CASE label WHEN 'PER' THEN '[A-Za-z][A-Za-z''’-]*' ELSE '[A-Za-z][A-Za-z''’.-]*' END) AND length(regexp_replace(own || run, '[^\\p{{L}}]', '', 'g')) >= 3 THEN own || run ELSE own END AS text FROM x),
z AS (SELECT doc_id, text, label, score, start, CAST(start + length(text) AS INT) AS "end" FROM y),
later AS (SELECT *, max("end") OVER (PARTITION BY doc_id, label ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM z)
SELECT doc_id, text, label, score, start, "end" FROM later WHERE before IS NULL OR before < "end"
""".replace("\\\\", "\\"))
def extend_clipped(spark, sf_dir):
    """All spans, those of five letters and more cut two letters short, and single words made whole again."""
    t = texts(spark, sf_dir)
    less = F.when(F.length("text") > 4, 2).otherwise(0)
    cut = tagged(spark, sf_dir).withColumns({"end": F.col("end") - less, "text": F.substring("text", F.lit(1), F.length("text") - less)})
    return spans.extend_clipped(cut, t)


_STOPS = sql_list(L.STOP_PHRASES)


@query("filter_dedupe", f"""
WITH {SQL_NESTED}, k AS (SELECT * FROM nested WHERE trim(text) NOT IN ({_STOPS}) AND length(trim(text)) >= 3 AND score >= 0.7 AND NOT (label = 'PER' AND regexp_full_match(trim(text), '[Oo][''’][A-Za-z]{{1,3}}'))),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", label, text, score DESC) AS ord FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, start, "end" ORDER BY ord) AS own FROM o)
SELECT doc_id, text, label, arg_min(score, ord) AS score, arg_min(start, ord) AS start, arg_min("end", ord) AS "end", count(*) FILTER (WHERE own = 1) AS n_spans, CAST(coalesce(sum(start) FILTER (WHERE own = 1), 0) AS BIGINT) AS sum_starts FROM p GROUP BY doc_id, text, label
""")
def filter_dedupe(spark, sf_dir):
    u = filters.unique_entities(nested(spark, sf_dir))
    return u.select(
        "doc_id", "text", "label", "score", "start", "end", F.size("spans").cast("long").alias("n_spans"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["start"]).alias("sum_starts")
    )


@query(
    "document_locations",
    f"WITH {SQL_SPANS} SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list(lower(text)) FILTER (WHERE label = 'LOC'))), '|'), '') AS locations FROM spans GROUP BY doc_id"
)
def document_locations(spark, sf_dir):
    d = filters.document_locations(tagged(spark, sf_dir))
    return d.select("doc_id", F.array_join("locations", "|").alias("locations"))


@query(
    "standard_labels",
    "SELECT event_type AS label, CASE WHEN upper(event_type) IN ('PERSON', 'PER', 'PERS') THEN 'PER' WHEN upper(event_type) IN ('GPE', 'LOC', 'LOCATION', 'PLACE', 'FAC', 'FACILITY') THEN 'LOC' END AS standard, count(*) AS n FROM (SELECT event_type FROM events UNION ALL SELECT 'Person' FROM region UNION ALL SELECT 'gpe' FROM nation) e GROUP BY event_type"
)
def standard_labels(spark, sf_dir):
    e = star_sql(
        spark, sf_dir, "SELECT event_type AS label FROM events UNION ALL SELECT 'Person' FROM region UNION ALL SELECT 'gpe' FROM nation"
    )
    return e.groupBy("label").agg(F.count("*").alias("n")).select("label", tag.standard_label(F.col("label")).alias("standard"), "n")


@query("project_spans", f"""
WITH {SQL_SPANS} SELECT s.doc_id, substr(d.text, s.start + 2, s."end" - s.start) AS text, label, score, s.start + 1 AS start, s."end" + 1 AS "end" FROM spans s JOIN documents d USING (doc_id) WHERE s."end" < length(d.text)
""")
def project_spans(spark, sf_dir):
    """Spans projected through a map that moves every character one place on."""
    d = docs(spark, sf_dir).filter("length(text) > 1")
    maps = d.select("doc_id", F.sequence(F.lit(1), F.length("text") - 1).alias("char_map"), F.col("text").alias("raw"))
    return spans.project_to_raw(tagged(spark, sf_dir), maps)


@query("analyze_documents", rf"""
WITH RECURSIVE {SQL_CHUNKS},
m AS (SELECT doc_id, no, s, regexp_extract_all(substr(text, s + 1, e - s), '{_RUN}') AS ms, string_split_regex(substr(text, s + 1, e - s), '{_RUN}') AS ps FROM c),
u AS (SELECT doc_id, no, s, unnest(ms) AS t, generate_subscripts(ms, 1) AS i, ps FROM m),
w AS (SELECT doc_id, t, s + sum(length(ps[i])) OVER v + sum(length(t)) OVER v - length(t) AS a FROM u WINDOW v AS (PARTITION BY doc_id, no ORDER BY i)),
l AS (SELECT *, CASE WHEN lower(t) IN ({_PLACES}) THEN 'LOC' ELSE 'PER' END AS label, CASE WHEN lower(t) IN ({_PLACES}) THEN 0.95e0 WHEN contains(t, ' ') THEN 0.9e0 ELSE 0.6e0 END AS score FROM w),
x AS (SELECT *, trim(CASE WHEN label = 'PER' THEN regexp_replace(regexp_replace(t, '(?i)^\s*(?:the\s+)?(?:said\s+)+', ''), '(?i)(?:\s*[,;:]?\s*)(?:esquire|esqr|esq|major)\.?\s*$', '') ELSE t END) AS short FROM l),
y AS (SELECT doc_id, label, score, CASE WHEN short <> '' THEN short ELSE t END AS text, a + CASE WHEN short <> '' THEN instr(t, short) - 1 ELSE 0 END AS start FROM x),
z AS (SELECT DISTINCT doc_id, CASE WHEN label = 'PER' AND lower(text) IN ({sql_list(L.COUNTIES)}) THEN 'LOC' ELSE label END AS label, label AS was, score, text, start, start + length(text) AS "end" FROM y),
k AS (SELECT * FROM z p WHERE NOT EXISTS (SELECT 1 FROM z q WHERE q.doc_id = p.doc_id AND q.was = p.was AND q.start <= p.start AND q."end" >= p."end" AND q."end" - q.start > p."end" - p.start)),
d AS (SELECT doc_id, label, text, start, "end", max(score) AS score FROM k GROUP BY ALL)
SELECT doc_id, label, count(*) AS n, CAST(sum(start) AS BIGINT) AS sum_start, CAST(sum("end") AS BIGINT) AS sum_end, count(DISTINCT text) AS n_texts, round(sum(score), 3) AS score FROM d GROUP BY doc_id, label
""")
def analyze_documents(spark, sf_dir):
    """Chunks, tags and every clean-up step."""
    return tag.analyze(docs(spark, sf_dir)).groupBy("doc_id", "label").agg(
        F.count("*").alias("n"), F.sum(F.col("start").cast("long")).alias("sum_start"), F.sum(F.col("end").cast("long")).alias("sum_end"), F.countDistinct("text").alias("n_texts"), F.round(F.sum("score"), 3).alias("score"))
