"""Queries that write files as users bring or take them, in the shared folder, and read them through the sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellum.functions import lexicon as L
from vellum.operators import evaluate
from vellum.plans.durable import shared_folder
from vellum.plans.registry import query
from vellum.plans.span_queries import star_sql
from vellum.plans.text_queries import docs, sql_list
from vellum.sources import documents as sources


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _write_lines(df, path: str) -> None:
    """One file for each row of df(value)."""
    df.select("value").repartition(df.count()).write.text(path)


def _write_each(df, path: str) -> None:
    """A file for each row of df(value), by the tasks that have the rows."""
    df.write.option("maxRecordsPerFile", 1).text(path)


@query(
    "read_texts",
    "SELECT md5(n_name || chr(10) || n_nationkey || chr(10)) AS digest, CAST(length(n_name || n_nationkey) + 2 AS INT) AS n_chars FROM nation"
)
def read_texts(spark, sf_dir):
    """A text file for each nation, read whole."""
    path = _folder(spark)
    rows = star_sql(spark, sf_dir, "SELECT n_nationkey AS k, n_name || '\\n' || n_nationkey AS value FROM nation")
    rows.write.partitionBy("k").text(path)
    got = sources.read_texts(spark, f"{path}/k=*")
    return got.select(F.md5("visual").alias("digest"), F.length("visual").alias("n_chars"))


@query("read_uploads", """
SELECT n_nationkey AS k, CASE WHEN n_nationkey % 3 = 0 THEN 'xml' ELSE 'text' END AS kind, CASE WHEN n_nationkey % 3 = 0 THEN n_name || chr(10) || 'two' ELSE n_name || ' <p>' || chr(10) END AS visual, CAST(NULL AS VARCHAR) AS error FROM nation
""")
def read_uploads(spark, sf_dir):
    """Uploads that are TEI or plain text, told apart by their content."""
    path = _folder(spark)
    rows = star_sql(spark, sf_dir, "SELECT n_nationkey AS k, n_name FROM nation")
    tei = F.concat(
        F.lit('<?xml version="1.0"?><TEI xmlns="http://www.tei-c.org/ns/1.0"><text><pb n="1"/><p>'), "n_name",
        F.lit("</p><p>two</p></text></TEI>")
    )
    rows.select(
        "k", F.when(F.col("k") % 3 == 0, tei).otherwise(F.concat("n_name", F.lit(" <p>"))).alias("value")
    ).write.partitionBy("k").text(path)
    got = sources.read_uploads(spark, f"{path}/k=*/part-*")
    return got.select(F.regexp_extract("doc_id", r"/k=(\d+)/", 1).cast("int").alias("k"), "kind", "visual", "error")


@query("read_lexicons", """
SELECT p_brand AS kind, lower(p_name) AS term, CAST(NULL AS VARCHAR) AS new FROM part GROUP BY ALL UNION ALL SELECT 'pair', lower('Old ' || p_partkey), lower(p_name) FROM part
""")
def read_lexicons(spark, sf_dir):
    """The parts' names as lists by brand, and pairs of words by hundreds, written as JSON objects, a file each, and read as lexicons."""
    path = _folder(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    named = lambda k, v: F.to_json(F.map_from_entries(F.collect_list(F.struct(k, v)))).alias("value")
    lists = part.select("p_brand", "p_name").distinct().groupBy("p_brand", F.pmod(F.xxhash64("p_name"), F.lit(64))).agg(F.array_sort(F.collect_list("p_name")).alias("l"))
    _write_each(lists.select(F.to_json(F.map_from_arrays(F.array("p_brand"), F.array("l"))).alias("value")), f"{path}/lists")
    pairs = part.groupBy(F.floor(F.col("p_partkey") / 100)).agg(named(F.concat(F.lit("Old "), "p_partkey"), F.col("p_name")))
    _write_each(pairs.select("value"), f"{path}/pairs")
    terms = sources.read_lexicon(spark, f"{path}/lists").select("kind", F.lower("term").alias("term"), F.lit(None).cast("string").alias("new"))
    return terms.unionByName(sources.read_pairs(spark, f"{path}/pairs").select(F.lit("pair").alias("kind"), F.col("old").alias("term"), "new"))


#: Gold rows as JSON lines; every seventh is blank, every fifth lacks what a gold row must have.
GOLD_LINES = """(SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE '{"doc_id": "d' || c_custkey || '", "mention": "' || CASE WHEN c_custkey % 5 = 0 THEN ' ' ELSE c_name END || '", "label": "' || CASE WHEN c_custkey % 11 = 0 THEN 'ORG' WHEN c_custkey % 2 = 0 THEN 'PER' ELSE 'LOC' END || '", "gold_uri": "kg/' || c_custkey || '"}' END AS line FROM customer)"""


@query("read_gold", """
SELECT 'd' || c_custkey AS doc_id, c_name AS mention, CASE WHEN c_custkey % 2 = 0 THEN 'PER' ELSE 'LOC' END AS label, 'kg/' || c_custkey AS gold_uri, CAST(NULL AS INT) AS start FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 11 <> 0
""")
def read_gold(spark, sf_dir):
    """Gold mentions from JSON lines, blank lines skipped, invalid rows left out."""
    path = _folder(spark)
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    customer.createOrReplaceTempView("customer")
    spark.sql(f"SELECT line FROM {GOLD_LINES} z").write.text(path)
    return sources.validated_gold(sources.read_gold(spark, path), fail=False).select("doc_id", "mention", "label", "gold_uri", "start")


@query("read_ner_gold", """
SELECT 'f' || c_custkey AS filename, CAST(c_custkey AS INT) AS entry, 'Here is ' || c_name AS paragraph, c_name AS text, 8 AS start, 8 + length(c_name) AS "end", 'LOC' AS label FROM customer UNION ALL SELECT 'f' || c_custkey, c_custkey, 'Here is ' || c_name, 'Here', 0, 4, 'PER' FROM customer
""")
def read_ner_gold(spark, sf_dir):
    """Gold paragraphs with their entities, JSON arrays of a hundred in a file each."""
    path = _folder(spark)
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("n_name"))
    ent = lambda t, a, b, label: F.struct(t.alias("text"), a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(label).alias("label"))
    ents = F.array(ent(F.col("n_name"), F.lit(8), F.length("n_name") + 8, "LOC"), ent(F.lit("Here"), F.lit(0), F.lit(4), "PER"))
    row = F.struct(
        F.concat(F.lit("f"), "k").alias("filename"), F.col("k").cast("int").alias("entry"),
        F.concat(F.lit("Here is "), "n_name").alias("paragraph"), ents.alias("ents")
    )
    _write_each(n.groupBy(F.floor(F.col("k") / 100)).agg(F.to_json(F.collect_list(row)).alias("value")).select("value"), path)
    return sources.read_ner_gold(spark, path).select("filename", "entry", "paragraph", "text", "start", "end", "label")


@query("candidate_cache", "SELECT p_brand AS brand, p_partkey AS k, 2 AS made FROM part")
def candidate_cache(spark, sf_dir):
    """Candidates that are made once: the second call reads what the first has written, and not the other table that it is offered."""
    path = _folder(spark)
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("k"))
    sources.read_candidates(spark, path, lambda: part.withColumn("made", F.lit(2)))
    return sources.read_candidates(spark, path, lambda: part.withColumn("made", F.lit(3)))


@query("response_json", """
SELECT doc_id, md5('{"visual":"v' || doc_id || '","normalized":"n","ranked_entities":[{"text":"' || source || '","rank":1}],"char_map":[0,1],"spans_lookup":[]}') AS digest FROM documents
""")
def response_json(spark, sf_dir):
    """The answer to a request, as JSON."""
    d = docs(spark, sf_dir)
    spans = F.array().cast("array<struct<start:int,end:int>>")
    made = d.select(
        "doc_id", F.concat(F.lit("v"), F.col("doc_id")).alias("visual"), F.lit("n").alias("normalized"),
        F.array(F.lit(0), F.lit(1)).alias("char_map"),
        F.array(F.struct(F.col("source").alias("text"), F.lit(1).alias("rank"))).alias("ranked_entities"), spans.alias("spans_lookup")
    )
    return sources.response_json(made).select("doc_id", F.md5("json").alias("digest"))


@query("result_files", """
WITH m AS (SELECT n_regionkey AS r, count(*) AS n, CAST(sum(n_nationkey % 2) AS BIGINT) AS tp FROM nation GROUP BY n_regionkey)
SELECT 'csv' AS kind, 'r' || r AS record, printf('%.4f', tp / n + 0.0000001) AS precision, n FROM m UNION ALL SELECT 'json', 'r' || r, printf('%.4f', tp / n + 0.0000001), n FROM m
""")
def result_files(spark, sf_dir):
    """Metrics written as CSV with ratios to four places and as JSON, and read again."""
    path = _folder(spark)
    m = star_sql(spark, sf_dir, "SELECT n_regionkey AS r, count(*) AS n, sum(n_nationkey % 2) AS tp FROM nation GROUP BY n_regionkey")
    ratio = evaluate.share(F.col("tp"), F.col("n")) + 0.0000001
    rows = m.select(
        F.concat(F.lit("r"), "r").alias("record"), F.lit("f").alias("filename"), F.lit(1).alias("entry"), F.lit("raw").alias("mode"),
        F.col("n").alias("gold_count"), F.col("n").alias("pred_count"), F.col("tp").alias("tp_count"), F.lit(0).alias("fp_count"),
        F.lit(0).alias("fn_count"), ratio.alias("precision"), F.lit(0.0).alias("recall"), F.lit(0.0).alias("f1")
    )
    sources.write_metrics_csv(rows, f"{path}/csv")
    sources.write_json(rows, f"{path}/json")
    csv = spark.read.option("header", True).csv(f"{path}/csv").select(
        F.lit("csv").alias("kind"), "record", "precision", F.col("gold_count").cast("long").alias("n")
    )
    json = spark.read.json(f"{path}/json").select(
        F.lit("json").alias("kind"), "record", F.format_string("%.4f", "precision").alias("precision"), F.col("gold_count").alias("n")
    )
    return csv.unionByName(json)
