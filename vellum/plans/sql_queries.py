"""Queries that are SQL alone, by the registered functions."""

from __future__ import annotations

from vellum import sql
from vellum.plans.registry import query
from vellum.plans.span_queries import SQL_SPANS
from vellum.plans.text_queries import SQL_CHUNKS


def _run(spark, sf_dir, text: str):
    """text over the table `documents`, which is read from sf_dir."""
    sql.register(spark)
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("documents")
    return spark.sql(text)


@query("sql_chunks", f"WITH RECURSIVE {SQL_CHUNKS} SELECT doc_id, count(*) AS n_chunks, CAST(sum(s) AS BIGINT) AS sum_off, CAST(sum(e - s) AS BIGINT) AS n_chars FROM c GROUP BY doc_id")
def sql_chunks(spark, sf_dir):
    return _run(spark, sf_dir, """
SELECT doc_id, count(*) AS n_chunks, sum(off) AS sum_off, sum(length(chunk)) AS n_chars FROM vellum_chunks(TABLE(SELECT doc_id, text FROM documents)) GROUP BY doc_id""")


@query("sql_tags", f"""
WITH {SQL_SPANS} SELECT label, text, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM spans GROUP BY label, text HAVING count(DISTINCT doc_id) > 1
""")
def sql_tags(spark, sf_dir):
    return _run(spark, sf_dir, """
SELECT label, text, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM vellum_tags(TABLE(SELECT doc_id, text FROM documents)) GROUP BY label, text HAVING count(DISTINCT doc_id) > 1""")
