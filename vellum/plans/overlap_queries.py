"""Interval joins of spans: partial matches of two taggings, and what spans cover."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import overlap
from vellum.plans.eval_queries import _SQL_PRED, _sides
from vellum.plans.registry import query
from vellum.plans.span_queries import SQL_NESTED, SQL_SPANS, nested, tagged

#: Each span against spans moved by 3 characters, and against long ones that begin at every span of place 0 to 9 in a hundred.
_MOVED = f"""{SQL_SPANS},
moved AS (SELECT doc_id, label, start + 3 AS start, "end" + 3 AS "end" FROM spans UNION ALL SELECT doc_id, label, start, "end" + 2000 FROM spans WHERE start % 100 < 10)"""


@query("overlap_spans", f"""
WITH {_MOVED} SELECT a.doc_id, a.start AS a_start, a."end" AS a_end, a.label AS a_label, b.start AS b_start, b."end" AS b_end, b.label AS b_label,
  CAST(least(a."end", b."end") - greatest(a.start, b.start) AS BIGINT) AS n_shared FROM spans a JOIN moved b ON a.doc_id = b.doc_id AND a.start < b."end" AND b.start < a."end"
""")
def overlap_spans(spark, sf_dir):
    s = tagged(spark, sf_dir)
    both = F.array(
        F.struct((F.col("start") + 3).alias("start"), (F.col("end") + 3).alias("end")),
        F.when(F.col("start") % 100 < 10, F.struct(F.col("start").alias("start"), (F.col("end") + 2000).alias("end")))
    )
    moved = s.select("doc_id", "label", F.explode(F.array_compact(both)).alias("m")).select("doc_id", "label", "m.*")
    pairs = overlap.overlap_join(s.select("doc_id", "start", "end", "label"), moved, ["doc_id"])
    return pairs.select(
        "l.doc_id", *[F.col(f"{x}.{c}").alias(f"{y}_{c}") for x, y in (("l", "a"), ("r", "b")) for c in ("start", "end", "label")], "n_shared"
    )


@query("partial_prf", f"""
WITH {_SQL_PRED},
gm AS (SELECT g.label, max(CASE WHEN p.start IS NULL THEN 0 WHEN p.start = g.start AND p."end" = g."end" THEN 2 ELSE 1 END) AS m FROM gold g LEFT JOIN pred p ON g.doc_id = p.doc_id AND g.label = p.label AND g.start < p."end" AND p.start < g."end" GROUP BY g.doc_id, g.start, g."end", g.label),
pm AS (SELECT p.label, max(CASE WHEN g.start IS NULL THEN 0 WHEN p.start = g.start AND p."end" = g."end" THEN 2 ELSE 1 END) AS m FROM (SELECT * FROM pred WHERE start < "end") p LEFT JOIN gold g ON g.doc_id = p.doc_id AND g.label = p.label AND g.start < p."end" AND p.start < g."end" GROUP BY p.doc_id, p.start, p."end", p.label),
a AS (SELECT label, count(*) FILTER (WHERE m = 2) AS gold_exact, count(*) FILTER (WHERE m = 1) AS gold_partial, count(*) FILTER (WHERE m = 0) AS missing FROM gm GROUP BY ROLLUP (label)),
b AS (SELECT label, count(*) FILTER (WHERE m = 2) AS pred_exact, count(*) FILTER (WHERE m = 1) AS pred_partial, count(*) FILTER (WHERE m = 0) AS spurious FROM pm GROUP BY ROLLUP (label)),
c AS (SELECT coalesce(a.label, b.label) AS label, coalesce(gold_exact, 0) AS gold_exact, coalesce(gold_partial, 0) AS gold_partial, coalesce(missing, 0) AS missing,
  coalesce(pred_exact, 0) AS pred_exact, coalesce(pred_partial, 0) AS pred_partial, coalesce(spurious, 0) AS spurious FROM a FULL JOIN b ON a.label IS NOT DISTINCT FROM b.label),
r AS (SELECT *, CASE WHEN pred_exact + pred_partial + spurious = 0 THEN 0 ELSE (pred_exact + pred_partial / 2) / (pred_exact + pred_partial + spurious) END AS precision,
  CASE WHEN gold_exact + gold_partial + missing = 0 THEN 0 ELSE (gold_exact + gold_partial / 2) / (gold_exact + gold_partial + missing) END AS recall FROM c)
SELECT *, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM r
""")
def partial_prf(spark, sf_dir):
    """Exact and partial matches of gold spans and predictions with moved borders and changed labels."""
    return overlap.partial_scores(*_sides(spark, sf_dir), ["doc_id"])


@query("span_coverage", f"""
WITH {SQL_NESTED}, r AS (SELECT *, max("end") OVER (PARTITION BY doc_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM nested WHERE start < "end")
SELECT doc_id, count(*) AS n_spans, CAST(sum(greatest("end" - greatest(start, coalesce(reach, start)), 0)) AS BIGINT) AS n_covered, count(*) FILTER (WHERE reach IS NULL OR start > reach) AS n_islands FROM r GROUP BY doc_id
""")
def span_coverage(spark, sf_dir):
    return overlap.coverage(nested(spark, sf_dir), ["doc_id"])
