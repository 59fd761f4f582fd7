"""Filters of entity spans and their grouping by text and label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import lexicon as L

MIN_SCORE = 0.7


def canonical_person(text: Column) -> Column:
    """Straight apostrophes, and a capital after `O'` at a word's start."""
    parts = F.split(F.replace(text, F.lit("’"), F.lit("'")), r"(?U)(?<=\bO')", -1)
    raised = lambda p, i: F.when((i > 0) & p.rlike("^[a-z]"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))).otherwise(p)
    return F.array_join(F.transform(parts, raised), "")


def canonical(spans: DataFrame) -> DataFrame:
    trimmed = F.regexp_replace("text", r"(?U)^\s+|\s+$", "")
    lower_o = F.contains(F.col("text"), F.lit("'")) | F.contains(F.col("text"), F.lit("’"))
    return spans.withColumn(
        "text", F.when(F.col("label") == "PER", F.when(lower_o, canonical_person(trimmed)).otherwise(trimmed)).otherwise(F.col("text"))
    )


def keep(text: Column, label: Column, score: Column, min_score: float = MIN_SCORE) -> Column:
    """Not a stop phrase, not a cut-off `O'xx`, three characters or more, and sure enough."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return ~bare.isin(*L.STOP_PHRASES) & ~(
        (label == "PER") & bare.rlike("^[Oo]['’][A-Za-z]{1,3}$")
    ) & (F.length(bare) >= 3) & (score >= min_score)


def unique_entities(spans: DataFrame, min_score: float = MIN_SCORE, order: str | None = None) -> DataFrame:
    """(doc_id, text, label, score, start, end, spans): one row for each text and label of a document, in its first span's words.

    A place that two texts or labels share belongs to the first of them; a group all of whose places
    are taken keeps an empty list. `order` names the column of the spans' order; without it (start, end, label, text).
    """
    first = [F.col(order)] if order else [F.col("start"), F.col("end"), F.col("label"), F.col("text"), F.desc("score")]
    kept = canonical(spans).filter(keep(F.col("text"), F.col("label"), F.col("score"), min_score))
    kept = kept.withColumn("_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy(*first)))
    kept = kept.withColumn("_own", F.row_number().over(Window.partitionBy("doc_id", "start", "end").orderBy("_ord")) == 1)
    lead = F.min_by(F.struct("score", "start", "end"), "_ord").alias("_e")
    place = F.array_sort(F.collect_list(F.when(F.col("_own"), F.struct("_ord", "start", "end", "score"))))
    grouped = kept.groupBy("doc_id", "text", "label").agg(lead, place.alias("_p"))
    return grouped.select(
        "doc_id", "text", "label", "_e.score", "_e.start", "_e.end",
        F.transform("_p", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["score"].alias("score"))).alias("spans")
    )


def document_locations(unique: DataFrame) -> DataFrame:
    """(doc_id, locations): the lower-case LOC texts of each document."""
    return unique.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("label") == "LOC", F.lower("text")))).alias("locations"))
