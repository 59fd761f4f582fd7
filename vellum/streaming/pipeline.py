"""The annotation pipeline over a stream of documents, in micro-batches of the same batch functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.operators import filters, normalize, spans, tag
from vellum.operators.rows import keyed, named
from vellum.plans.durable import settle

SCHEMA = "doc_id string, text string"


def annotate(docs: DataFrame, mode: str = "heuristic", tagger: str = "rules", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The batch pipeline as far as unique entities: normalise, tag, merge, filter. Documents are taken each for itself, whatever their ids."""
    norm = normalize.normalize(docs, mode, id_col=id_col, text_col=text_col)
    texts, names = keyed(norm, "doc_id", "normalized")
    texts = settle(texts) if names is None else texts  # read by several steps
    found = tag.analyze(texts.withColumnRenamed("full", "text"), tagger)
    merged = spans.merge_adjacent(found, texts, max_gap=6, min_score=0.55, extend_o=True)
    return named(filters.unique_entities(spans.clip_to_text(merged, texts)), names)


def annotate_stream(spark: SparkSession, source: str, target: str, checkpoint: str, fmt: str = "json"):
    """Start a query that annotates each file put into source and appends its entities to target as Parquet.

    The pipeline keeps no state between documents, so each micro-batch is a batch job; a batch that is
    repeated after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        annotate(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(SCHEMA).format(fmt).load(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
