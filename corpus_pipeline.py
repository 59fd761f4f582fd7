"""From raw documents to shards, in five stages over whole tables.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and returns a DataFrame;
a runner writes each result as Parquet and reads it again. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import decontaminate, jaccard_join, language, mixing, sharding
from vellum.llm.common import checkpoint_folder, table

#: Words in a block of the mix, output shards.
BLOCK_WORDS = 128
N_SHARDS = 8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: lang is the predicted language where it was null or blank; documents go whose language cannot be told.

    Those are texts without letters (null and empty ones among them) and texts that two languages explain equally well (a score
    of 0: some of a few words). It learns from the fold that is not held out. Without labels no language is known and all go; an empty
    table stays one; rows that repeat share their fate; columns of any other names pass.
    """
    return language.identified_documents(docs, docs.filter(~language.held_out()), min_score=0.0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near duplicates the document with the smallest id stays.

    Rows with a null id and texts without words stay; rows that repeat whole or share an id go or stay together.
    """
    return jaccard_join.one_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents go that contain three quarters of an item or more.

    Null and empty texts contain nothing and stay; rows that share an id, null ones among them, go or stay together.
    """
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each row is a stretch of a document that a block of the mix holds, as often as the mix takes it.

    text is the stretch and n_chars its length; the other columns are the document's. Null, empty and white texts are in no
    stretch; rows that repeat whole are each taken for themselves.
    """
    own = {"doc_id", "text", "source"} | {"n_chars"}
    mixed = mixing.mix_documents(docs, N_SHARDS, BLOCK_WORDS, keep=[c for c in docs.columns if c not in own])
    made = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return mixed.select(
        *[made[c].alias(c) if c in made else F.col(c) if c in own else F.col("kept").getField(c).alias(c) for c in docs.columns]
    )


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sharding: a shard and a slot for every row, reproducibly shuffled.

    The columns of docs follow those of the operator; one with the name of one of these gets underscores behind it.
    Null and empty texts, repeated rows and null ids are placed like any other row.
    """
    return sharding.shard_documents(docs, N_SHARDS, keep=[c for c in docs.columns if c != "doc_id"])


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Cross-parsing, signatures and keyed draws have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is a Parquet table in the shared checkpoint folder.

    A stage's table is removed when the next one is written; the last of them is what the returned rows are read from.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _remove(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
