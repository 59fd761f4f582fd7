"""The registered queries opN_<name> of this subpackage and the pipeline, with oracle SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import (
    decontaminate, html_text, infill, jaccard_join, language, merkle, mixing, oracles, resample, sharding, substring_dedup, surrogates, tokens, topk
)
from vellum.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs, docs.filter(~language.held_out()))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score", "n_letters")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)
    return placed.selectExpr("doc_id", "size", "text_crc32", "law", "shard", "slot", "CAST(NULL AS INT) AS grown_shard")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.compare_with_edited(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "edited_sections",
        "edited_leaves"
    )


def op6_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace_entities(table(spark, sf_dir, "documents"), surrogates.session_key(spark))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return scored.select("doc_id", "n_features", "weight", "score", "rank")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_token_counts, op2_decontaminate, op3_language, op4_sharding, op5_mixing, op6_surrogates, op7_html_text, op8_substring_dedup,
            op9_jaccard_join, op10_merkle, op11_infill, op12_topk, op13_resample, pipeline
        )
    }


def oracle_sql() -> dict:
    return {
        "op2_decontaminate": oracles.DECONTAMINATE, "op4_sharding": oracles.sharding(8, sharding.KEY),
        "op8_substring_dedup": oracles.SUBSTRINGS, "op9_jaccard_join": oracles.JACCARD, "op10_merkle": merkle.oracle(),
        "op11_infill": oracles.INFILL, "op12_topk": oracles.TOPK, "op13_resample": oracles.RESAMPLE
    }
