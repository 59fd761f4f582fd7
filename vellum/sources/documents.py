"""Readers of documents, gold files, lexicons and graphs, and writers of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = "doc_id string, mention string, label string, gold_uri string, start int, end int, context string"
NER_GOLD = "filename string, entry int, paragraph string, ents array<struct<text:string,start:int,end:int,label:string>>"
METRICS = (
    "record", "filename", "entry", "mode", "gold_count", "pred_count", "tp_count", "fp_count", "fn_count", "precision", "recall", "f1"
)


def kind_of(name: Column, content: Column) -> Column:
    """xml by the name's ending or the first 500 characters, empty, or text."""
    head = F.substring(content, 1, 500)
    marked = F.lower(name).rlike(r"\.(xml|tei)$") | F.contains(head, F.lit("<?xml")) | F.contains(head, F.lit("<TEI"))
    return F.when(marked, "xml").when(F.length(content) == 0, "empty").otherwise("text")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, visual): whole text files, their path for an id."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("visual"))


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, kind, visual, error): files of any kind; undecodable ones have an error and no text. Spark's reader passes over files of no bytes."""
    raw = spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), "content")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    rows = raw.select("doc_id", text.alias("content"), F.length("content").alias("_n")).withColumn(
        "kind", F.when(F.col("_n") == 0, "empty").otherwise(kind_of(F.col("doc_id"), F.col("content")))
    )
    error = F.when(F.col("kind") == "empty", "empty file").when(F.col("content").isNull(), "not UTF-8")
    plain = F.when(F.col("kind") == "xml", tei_visual(tei_paragraphs(F.col("content")))).otherwise(F.col("content"))
    return rows.select("doc_id", "kind", F.when(error.isNull(), plain).alias("visual"), error.alias("error"))


def tei_paragraphs(xml: Column) -> Column:
    """Text of the paragraphs, whatever the namespace, white space trimmed."""
    return F.filter(
        F.transform(F.xpath(xml, F.lit('//*[local-name()="p"]/text()')), lambda x: F.regexp_replace(x, r"^[\r\n\t]+|[\r\n\t]+$", "")),
        lambda x: F.trim(x) != ""
    )


def tei_visual(paragraphs: Column) -> Column:
    return F.array_join(paragraphs, "\n")


def tei_pages(xml: Column) -> Column:
    """Numbers of the page breaks."""
    return F.xpath(xml, F.lit('//*[local-name()="pb"]/@n'))


def extract_tei(docs: DataFrame, id_col: str = "doc_id", content_col: str = "content") -> DataFrame:
    """(doc_id, visual, paragraphs, pages) of TEI documents."""
    p = docs.select(
        F.col(id_col).alias("doc_id"), tei_paragraphs(F.col(content_col)).alias("paragraphs"), tei_pages(F.col(content_col)).alias("pages")
    )
    return p.select("doc_id", tei_visual(F.col("paragraphs")).alias("visual"), "paragraphs", "pages")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of requests, a JSON object a line. A line that is none, or has no text, is a row without text."""
    return spark.read.schema("doc_id string, text string").json(path)


def read_gold(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Gold mentions from JSON lines or a JSON array; blank lines are skipped."""
    return spark.read.schema(GOLD).option("multiLine", array).json(path).filter(
        "mention IS NOT NULL OR label IS NOT NULL OR gold_uri IS NOT NULL"
    )


def validated_gold(gold: DataFrame, fail: bool = True) -> DataFrame:
    """Rows with a mention, a gold URI and a label of PER or LOC; another one fails the job, or is dropped."""
    ok = F.coalesce((F.trim("mention") != "") & (F.trim("gold_uri") != "") & F.col("label").isin("PER", "LOC"), F.lit(False))
    if not fail:
        return gold.filter(ok)
    return gold.filter(
        F.when(ok, F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit("invalid gold row: "), F.to_json(F.struct(*gold.columns)))).cast("boolean")
        )
    )


def read_ner_gold(spark: SparkSession, path: str) -> DataFrame:
    """(filename, entry, paragraph, text, start, end, label), one row an entity."""
    return spark.read.schema(NER_GOLD).option("multiLine", True).json(path).select(
        "filename", "entry", "paragraph", F.explode("ents").alias("e")
    ).select("filename", "entry", "paragraph", "e.*")


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """(kind, term) of a JSON object of string lists."""
    raw = spark.read.text(path, wholetext=True)
    lists = F.from_json("value", "map<string,array<string>>", {"mode": "PERMISSIVE"})
    return raw.select(F.explode(lists).alias("kind", "terms")).select("kind", F.explode("terms").alias("term"))


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(old, new), lower case, of a JSON object of strings."""
    return spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "map<string,string>")).alias("old", "new")
    ).select(F.lower("old").alias("old"), F.lower("new").alias("new"))


def read_candidates(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at path; where there is none yet, make() is written there first. Candidates are retrieved once for many sweeps."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    make().write.parquet(path)
    return spark.read.parquet(path)


def response_json(docs: DataFrame) -> DataFrame:
    """(doc_id, json) of (doc_id, visual, normalized, char_map, ranked_entities, spans_lookup)."""
    return docs.select("doc_id", F.to_json(F.struct("visual", "normalized", "ranked_entities", "char_map", "spans_lookup")).alias("json"))


def write_metrics_csv(metrics: DataFrame, path: str) -> None:
    """The twelve metric columns as CSV with a header, ratios to 4 places."""
    ratio = {c: F.format_string("%.4f", F.col(c).cast("double")) for c in ("precision", "recall", "f1")}
    metrics.select(*[ratio.get(c, F.col(c)).alias(c) for c in METRICS]).write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)
