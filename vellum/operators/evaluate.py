"""Evaluation: span precision and recall, ranking and retrieval metrics, weight sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.strings import filled
from vellum.operators.rows import dealt
from vellum.operators.score import PERSON_WEIGHTS, PLACE_WEIGHTS, redistribute


def share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def span_set(spans: DataFrame, by: list[str]) -> DataFrame:
    return spans.filter(
        "start IS NOT NULL AND end IS NOT NULL AND label IS NOT NULL AND start < end"
    ).select(*by, "start", "end", "label").distinct()


def span_scores(gold: DataFrame, predicted: DataFrame, by: list[str]) -> DataFrame:
    """gold_count, pred_count, tp_count, fp_count, fn_count, precision, recall, f1 for each group and, with a null group, overall."""
    g, p = span_set(gold, by).withColumn("_g", F.lit(1)), span_set(predicted, by).withColumn("_p", F.lit(1))
    both = g.join(p, [*by, "start", "end", "label"], "full_outer")
    tp, fp, fn = (
        F.sum(F.when(c, 1).otherwise(0))
        for c in (F.col("_g").isNotNull() & F.col("_p").isNotNull(), F.col("_g").isNull(), F.col("_p").isNull())
    )
    counted = both.groupingSets([[F.col(c) for c in by], []], *by).agg(
        (tp + fn).alias("gold_count"), (tp + fp).alias("pred_count"), tp.alias("tp_count"), fp.alias("fp_count"), fn.alias("fn_count")
    )
    out = counted.withColumns(
        {"precision": share(F.col("tp_count"), F.col("pred_count")), "recall": share(F.col("tp_count"), F.col("gold_count"))}
    )
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def span_difference(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Spans in one set only, with `side` a or b."""
    usable = F.expr("start IS NOT NULL AND end IS NOT NULL AND label IS NOT NULL AND start < end")
    keys = [*by, "start", "end", "label"]
    x, y = (s.filter(usable).select(*keys, F.lit(i).alias("_side")) for i, s in enumerate((a, b)))
    sides = dealt(x.unionByName(y), *by).groupBy(*keys).agg(F.min("_side").alias("_first"), F.max("_side").alias("_last"))
    return sides.filter("_first = _last").select(*keys, F.when(F.col("_first") == 0, "a").otherwise("b").alias("side"))


def reciprocal_rank(uris: Column, gold: Column) -> Column:
    at = F.array_position(uris, gold)
    return F.when(at > 0, 1 / at.cast("double")).otherwise(F.lit(0.0))


def hit_at(uris: Column, gold: Column, k: int) -> Column:
    return F.array_contains(F.slice(uris, 1, k), gold).cast("int")


def ranked_uris(ranked: DataFrame, by: list[str], uri: str, rank: str = "rank") -> DataFrame:
    return ranked.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, uri))), lambda x: x[uri]).alias("ranked_uris"))


def mention_metrics(rows: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """rows(gold_uri, ranked_uris) with rr, hit@k and retrieved."""
    uris = F.coalesce("ranked_uris", F.array().cast("array<string>"))
    out = rows.withColumn("rr", reciprocal_rank(uris, F.col("gold_uri")))
    for k in ks:
        out = out.withColumn(f"hit_{k}", hit_at(uris, F.col("gold_uri"), k))
    return out.withColumns({"retrieved": F.array_contains(uris, F.col("gold_uri")).cast("int"), "n_candidates": F.size(uris)})


def ranking_summary(rows: DataFrame, ks=(1, 3, 5)) -> DataFrame:
    """n, coverage, acc_1, mrr and recall_k for each label and, with a null label, overall."""
    return rows.groupingSets([[F.col("label")], []], "label").agg(
        F.count("*").alias("n"), F.avg("retrieved").alias("coverage"), F.avg("hit_1").alias("acc_1"), F.avg("rr").alias("mrr"), *[
            F.avg(f"hit_{k}").alias(f"recall_{k}") for k in ks
        ])


def retrieval_summary(rows: DataFrame) -> DataFrame:
    """set_recall and the mean number of candidates, overall, where the gold one is among them and where not, by label and overall."""
    hit = F.col("retrieved") == 1
    return rows.groupingSets([[F.col("label")], []], "label").agg(
        F.count("*").alias("n"), F.avg("retrieved").alias("set_recall"), F.avg("n_candidates").alias("avg_candidates"),
        F.coalesce(F.avg(F.when(hit, F.col("n_candidates"))), F.lit(0.0)).alias("avg_when_hit"), F.coalesce(
            F.avg(F.when(~hit, F.col("n_candidates"))), F.lit(0.0)
        ).alias("avg_when_miss"))


# The weights that a sweep tries.
SWEEP = (
    ("PER", "name", (0.20, 0.25, 0.32, 0.38, 0.44)), ("PER", "era", (0.10, 0.15, 0.20, 0.25, 0.30)),
    ("LOC", "hierarchy", (0.15, 0.20, 0.25, 0.30, 0.35)), ("LOC", "name", (0.15, 0.20, 0.25, 0.30, 0.35))
)


def sweep_configs() -> list[tuple[str, dict[str, float], dict[str, float]]]:
    """(config, person weights, place weights): one feature's weight is set, the others of its label are scaled."""
    out = []
    for label, feature, values in SWEEP:
        for v in values:
            per = redistribute(PERSON_WEIGHTS, feature, v) if label == "PER" else dict(PERSON_WEIGHTS)
            loc = redistribute(PLACE_WEIGHTS, feature, v) if label == "LOC" else dict(PLACE_WEIGHTS)
            out.append((f"{label} {feature}={v:.2f}", per, loc))
    return out


def weight_sweep(features: DataFrame, by: list[str], configs=None, k: int = 5, uri: str = "uri", order: str = "ord") -> DataFrame:
    """ranking_summary() for each configuration over one table of features.

    features: by, label, gold_uri, uri, ord and a map `features` of name to score. The features are computed once;
    each row is scored under every configuration, a table of a few rows.
    """
    spark = features.sparkSession
    configs = configs or sweep_configs()
    rows = [(name, label, w) for name, per, loc in configs for label, w in (("PER", per), ("LOC", loc))]
    table = F.broadcast(spark.createDataFrame(rows, "config string, label string, weights map<string,double>"))
    score = F.aggregate(
        F.map_entries("weights"), F.lit(0.0), lambda s,
        e: s + e["value"] * F.coalesce(F.try_element_at(F.col("features"), e["key"]), F.lit(0.0))
    )
    scored = features.join(table, "label").withColumn("score", F.round(score, 9))
    ranked = scored.withColumn(
        "rank", F.row_number().over(Window.partitionBy("config", *by).orderBy(F.desc("score"), order))
    ).filter(F.col("rank") <= k)
    lists = ranked.groupBy("config", *by, "label", "gold_uri").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", uri))), lambda x: x[uri]).alias("ranked_uris")
    )
    m = mention_metrics(lists)
    return m.groupingSets([[F.col("config"), F.col("label")], [F.col("config")]], "config", "label").agg(
        F.count("*").alias("n"), F.avg("hit_1").alias("acc_1"), F.avg("rr").alias("mrr"), F.avg("hit_3").alias("recall_3")
    )


def baseline_score(mention: Column, label: Column, similar) -> Column:
    """.5 exact + .3 similarity + .2 similarity of the sorted words, of lower-case trimmed strings; similar(a, b) in 0..1."""
    tidy = lambda c: F.regexp_replace(F.trim(F.lower(F.coalesce(c, F.lit("")))), r"(?U)\s+", " ")
    a, b = tidy(mention), tidy(label)
    order = lambda c: F.array_join(F.array_sort(F.split(c, " ")), " ")
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(
        0.5 * (a == b).cast("double") + 0.3 * similar(a, b) + 0.2 * similar(order(a), order(b))
    )


def candidate_label(label: Column, fields: dict[str, Column]) -> Column:
    """What a baseline compares: a person's label or URI; a place's label, English label or URI."""
    return F.when(label == "PER", F.coalesce(filled(fields["label"]), fields["person"])).otherwise(
        F.coalesce(filled(fields["label"]), filled(fields["english_label"]), fields["place"])
    )


def candidate_uri(label: Column, person: Column, place: Column) -> Column:
    """What a candidate is known by: a person's URI for PER, a place's for LOC, nothing for other labels."""
    return F.when(label == "PER", person).when(label == "LOC", place)


def gold_by_document(gold: DataFrame, order: str = "ord") -> DataFrame:
    """(doc_id, mentions): a document's gold rows in their order. A row without a document is one of its own, `__row_` and its place."""
    own = F.coalesce(filled(F.col("doc_id")), F.concat(F.lit("__row_"), F.col(order).cast("string")))
    rows = gold.groupBy(own.alias("doc_id")).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), "mention", "label", "gold_uri"))).alias("mentions")
    )
    return rows


def assign_spans(gold: DataFrame, texts: DataFrame) -> DataFrame:
    """Gold mentions (doc_id, ord, label, mention) with start and end: the nth mention of a key takes the nth occurrence in the text,
    beyond the last one the first again; without any, 0 and the mention's length."""
    nth = Window.partitionBy("doc_id", "label", "mention").orderBy("ord")
    rows = gold.withColumn("_nth", F.row_number().over(nth) - 1).join(texts.select("doc_id", "full"), "doc_id", "left")
    low, m = F.lower(F.coalesce("full", F.lit(""))), F.lower("mention")
    parts = F.split(low, F.concat(F.lit("\\Q"), m, F.lit("\\E")), -1)
    many = F.size(parts) - 1
    k = F.when(F.col("_nth") < many, F.col("_nth")).otherwise(F.lit(0))
    start = F.aggregate(F.slice(parts, F.lit(1), k + 1), F.lit(0), lambda s, x: s + F.length(x)) + k * F.length("mention")
    return rows.withColumn(
        "start", F.when((many > 0) & (m != ""), start).otherwise(F.lit(0)).cast("int")
    ).withColumn("end", (F.col("start") + F.length("mention")).cast("int")).drop("_nth", "full")


def document_number(doc_id: Column) -> Column:
    return F.regexp_extract(doc_id, r"(?i)doc(?:ument)?_?(\d+)", 1).try_cast("int")


def resolve_context(gold: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, context): the first filled context of a document's rows, else the text of the file with the document's number."""
    own = gold.groupBy("doc_id").agg(
        F.min_by("context", F.when(filled(F.col("context")).isNotNull(), F.col("ord"))).alias("_own")
    ).withColumn("number", document_number(F.col("doc_id")))
    return own.join(files.select("number", "text"), "number", "left").select(
        "doc_id", F.coalesce(filled(F.col("_own")), "text").alias("context")
    )
