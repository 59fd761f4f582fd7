"""A tagger fitted on documents that have persons and places planted in them, beside the tagger by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import lexicon as L
from vellum.operators import evaluate, perceptron, tag
from vellum.operators.rows import dealt
from vellum.plans.registry import query
from vellum.plans.text_queries import docs

_GIVEN = sorted({x.capitalize() for x in L.FIRST_NAMES} | {"John", "William", "Thomas", "Robert", "Henry", "Hugh", "Mary", "Ellen", "Anne", "Margaret"})
_SURNAMES = sorted({x.capitalize() for x in L.SURNAMES if x.isalpha()})
_PLACES = sorted({x.capitalize() for x in L.PLACE_NAMES if x.isalpha()})
_COUNTIES = sorted({x.capitalize() for x in L.COUNTIES})
#: Sentences of depositions; a slot is a person's or a place's.
_SENTENCES = (
    "The said |{full}| of |{place}| in the County of |{county}| deposeth that he was robbed of his cowes",
    "Mr |{surname}| late of |{place}| came before us with his wife and children",
    "And further this deponent saith that |{full}| was slain near |{place}| by the rebels",
    "{full}| and |{other}| took the castle of |{place}| and all that was in it",
    "Sir |{surname}| sent his men to |{place}| and to |{county}| in the moneth of May",
    "Then came one |{surname}|, a yeoman, and The Irish went to |{county}| again",
)


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2


def planted(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text, held_out) with a sentence behind each text, and its gold spans. One name in four is in held-out documents alone."""
    n = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.lit(2**31)).cast("int")

    def pick(names: list[str], salt: str) -> Column:
        known, new = [x for i, x in enumerate(names) if i % 4], [x for i, x in enumerate(names) if i % 4 == 0]
        choose = lambda own: F.element_at(F.array(*map(F.lit, own)), F.pmod(n(salt), F.lit(len(own))) + 1)
        return F.when(held_out() & (F.pmod(n(salt + "?"), F.lit(2)) == 0), choose(new)).otherwise(choose(known))

    slots = {
        "full": F.concat(pick(_GIVEN, "g"), F.lit(" "), pick(_SURNAMES, "s")), "surname": pick(_SURNAMES, "s"), "other": F.concat(pick(_GIVEN, "h"), F.lit(" "), pick(_SURNAMES, "t")),
        "place": pick(_PLACES, "p"), "county": pick(_COUNTIES, "c")
    }
    rows = texts.withColumns({f"_{k}": c for k, c in slots.items()})
    chosen = F.element_at(F.array(*map(F.lit, _SENTENCES)), F.pmod(n("t"), F.lit(len(_SENTENCES))) + 1)
    rows = rows.withColumn("_pieces", F.split(F.concat(F.lit("\n|"), chosen, F.lit("|.\n")), r"\|"))

    def filled(piece: Column) -> Column:
        out = piece
        for k in slots:
            out = F.when(piece == f"{{{k}}}", F.col(f"_{k}")).otherwise(out)
        return out

    rows = rows.withColumn("_values", F.transform("_pieces", filled))
    start = lambda i: F.length("text") + F.length(F.array_join(F.slice("_values", 1, i), ""))
    label = F.when(F.col("piece").isin("{place}", "{county}"), "LOC").otherwise("PER")
    out = rows.select("doc_id", F.concat("text", F.array_join("_values", "")).alias("text"), held_out().alias("held_out"))
    each = rows.select("doc_id", held_out().alias("held_out"), "text", "_values", F.posexplode("_pieces").alias("i", "piece")).filter(F.col("piece").startswith("{"))
    spans = each.withColumn("start", start(F.col("i"))).select(
        "doc_id", "held_out", "start", (F.col("start") + F.length(F.get("_values", F.col("i")))).alias("end"), label.alias("label")
    )
    return out, spans


def fitted(texts: DataFrame, gold: DataFrame) -> perceptron.Model:
    return perceptron.fit(texts.filter(~F.col("held_out")), gold.filter(~F.col("held_out")))


def overall_scores(gold: DataFrame, predicted: DataFrame, by: list[str]) -> DataFrame:
    """The overall row of evaluate.span_scores() for each tagger, of documents held out and not: all sets of spans meet in one exchange, by document."""
    keys = ["tagger", "doc_id", "start", "end", "label"]
    usable = "doc_id IS NOT NULL AND start IS NOT NULL AND end IS NOT NULL AND label IS NOT NULL AND start < end"
    g, p = (s.filter(usable).select(*keys, F.lit(i == 0).alias("_g")) for i, s in enumerate((gold, predicted)))
    each = dealt(g.unionByName(p), "doc_id").groupBy(*keys).agg(F.bool_or("_g").alias("_gold"), (~F.bool_and("_g")).alias("_found"))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counted = each.withColumn("held_out", held_out()).groupBy(*by).agg(
        n(F.col("_gold")).alias("gold_count"), n(F.col("_found")).alias("pred_count"), n(F.col("_gold") & F.col("_found")).alias("tp_count"),
        n(~F.col("_gold")).alias("fp_count"), n(~F.col("_found")).alias("fn_count")
    )
    p, r = evaluate.share(F.col("tp_count"), F.col("pred_count")), evaluate.share(F.col("tp_count"), F.col("gold_count"))
    out = counted.withColumns({"precision": p, "recall": r})
    out = out.withColumn("f1", evaluate.share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return out.select(*[c for c in out.columns if c not in by], *by)


@query("fitted_tagger")
def fitted_tagger(spark, sf_dir):
    """Precision and recall of the fitted tagger and of the one by rules on all planted documents, those it has learned from and those held out."""
    texts, gold = planted(docs(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    perceptron.register("fitted", fitted(texts, gold))
    pieces = texts.select("doc_id", F.lit(0).alias("off"), F.col("text").alias("chunk"))
    found = [tag.keep_allowed(tag.TAGGERS[name](pieces)).withColumn("tagger", F.lit(name)) for name in ("fitted", "rules")]
    twice = gold.withColumn("tagger", F.explode(F.array(F.lit("fitted"), F.lit("rules"))))
    return overall_scores(twice, found[0].unionByName(found[1]), ["tagger", "held_out"])
