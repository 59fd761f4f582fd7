"""Interval joins: pairs of spans that overlap, without meeting all spans of a document with one another.

Places are cut into buckets of one width, and a span is listed under all buckets that it touches. The join is an equality of document and bucket, with the overlap
tested exactly; of the buckets that a pair shares, the one where the overlap begins reports it, so no pair is made twice and none has to be made distinct.
The width is the least of WIDTH, WIDTH * STEP, ... that is not below the spans' mean length, so spans are listed three times at most on the average, however long some
are, and a bucket is as narrow as that allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.evaluate import share

WIDTH = 64
STEP = 4


def width_for(mean: float | None) -> int:
    w = WIDTH
    while w < (mean or 0):
        w *= STEP
    return w


def _buckets(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width), F.floor((end - 1) / width))


def overlap_join(
    left: DataFrame, right: DataFrame, by: list[str], how: str = "inner", start: str = "start", end: str = "end", least: int = 1
) -> DataFrame:
    """Pairs (l, r, n_shared) of rows of left and right, as structs, with equal `by` whose spans share `least` characters or more.

    how: inner, or left (rows of left without a partner once, with null r and 0). Spans with a null or negative place or without length, and rows with a null key,
    have no partner. Rows that repeat are each paired. Any column names are allowed.
    """
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")

    keys = [f"_k{i}" for i in range(len(by))]

    def side(rows: DataFrame, tag: str) -> DataFrame:
        """Keys, places and the other columns, each value once."""
        rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rows.columns) if c not in (*by, start, end)]
        return rows.select(
            *[F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)], F.col(f"`{start}`").alias(f"{tag}_s"), F.col(f"`{end}`").alias(f"{tag}_e"),
            (F.struct(*rest) if rest else F.lit(None).cast("int")).alias(f"{tag}_c")
        )

    def again(rows: DataFrame, tag: str) -> Column:
        """The row as a struct with the columns that it had."""
        of = {**{c: F.col(k).cast(rows.schema[c].dataType) for c, k in zip(by, keys)}, start: F.col(f"{tag}_s"), end: F.col(f"{tag}_e")}
        return F.struct(*[(of[c] if c in of else F.col(f"{tag}_c.c{i}")).alias(c) for i, c in enumerate(rows.columns)])

    a, b = side(left, "_l"), side(right, "_r")
    if how == "left":
        a = a.withColumn("_row", F.monotonically_increasing_id())
    usable = lambda t: (F.col(f"{t}_s") >= 0) & (F.col(f"{t}_s") < F.col(f"{t}_e"))
    a_ok, b_ok = (x.filter(usable(t)) for x, t in ((a, "_l"), (b, "_r")))
    lengths = a_ok.select((F.col("_l_e") - F.col("_l_s")).alias("n")).union(b_ok.select((F.col("_r_e") - F.col("_r_s")).alias("n")))
    width = width_for(lengths.agg(F.avg("n")).first()[0])
    la, lb = (x.withColumn("_bucket", F.explode(_buckets(F.col(f"{t}_s"), F.col(f"{t}_e"), width))) for x, t in ((a_ok, "_l"), (b_ok, "_r")))
    met = la.join(lb, [*keys, "_bucket"])
    first, last = F.greatest("_l_s", "_r_s"), F.least("_l_e", "_r_e")
    pairs = met.filter((F.floor(first / width) == F.col("_bucket")) & (last - first >= least))
    found = pairs.select(*(["_row"] if how == "left" else []), again(left, "_l").alias("l"), again(right, "_r").alias("r"), (last - first).cast("long").alias("n_shared"))
    if how == "inner":
        return found
    alone = a.join(found.select("_row").distinct(), "_row", "left_anti").select(again(left, "_l").alias("l"), F.lit(0).cast("long").alias("n_shared"))
    return found.drop("_row").unionByName(alone, allowMissingColumns=True)


def partial_scores(gold: DataFrame, predicted: DataFrame, by: list[str]) -> DataFrame:
    """Per label, and with a null label overall: spans of gold and of the prediction, how many are met exactly, in part and not at all, and scores.

    A span is met exactly if the other side has one of its place and label, and in part if one of its label shares a character with it. Precision and
    recall count a span met in part as half of one. Equal spans count once; spans with a null key meet none.

    Both sides go to their buckets in one exchange, as sets of different places, so a bucket holds few. A span in one bucket alone is settled there; only
    those that lie in several come together again.
    """
    keys = [*by, "label"]
    usable = F.expr("start IS NOT NULL AND end IS NOT NULL AND label IS NOT NULL AND start < end")
    both = [x.filter(usable).select(*keys, F.col("start").cast("int"), F.col("end").cast("int"), F.lit(i).cast("byte").alias("_side")) for i, x in enumerate((gold, predicted))]
    spans = both[0].unionByName(both[1])
    width = width_for(spans.agg(F.avg(F.col("end") - F.col("start"))).first()[0])
    listed = spans.withColumn("_b", _buckets(F.col("start"), F.col("end"), width)).withColumn("_whole", F.size("_b") == 1).withColumn("_bucket", F.explode("_b"))
    span = F.struct("start", "end", "_whole")
    met = listed.groupBy(*keys, "_bucket").agg(*[F.collect_set(F.when(F.col("_side") == i, span)).alias(f"_{i}") for i in (0, 1)])
    named = F.lit(True)
    for c in by:
        named = named & F.col(c).isNotNull()

    def judged(side: int) -> Column:
        def one(x: Column) -> Column:
            same = F.exists(f"_{1 - side}", lambda y: (y["start"] == x["start"]) & (y["end"] == x["end"]))
            part = F.exists(f"_{1 - side}", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
            m = F.when(~named, 0).when(same, 2).when(part, 1).otherwise(0).cast("byte")
            return F.struct(F.lit(side).cast("byte").alias("side"), x["start"].alias("start"), x["end"].alias("end"), x["_whole"].alias("whole"), m.alias("m"))

        return F.transform(f"_{side}", one)

    each = met.select(*keys, F.explode(F.concat(judged(0), judged(1))).alias("_x")).select(*keys, "_x.*")
    several = each.filter(~F.col("whole")).groupBy(*keys, "side", "start", "end").agg(F.max("m").alias("m"))
    settled = each.filter("whole").select("label", "side", "m").unionByName(several.select("label", "side", "m"))
    counts = settled.groupBy("label").agg(
        *[F.count_if((F.col("side") == i) & (F.col("m") == m)).alias(f"{n}_{k}") for i, n in ((0, "gold"), (1, "pred")) for k, m in (("exact", 2), ("partial", 1), ("missed", 0))]
    )
    names = [c for c in counts.columns if c != "label"]
    out = counts.rollup("label").agg(*[F.sum(c).alias(c) for c in names])
    score = lambda s: share(F.col(f"{s}_exact") + F.col(f"{s}_partial") / 2, F.col(f"{s}_exact") + F.col(f"{s}_partial") + F.col(f"{s}_missed"))
    out = out.withColumns({"precision": score("pred"), "recall": score("gold")})
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return out.withColumn("f1", f1).select(
        "label", "gold_exact", "gold_partial", F.col("gold_missed").alias("missing"), "pred_exact", "pred_partial", F.col("pred_missed").alias("spurious"), "precision", "recall", "f1"
    )


def coverage(spans: DataFrame, by: list[str]) -> DataFrame:
    """Per `by`: n_spans, n_covered (characters in some span), n_islands (maximal runs of spans that overlap or touch)."""
    line = Window.partitionBy(*by).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = spans.filter("start >= 0 AND start < end").withColumn("_reach", F.max("end").over(line))
    fresh = F.greatest(F.col("end") - F.greatest(F.col("start"), F.coalesce("_reach", "start")), F.lit(0))
    return reach.groupBy(*by).agg(
        F.count("*").alias("n_spans"), F.sum(fresh.cast("long")).alias("n_covered"),
        F.count_if(F.col("_reach").isNull() | (F.col("start") > F.col("_reach"))).alias("n_islands")
    )
