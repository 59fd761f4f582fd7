"""Entity tagging: a protocol for taggers, a rule tagger, and the clean-up of what a tagger finds.

A span is (doc_id, text, label, score, start, end), counted in code points from 0, end exclusive. A tagger
is a function from chunks (doc_id, off, chunk) to spans with offsets inside the chunk; register() adds one.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import lexicon as L
from vellum.functions.strings import found_in, lit_set
from vellum.operators.chunk import chunks
from vellum.operators.rows import in_batches, keyed, named
from vellum.operators.spans import beside, drop_contained, folded

MIN_SCORE = 0.5
TAGGERS: dict[str, Callable[[DataFrame], DataFrame]] = {}
SPAN = ["doc_id", "text", "label", "score", "start", "end"]
CAPITALS = re.compile(r"[A-Z][a-z]+(?: [A-Z][a-z]+)*")

LOC_PREFIX = r"(?iU)^\s*(?:county\s+of|province\s+of|city\s+of|citty\s+of|town\s+of|towne\s+of|kingdom\s+of|kingdome\s+of|proportion\s+of|of)\s+"
PER_PREFIX = r"(?iU)^\s*(?:the\s+)?(?:said\s+)+"
PER_SUFFIX = r"(?iU)(?:\s*[,;:]?\s*)(?:esquire|esqr|esq|major)\.?\s*$"


def register(name: str):
    def keep(fn):
        TAGGERS[name] = fn
        return fn

    return keep


def standard_label(label: Column) -> Column:
    up = F.upper(label)
    return F.when(up.isin("PERSON", "PER", "PERS"), "PER").when(up.isin("GPE", "LOC", "LOCATION", "PLACE", "FAC", "FACILITY"), "LOC")


@register("rules")
def capital_tagger(pieces: DataFrame) -> DataFrame:
    """Runs of capitalised words: counties and places of the lists are LOC (0.95), others PER (0.9 from two words, else 0.6)."""
    found = in_batches(pieces).select("doc_id", "off", F.explode(found_in(CAPITALS)(F.col("chunk"))).alias("_m")).select(
        "doc_id", "off", F.col("_m.tok").alias("text"), F.col("_m.start").alias("start")
    )
    place = F.lower("text").isin(*sorted({*L.COUNTIES, *L.PLACE_NAMES}))
    score = F.when(place, 0.95).when(F.contains(F.col("text"), F.lit(" ")), 0.9).otherwise(0.6)
    return found.select(
        "doc_id", "off", "text", F.when(place, "LOC").otherwise("PER").alias("label"), score.alias("score"), "start",
        (F.col("start") + F.length("text")).alias("end")
    )


#: The text of its spans is what their chunk has at their places.
capital_tagger.exact = True


def register_model(name: str, load: Callable[[], Callable[[list[str]], list[list[tuple]]]]) -> None:
    """Register a model as a tagger. load() is called once in a worker and gives a function from texts to their entities, each
    (text, label, score, start, end); score may be None (1 is meant), and so may the places: the text's first place from the
    end of the one before it, then from the beginning, is taken, and an entity that the text does not have is dropped.
    Texts reach the model in Arrow batches.
    """
    made: dict[str, Callable] = {}
    kind = pa.schema(
        [
            ("doc_id", pa.string()), ("off", pa.int32()), ("text", pa.string()), ("label", pa.string()), ("score", pa.float64()),
            ("start", pa.int32()), ("end", pa.int32())
        ]
    )

    def located(chunk: str, found: list[tuple]):
        at = 0
        for text, label, score, start, end in found:
            if start is None:
                start = chunk.find(text, at)
                start = chunk.find(text) if start < 0 else start
                if start < 0 or not text:
                    continue
                end = at = start + len(text)
            yield text, label, 1.0 if score is None else float(score), start, end

    def tagger(pieces: DataFrame) -> DataFrame:
        own = pieces.schema["doc_id"].dataType

        def run(batches):
            if name not in made:
                made[name] = load()
            model = made[name]
            for batch in batches:
                ids, offs, texts = (batch.column(i).to_pylist() for i in range(3))
                rows = [
                    (i, off, *e) for i, off, t,
                    found in zip(ids, offs, texts, model([t or "" for t in texts])) for e in located(t or "", found)
                ]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kind)], schema=kind)

        found = in_batches(pieces).select(F.col("doc_id").cast("string"), F.col("off").cast("int"), "chunk").mapInArrow(
            run, "doc_id string, off int, text string, label string, score double, start int, end int"
        )
        return found.withColumns({"doc_id": F.col("doc_id").cast(own), "label": F.coalesce(standard_label(F.col("label")), "label")})

    TAGGERS[name] = tagger


def keep_allowed(found: DataFrame, labels=("PER", "LOC")) -> DataFrame:
    """Spans with an allowed label that are no word continuation (`#...`), their offsets moved by the chunk's."""
    kept = found.filter(F.col("label").isin(*labels) & ~F.col("text").startswith("#"))
    return kept.select(
        "doc_id", "text", "label", "score", (F.col("start") + F.col("off")).alias("start"), (F.col("end") + F.col("off")).alias("end")
    )


def _bare(text: Column) -> Column:
    """Whether a text has none of what trim_affixes() cuts, seen without its expressions: ASCII that has no word of theirs and no white space at its ends."""
    low, white = F.lower(text), (" ", "\t", "\n", "\x0b", "\f", "\r")
    cue = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in ("of", "said", "esq", "major")])
    return (F.octet_length(text) == F.length(text)) & ~cue & ~F.left(text, F.lit(1)).isin(*white) & ~F.right(text, F.lit(1)).isin(*white)


def trim_affixes(spans: DataFrame, texts: DataFrame | None, min_score: float = MIN_SCORE) -> DataFrame:
    """Drop spans under min_score; cut `county of`, `the said`, `esquire` and the like and move the offsets.

    texts: (doc_id, full); None says that each span's own text is what its document has at its place. A span without usable offsets only has its text trimmed.
    One that would be left empty stays as it was.
    """
    s = spans.filter(F.coalesce("score", F.lit(1.0)) >= min_score)
    s = s.withColumns({"_own": F.col("text"), "_n": F.col("end")}) if texts is None else beside(s, texts)
    usable = F.coalesce((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.col("_n")), F.lit(False))
    s = s.withColumn("_usable", usable).withColumn("_old", F.when(F.col("_usable"), F.col("_own")).otherwise(F.col("text")))
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    new = F.when(F.col("label") == "LOC", trim(F.regexp_replace("_old", LOC_PREFIX, ""))).when(
        F.col("label") == "PER", trim(F.regexp_replace(F.regexp_replace("_old", PER_PREFIX, ""), PER_SUFFIX, ""))
    )
    s = s.withColumn("_new", F.when(_bare(F.col("_old")) & F.col("label").isin("PER", "LOC"), F.col("_old")).otherwise(new))
    moved = F.col("_usable") & F.col("_new").isNotNull() & (F.col("_new") != F.col("_old")) & (F.col("_new") != "")
    at = F.col("start") + F.position(F.col("_new"), F.col("_old")) - 1
    short = ~F.col("_usable") & F.col("_new").isNotNull() & (F.length("_new") < 3)
    return s.filter(~F.coalesce(short, F.lit(False))).select(
        "doc_id", F.when(
            moved | (~F.col("_usable") & F.col("_new").isNotNull()), F.col("_new")
        ).otherwise(F.col("text")).alias("text"), "label", "score",
        F.when(moved, at).otherwise(F.col("start")).cast("int").alias("start"), F.when(moved, at + F.length("_new")).otherwise(F.col("end")).cast("int").alias("end"))


def merge_wordpieces(spans: DataFrame) -> DataFrame:
    """Join each `##x` to the span of its label just before it; the score is the running mean of neighbours."""

    def fold(rows: list[tuple], _: str | None) -> list[tuple]:
        done: list[tuple] = []
        for start, end, label, text, score in rows:
            if done and text.startswith("##") and done[-1][2] == label:
                a, _end, _label, before, was = done[-1]
                done[-1] = (a, end, label, before + text[2:], None if was is None or score is None else (was + score) / 2)
            else:
                done.append((start, end, label, text, score))
        return done

    return folded(spans, None, fold, by_text=True, where=lambda x: x["text"].startswith("##"))


def correct_counties(spans: DataFrame) -> DataFrame:
    """A PER that is a county's name is a LOC."""
    county = (F.col("label") == "PER") & F.lower("text").isin(*L.COUNTIES)
    return spans.withColumn("label", F.when(county, "LOC").otherwise(F.col("label")))


def fix_labels(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Labels corrected by the words within 40 characters: titles make PER, place words LOC unless PER, and so do place endings;
    a single capitalised word near `eldest` or `sonn to` is PER."""
    s = beside(spans, texts, margin=40).withColumn("_near", F.lower("_near"))
    near = F.col("_near")
    has = lambda words: F.exists(lit_set(words), lambda w: F.contains(near, F.concat(w, F.lit(" "))))
    one = F.when(has(L.PERSON_TITLES), "PER").otherwise(F.col("label"))
    two = F.when(has(L.PLACE_CUES) & (one != "PER"), "LOC").otherwise(one)
    three = F.when(F.lower("text").rlike("(son|ton|ford|ham|bury)$") & (two != "PER"), "LOC").otherwise(two)
    capital = F.col("text").rlike(r"^\p{Lu}") & ~F.contains(F.col("text"), F.lit(" "))
    four = F.when(capital & (F.contains(near, F.lit("sonn to")) | F.contains(near, F.lit("eldest"))), "PER").otherwise(three)
    return s.withColumn("label", four).select(*spans.columns)


def dedupe_exact(spans: DataFrame) -> DataFrame:
    """One of the spans equal in place, label and text: the one of the highest score."""
    return spans.groupBy("doc_id", "start", "end", "label", "text").agg(F.max("score").alias("score")).select(*SPAN)


def first_mentions(spans: DataFrame) -> DataFrame:
    """One span of each different (text, label) of a document: the one of the least place, of those there the one of the highest score. A span without a place comes last."""
    order = F.struct(F.coalesce("start", F.lit(2**31 - 1)), F.coalesce("end", F.lit(2**31 - 1)), -F.coalesce("score", F.lit(-1.0)))
    first = spans.groupBy("doc_id", "text", "label").agg(F.min_by(F.struct("score", "start", "end"), order).alias("_f"))
    return first.select("doc_id", "text", "label", "_f.score", "_f.start", "_f.end")


def analyze_base(
    docs: DataFrame, tagger: str = "rules", size: int = 600, overlap: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The plain engine: chunk, tag, move offsets, and keep the first span of each (text, label); no clean-up. Documents as in analyze()."""
    texts, names = keyed(docs, id_col, text_col)
    return named(first_mentions(keep_allowed(TAGGERS[tagger](chunks(texts, size, overlap, "doc_id", "full")))), names)


def analyze(
    docs: DataFrame, tagger: str = "rules", dedupe: bool = True, size: int = 1200, overlap: int = 100, id_col: str = "doc_id",
    text_col: str = "text"
) -> DataFrame:
    """Spans of every document: chunk, tag, move offsets, trim, join word pieces, drop contained spans, correct counties, dedupe.

    Documents are taken each for itself: rows with null or repeated ids have their own spans, under the ids that they have. Spans meet their texts again only
    if the tagger does not say (by an attribute `exact`) that it gives what the text has at their places.
    """
    if tagger not in TAGGERS:
        raise ValueError(f"no tagger {tagger!r}; there are {sorted(TAGGERS)}")
    texts, names = keyed(docs, id_col, text_col)
    spans = keep_allowed(TAGGERS[tagger](chunks(texts, size, overlap, "doc_id", "full")))
    spans = correct_counties(drop_contained(merge_wordpieces(trim_affixes(spans, None if getattr(TAGGERS[tagger], "exact", False) else texts))))
    return named(dedupe_exact(spans) if dedupe else spans, names)
