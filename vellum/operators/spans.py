"""Span algebra over (doc_id, text, label, score, start, end)."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions import lexicon as L
from vellum.functions.strings import alpha_only, lit_set
from vellum.operators.rows import dealt, in_batches

#: Between spans that may merge: up to three marks or blanks, or the word `oge`. A final newline is allowed for.
GAP = r"(?iU)^(?:[\s'’.-]{0,3}|\s+oge\s+)\n?$"
SPAN = ["doc_id", "text", "label", "score", "start", "end"]
LABELS = ("PER", "LOC")


_BESIDE = "array<struct<n:int,own:string,run:string,near:string>>"


def beside(spans: DataFrame, texts: DataFrame, margin: int | None = None) -> DataFrame:
    """spans, of the documents that texts(doc_id, full) has, with what their text has at their place: _n, its length; _own, the span itself; _run, the letters,
    apostrophes and hyphens right behind it; _near, with `margin`, the span and so many characters around it, else null.

    A null place, or one outside the text, counts as the text's end, or its beginning; for _near a null place is the text's own edge. A document's spans are
    cut from its text by one Arrow function, so a text is read once, however many spans it has.
    """
    others = [c for c in spans.columns if c != "doc_id"]
    packed = in_batches(spans).groupBy("doc_id").agg(F.collect_list(F.struct(*others)).alias("_s")).join(texts.select("doc_id", "full"), "doc_id")

    def run(starts: pa.Array, ends: pa.Array, full: pa.Array) -> pa.Array:
        out = []
        for a, b, text in zip(starts.to_pylist(), ends.to_pylist(), full):
            text, own = text.as_py(), []
            if text is None:
                out.append([(None, None, None, None)] * len(a))
                continue
            n = len(text)
            for x, y in zip(a, b):
                s, e = (n if p is None else min(max(p, 0), n) for p in (x, y))
                to = e
                while to < n and (text[to].isalpha() or text[to] in "'’-"):
                    to += 1
                near = None if margin is None else text[0 if x is None else max(x - margin, 0) : n if y is None else max(y + margin, 0)]
                own.append((n, text[s:e], text[e:to], near))
            out.append(own)
        names = ("n", "own", "run", "near")
        kind = pa.list_(pa.struct([("n", pa.int32()), *[(c, pa.string()) for c in names[1:]]]))
        return pa.array([[dict(zip(names, x)) for x in own] for own in out], kind)

    run.__annotations__ = {"starts": pa.Array, "ends": pa.Array, "full": pa.Array, "return": pa.Array}
    places = [F.col(f"_s.{c}").cast("array<int>") for c in ("start", "end")]
    cut = packed.withColumn("_w", F.arrow_udf(run, _BESIDE)(*places, F.col("full")))
    each = cut.select("doc_id", F.explode(F.arrays_zip("_s", "_w")).alias("_e"))
    return each.select("doc_id", "_e._s.*", *[F.col(f"_e._w.{c}").alias(f"_{c}") for c in ("n", "own", "run", "near")])


def clip_to_text(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Offsets held within the text (doc_id, full), empty spans dropped, text read anew and trimmed."""
    s, n = beside(spans.drop("text"), texts), F.col("_n")
    s = s.withColumns(
        {"start": F.greatest(F.least("start", n), F.lit(0)), "end": F.greatest(F.least("end", n), F.lit(0))}
    ).filter("start < end")
    return s.withColumn("text", F.regexp_replace("_own", r"(?U)^\s+|\s+$", "")).select(*SPAN)


def _reach(spans: DataFrame) -> DataFrame:
    """spans with _before, the furthest end of those of the same document and label that start earlier, and _level, of those that start there."""
    spans = dealt(spans, "doc_id", "label")
    line = Window.partitionBy("doc_id", "label").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    return spans.withColumns(
        {"_before": F.max("end").over(line), "_level": F.max("end").over(Window.partitionBy("doc_id", "label", "start"))}
    )


def drop_contained(spans: DataFrame) -> DataFrame:
    """Without spans inside a longer one of the same label; equal spans both stay."""
    inside = (F.col("_before") >= F.col("end")) | (F.col("_level") > F.col("end"))
    return _reach(spans).filter(~F.coalesce(inside, F.lit(False))).drop("_before", "_level")


def drop_contained_later(spans: DataFrame) -> DataFrame:
    """Without spans inside one of the same label that starts earlier; of one start all stay."""
    return _reach(spans).filter(~F.coalesce(F.col("_before") >= F.col("end"), F.lit(False))).drop("_before", "_level")


def looks_like_token(token: Column, label: Column) -> Column:
    """A single word of three letters or more, without digits."""
    letters = F.length(F.regexp_replace(token, r"[^\p{L}]", "")) >= 3
    return letters & ~token.rlike(r"(?U)\d") & F.when(label == "PER", token.rlike(r"^[A-Za-z][A-Za-z'’-]*$")).when(
        label == "LOC", token.rlike(r"^[A-Za-z][A-Za-z'’.-]*$")
    ).otherwise(False)


def extend_clipped(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """A span that ends inside a word goes on to the word's end, if it is a plausible single word then."""
    s = beside(spans, texts)
    clipped = F.col("label").isin(*LABELS) & (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") < F.col("_n"))
    clipped = clipped & F.right("_own", F.lit(1)).rlike(r"^\p{L}$") & F.col("_run").rlike(r"^(?:\p{L}|['’]\p{L})")
    longer, word = F.col("end") + F.length("_run"), F.concat("_own", "_run")
    ok = clipped & looks_like_token(word, F.col("label"))
    s = s.select(
        "doc_id", F.when(ok, word).otherwise(F.col("text")).alias("text"), "label", "score", "start",
        F.when(ok, longer).otherwise(F.col("end")).cast("int").alias("end")
    )
    return drop_contained_later(s)


def extend_o_surnames(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """A PER that ends with `O` or `O'` takes in the surname of the list that follows."""
    s = beside(spans, texts)
    own = F.regexp_replace("_own", r"(?U)\s+$", "")
    mark = F.when(F.left("_run", F.lit(1)).isin("'", "’"), 1).otherwise(0)
    name = F.regexp_extract(F.substring("_run", mark + 1, F.length("_run")), r"^[A-Za-z]+", 0)
    surnames = lit_set(sorted({"".join(c for c in x if "a" <= c <= "z") for x in L.SURNAMES}))
    ok = (F.col("label") == "PER") & (F.col("end") > F.col("start")) & (
        F.col("end") <= F.col("_n")
    ) & own.rlike(r"(?i)\bO'?$") & (name != "") & F.array_contains(surnames, alpha_only(name))
    more = mark + F.length(name)
    end = F.col("end") + more
    s = s.select(
        "doc_id", F.when(ok, F.concat("_own", F.left("_run", more))).otherwise(F.col("text")).alias("text"), "label", "score",
        "start", F.when(ok, end).otherwise(F.col("end")).cast("int").alias("end")
    )
    return drop_contained_later(s)


_KIND = "array<struct<start:int,end:int,label:string,text:string,score:double>>"
_ARROW = pa.list_(
    pa.struct([("start", pa.int32()), ("end", pa.int32()), ("label", pa.string()), ("text", pa.string()), ("score", pa.float64())])
)


def folded(
    spans: DataFrame, texts: DataFrame | None, fold: Callable[[list[tuple], str | None], list[tuple]], by_text: bool = False,
    where: Callable[[Column], Column] | None = None
) -> DataFrame:
    """The spans that fold makes of each document's, in order of (start, end, label, or text if by_text) and on.

    fold gets a document's spans as (start, end, label, text, score) and its text (None without texts), and is run by an Arrow function, so
    its time follows the number of spans. where: whether fold changes anything in a document that has such a span; the spans of others stay, and do not
    go through Python.
    """
    names = ["start", "end", *(["text", "label"] if by_text else ["label", "text"]), "score"]
    cast = {"start": F.col("start").cast("int"), "end": F.col("end").cast("int"), "score": F.col("score").cast("double")}
    packed = in_batches(spans).groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct(*[cast.get(c, F.col(c)).alias(c) for c in names]))).alias("_s")
    )
    packed = packed.join(
        texts.select("doc_id", "full"), "doc_id", "left"
    ) if texts is not None else packed.withColumn("full", F.lit(None).cast("string"))

    def run(s: pa.Array, full: pa.Array) -> pa.Array:
        flat = s.flatten()
        cols = [flat.field(c).to_pylist() for c in ("start", "end", "label", "text", "score")]
        rows, ends = list(zip(*cols)), s.offsets.to_pylist()
        first = ends[0]
        out: list[tuple] = []
        sizes = [0]
        for a, b, text in zip(ends, ends[1:], full):
            out.extend(fold(rows[a - first : b - first], text.as_py()))
            sizes.append(len(out))
        each = pa.StructArray.from_arrays(
            [pa.array([r[k] for r in out], f.type) for k, f in enumerate(_ARROW.value_type)], [f.name for f in _ARROW.value_type]
        )
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), each).cast(_ARROW)

    run.__annotations__ = {"s": pa.Array, "full": pa.Array, "return": pa.Array}
    each = F.arrow_udf(run, _KIND)
    if where is None:
        after = each("_s", "full")
    else:
        some = F.coalesce(F.exists("_s", where), F.lit(False))
        as_is = F.transform("_s", lambda x: F.struct(*[x[f.name].alias(f.name) for f in _ARROW.value_type]))
        after = F.when(some, each(F.when(some, F.col("_s")), F.when(some, F.col("full")))).otherwise(as_is)
    made = packed.select("doc_id", F.explode(after).alias("e"))
    return made.select("doc_id", "e.text", "e.label", "e.score", "e.start", "e.end")


_GAP, _LETTERS = re.compile(GAP.replace("(?iU)", "(?i)")), re.compile("[^a-z]")


def gap_allows(cur: tuple, nxt: tuple, between: str) -> bool:
    """The text between two spans lets them merge: GAP, or the broken `og|e O'n...` of a person's name."""
    bare = lambda t: _LETTERS.sub("", t.lower())
    og = cur[2] == nxt[2] == "PER" and bare(between) == "e" and bare(cur[3]).endswith("og") and nxt[3].lower().startswith("o'")
    return og or _GAP.match(between) is not None


def merge_adjacent(
    spans: DataFrame, texts: DataFrame | None = None, labels=LABELS, max_gap: int = 2, min_score: float = 0.0,
    extend_clipped_words: bool = True, extend_o: bool = False
) -> DataFrame:
    """Merge neighbours of one label, in order of (start, end), by a fold over each document's spans.

    A span of another label closes the current one; one that overlaps the current one is dropped without
    lengthening it; one further off than max_gap, under min_score, or behind text that does not allow it starts anew.
    texts: (doc_id, full); without it any gap up to max_gap merges. Other labels pass through.
    """
    mine = spans.filter(F.col("label").isin(*labels))
    other = spans.filter(~F.coalesce(F.col("label").isin(*labels), F.lit(False))).select(*SPAN)

    def fold(rows: list[tuple], full: str | None) -> list[tuple]:
        done: list[tuple] = []
        sure = lambda x: x is None or x >= min_score
        for e in rows:
            last = done[-1] if done else None
            if last is None or last[2] != e[2]:
                done.append(e)
                continue
            gap = e[0] - last[1]
            if gap < 0:
                continue
            if gap <= max_gap and sure(last[4]) and sure(e[4]) and (full is None or gap_allows(last, e, full[last[1] : e[0]])):
                text = full[last[0] : e[1]] if full is not None else f"{last[3]} {e[3]}".strip(" ")
                scores = [x for x in (last[4], e[4]) if x is not None]
                done[-1] = (last[0], e[1], last[2], text, max(scores, default=None))
            else:
                done.append(e)
        return done

    out = folded(mine, texts, fold).unionByName(other)
    if texts is not None and extend_clipped_words:
        out = extend_clipped(out, texts)
    if texts is not None and extend_o:
        out = extend_o_surnames(out, texts)
    return out


def project_to_raw(spans: DataFrame, maps: DataFrame) -> DataFrame:
    """Offsets in normalised text to offsets in raw text by maps (doc_id, char_map, raw); spans out of bounds are dropped.

    A document's spans are projected by one Arrow function, so its map and text are read once.
    """
    others = [c for c in spans.columns if c not in ("doc_id", "text")]
    packed = in_batches(spans).groupBy("doc_id").agg(F.collect_list(F.struct(*others)).alias("_s")).join(maps.select("doc_id", "char_map", "raw"), "doc_id")

    def run(starts: pa.Array, ends: pa.Array, places: pa.Array, raw: pa.Array) -> pa.Array:
        out = []
        for a, b, to, text in zip(starts.to_pylist(), ends.to_pylist(), places, raw):
            text, own = text.as_py() or "", []
            n = len(to.values) if to.is_valid else 0
            asked = [x is not None and y is not None and 0 <= x < y <= n for x, y in zip(a, b)]
            ends_of = iter(to.values.take(pa.array([p for x, y, ok in zip(a, b, asked) if ok for p in (x, y - 1)], pa.int64())).to_pylist() if n else ())
            for ok in asked:
                s, e = (next(ends_of), next(ends_of)) if ok else (None, None)
                s, e = (s, e + 1) if s is not None and e is not None else (0, 0)
                own.append({"s": s, "e": e, "t": text[s:e]} if 0 <= s < e <= len(text) else None)
            out.append(own)
        return pa.array(out, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32()), ("t", pa.string())])))

    run.__annotations__ = {"starts": pa.Array, "ends": pa.Array, "places": pa.Array, "raw": pa.Array, "return": pa.Array}
    at = [F.col(f"_s.{c}").cast("array<int>") for c in ("start", "end")]
    cut = packed.withColumn("_w", F.arrow_udf(run, "array<struct<s:int,e:int,t:string>>")(*at, "char_map", "raw"))
    each = cut.select("doc_id", F.explode(F.arrays_zip("_s", "_w")).alias("_e")).filter("_e._w IS NOT NULL")
    return each.select("doc_id", F.col("_e._w.t").alias("text"), "_e._s.label", "_e._s.score", F.col("_e._w.s").alias("start"), F.col("_e._w.e").alias("end"))


def spans_from_lookup(unique: DataFrame) -> DataFrame:
    """The spans of (doc_id, text, label, spans) again, one row each."""
    return unique.select("doc_id", "text", "label", F.explode("spans").alias("_p")).select(
        "doc_id", "text", "label", "_p.score", "_p.start", "_p.end"
    )
