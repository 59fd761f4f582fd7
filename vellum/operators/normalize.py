"""Spelling normalisation of historical text, with a map from every output character to its origin.

Each text is put together again in its own row, by one Arrow function. By rules a word's spelling depends on the word
alone, so workers spell the words that they meet and keep what they have found: one pass over the texts, no exchange. By
frequency each different word of the corpus is spelt once, by expressions, and the words that change are looked up. So
documents never meet: null and repeated ids are as good as any.
"""

from __future__ import annotations

import re
import string
import unicodedata
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions import lexicon as L
from vellum.functions.strings import (
    AT_ONCE, LETTERS, TOKEN_HERE, WORD, clean_for_match, found_in, look_up, nfkc, preserve_case, straight_quotes,
)
from vellum.operators.rows import in_batches, spread
from vellum.plans.durable import settle

MAX_CANDIDATES, MIN_ZIPF, OVERRIDE_BONUS = 24, 2.5, 0.25
CONSONANT = "[bcdfghjklmnpqrstvwxyz]"


def pre_normalize(text: Column, compose: bool = True) -> Column:
    """Unicode composition (an Arrow function; compose=False leaves it out), straight quotes, `--` for a dash."""
    return straight_quotes(nfkc(text) if compose else text)


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, tok, start, kind), kind in word, digits, space, other. Null texts have no tokens; map only."""
    each = in_batches(docs).select(F.col(id_col).alias("doc_id"), F.posexplode(found_in(TOKEN_HERE)(F.col(text_col))).alias("pos", "t"))
    return each.select("doc_id", "pos", "t.tok", "t.start", "t.kind")


def words_of(text: Column) -> Column:
    """The word tokens of a text, without the rest of it; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def distinct_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(tok): the different words of all texts."""
    return docs.select(F.explode(F.array_distinct(words_of(F.col(text_col)))).alias("tok")).distinct()


def is_protected(token: Column) -> Column:
    """Prefixes, surnames, first names and places of the lists are kept as they are."""
    clean = clean_for_match(token)
    return (clean != "") & clean.isin(*sorted({*L.PREFIXES, *L.SURNAMES, *L.FIRST_NAMES, *L.PLACE_NAMES}))


def spelling_candidates(word: Column, protect_e: Column, most: int = MAX_CANDIDATES) -> Column:
    """The lower-case word and its modern spellings in rule order, without repeats, `most` at the most."""
    n = F.length(word)

    def ends(tail: str, drop: int, put: str, when: Column | bool = True) -> Column:
        return F.when(word.endswith(tail) & when, F.concat(F.substring(word, F.lit(1), n - drop), F.lit(put)))

    def starts(head: str, put: str) -> Column:
        return F.when(word.startswith(head) & (n > 2), F.concat(F.lit(put), F.substring(word, F.lit(len(head) + 1), n)))

    def swaps(old: str, new: str) -> Column:
        return F.when(F.contains(word, F.lit(old)), F.replace(word, F.lit(old), F.lit(new)))

    override = look_up(L.OVERRIDES, word)
    rules = [
        word,
        F.when(override != word, override),
        look_up({k: v.lower() for k, v in L.PLACE_SPELLINGS.items()}, word),
        swaps("vv", "w"),
        swaps("w", "u"),
        starts("ff", "f"),
        swaps("ſ", "s"),
        starts("i", "j"),
        swaps("oi", "oj"),
        ends("ie", 2, "y", n > 3),
        swaps("i", "y"),
        ends("es", 2, "s", (n > 3) & ~protect_e),
        starts("v", "u"),
        F.when(F.contains(word, F.lit("u")), F.regexp_replace(word, "(?<=[a-z])u(?=[a-z])", "v")),
        F.when(F.contains(word, F.lit("v")), F.regexp_replace(word, f"(?<={CONSONANT})v(?={CONSONANT})", "u")),
        ends("eing", 4, "ing", n > 5),
        ends("e", 1, "", (n > 3) & ~protect_e),
        F.when(word.rlike("(aa|ee|ii|oo|uu)$"), F.substring(word, F.lit(1), n - 1)),
        swaps("shanon", "shannon"),
    ]
    return F.slice(F.array_distinct(F.filter(F.array(*rules), lambda c: c.isNotNull() & c.rlike(f"^[{LETTERS}'-]+$"))), 1, most)


def old_spelling_penalty(w: Column) -> Column:
    terms = [
        (F.contains(w, F.lit("vv")), 2.0), (w.startswith("ff"), 1.5), (F.contains(w, F.lit("ſ")), 2.0), (w.startswith("v"), 0.6),
        (w.endswith("e") & (F.length(w) > 3), 0.2)
    ]
    return reduce(lambda a, b: a + b, [F.when(test, F.lit(x)).otherwise(F.lit(0.0)) for test, x in terms])


def is_override(word: Column, candidate: Column) -> Column:
    return F.coalesce(look_up(L.OVERRIDES, word) == candidate, F.lit(False))


def choose_by_rules(word: Column, candidates: Column) -> Column:
    """The candidate of least (penalty less bonus, edits, change of length, length, place in the list)."""
    key = F.transform(candidates, lambda c, i: F.struct(
        (
            old_spelling_penalty(c) - F.when(is_override(word, c), F.lit(OVERRIDE_BONUS)).otherwise(F.lit(0.0))
        ).alias("p"), F.levenshtein(word, c).alias("e"),
        F.abs(F.length(c) - F.length(word)).alias("d"), F.length(c).alias("n"), i.alias("i"), c.alias("c")))
    return F.array_min(key)["c"]


def choose_by_frequency(words: DataFrame, frequencies: DataFrame, min_zipf: float = MIN_ZIPF) -> DataFrame:
    """(word, protect_e, chosen) for words(word, protect_e, candidates) by frequencies(word, zipf); a word not listed has 0.

    Of the candidates at min_zipf or above (of all, if none is) the most frequent one, then overrides, fewer edits, less penalty.
    """
    each = words.select("word", "protect_e", F.posexplode("candidates").alias("i", "c")).join(
        frequencies.select(F.col("word").alias("c"), "zipf"), "c", "left"
    )
    zipf = F.coalesce("zipf", F.lit(0.0))
    rank = F.struct(
        (zipf < min_zipf).alias("low"), (-zipf).alias("z"), F.when(is_override(F.col("word"), F.col("c")), 0).otherwise(1).alias("o"),
        F.levenshtein("word", "c").alias("e"), old_spelling_penalty(F.col("c")).alias("p"), F.col("i")
    )
    return each.groupBy("word", "protect_e").agg(F.min_by("c", rank).alias("chosen"))


def normalize_words(
    words: DataFrame, mode: str = "heuristic", frequencies: DataFrame | None = None, force_overrides: bool = True, token_col: str = "tok"
) -> DataFrame:
    """(tok, out) for distinct word tokens: protected words as they are, forced overrides, else the chosen spelling in the token's case."""
    tok = F.col(token_col)
    base = words.select(tok.alias("tok")).distinct()
    base = base.withColumns(
        {
            "word": F.lower("tok"), "protect_e": F.substring("tok", 1, 1) != F.lower(F.substring("tok", 1, 1)),
            "kept": is_protected(F.col("tok"))
        }
    )
    forced = look_up(L.OVERRIDES, F.col("word")) if force_overrides else F.lit(None).cast("string")
    if mode == "frequency":
        if frequencies is None:
            raise ValueError("mode='frequency' needs a table of (word, zipf)")
        base = base.withColumn("candidates", spelling_candidates(F.col("word"), F.col("protect_e")))
        chosen = choose_by_frequency(base.select("word", "protect_e", "candidates").distinct(), frequencies)
        base = base.join(chosen, ["word", "protect_e"], "left")
    else:
        # A word without a trace of old spelling is its own best candidate: none has less penalty, and none fewer edits.
        plain = (old_spelling_penalty(F.col("word")) == 0) & ~F.col("word").isin(*L.OVERRIDES)
        base = base.withColumn("chosen", F.when(plain, F.col("word")).otherwise(choose_by_rules(F.col("word"), spelling_candidates(F.col("word"), F.col("protect_e")))))
    out = F.when(F.col("kept"), F.col("tok")).otherwise(preserve_case(F.coalesce(forced, "chosen", "word"), F.col("tok")))
    return base.select("tok", out.alias("out"))


def penalty(w: str) -> float:
    """old_spelling_penalty() of one word, its terms added in the same order."""
    p = 0.0
    for test, x in (("vv" in w, 2.0), (w[:2] == "ff", 1.5), ("ſ" in w, 2.0), (w[:1] == "v", 0.6), (w[-1:] == "e" and len(w) > 3, 0.2)):
        p += x if test else 0.0
    return p


def edits(a: str, b: str) -> int:
    """Levenshtein distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


_PROTECTED = frozenset({*L.PREFIXES, *L.SURNAMES, *L.FIRST_NAMES, *L.PLACE_NAMES})
_LISTED = frozenset({*L.OVERRIDES, *L.PLACE_SPELLINGS})
_SPELLABLE, _DOUBLE = re.compile(f"[{LETTERS}'-]+"), re.compile("(?:aa|ee|ii|oo|uu)$")
_U, _V = re.compile("(?<=[a-z])u(?=[a-z])"), re.compile(f"(?<={CONSONANT})v(?={CONSONANT})")


def candidates_of(w: str, protect_e: bool) -> list[str]:
    """spelling_candidates() of one word."""
    n = len(w)
    found = [
        w, L.OVERRIDES.get(w), L.PLACE_SPELLINGS.get(w, "").lower(), "vv" in w and w.replace("vv", "w"), "w" in w and w.replace("w", "u"), n > 2 and w[:2] == "ff" and "f" + w[2:],
        "ſ" in w and w.replace("ſ", "s"), n > 2 and w[0] == "i" and "j" + w[1:], "oi" in w and w.replace("oi", "oj"), n > 3 and w.endswith("ie") and w[:-2] + "y", "i" in w and w.replace("i", "y"),
        n > 3 and not protect_e and w.endswith("es") and w[:-2] + "s", n > 2 and w[0] == "v" and "u" + w[1:], "u" in w and _U.sub("v", w), "v" in w and _V.sub("u", w),
        n > 5 and w.endswith("eing") and w[:-4] + "ing", n > 3 and not protect_e and w.endswith("e") and w[:-1], _DOUBLE.search(w) and w[:-1], "shanon" in w and w.replace("shanon", "shannon"),
    ]
    return list(dict.fromkeys(c for c in found if c and _SPELLABLE.fullmatch(c)))[:MAX_CANDIDATES]


def chosen_by_rules(w: str, protect_e: bool) -> str:
    """The candidate that choose_by_rules() takes; the word, if it has none. Edits are counted for candidates of equal penalty alone."""
    if not (w in _LISTED or w[:1] == "v" or w[:2] == "ff" or w[-2:] in ("ie", "ee") or "vv" in w or "’" in w):
        # At most an e at the end is a trace of old spelling: the candidate without it is the only one of no penalty, or the word the one of no edits.
        return w if protect_e or w[-1:] != "e" or len(w) < 4 else w[:-1]
    over = L.OVERRIDES.get(w)
    rated = [(penalty(c) - (OVERRIDE_BONUS if c == over else 0.0), i, c) for i, c in enumerate(candidates_of(w, protect_e))]
    if not rated:
        return w
    least = min(rated)[0]
    best = [(i, c) for p, i, c in rated if p == least]
    return best[0][1] if len(best) == 1 or best[0][1] == w else min((edits(w, c), abs(len(c) - len(w)), len(c), i, c) for i, c in best)[4]


def spelt(tok: str) -> str:
    """What normalize_words() makes of one token by rules, with forced overrides."""
    low, first = tok.lower(), tok[:1]
    if (_CLEAN.sub("", low) if "’" in low else low) in _PROTECTED:
        return tok
    small = first == first.lower()
    out = L.OVERRIDES.get(low) or chosen_by_rules(low, not small)
    if tok != low and tok == tok.upper():
        return out.upper()
    return out if small else out[:1].upper() + out[1:].lower()


#: Changed words that are sent to every worker at most, and their bytes; more are joined to the rows that have them.
SENT_WORDS, SENT_BYTES = 1_000_000, 48_000_000
#: Pieces of texts of which a worker keeps at most what they become.
KNOWN = 150_000
#: Characters of a text that are taken to pieces at once, about.
STRETCH = 1_000_000
_CLEAN = re.compile(f"[^{LETTERS}'-]")
#: Words, and what is between them; white space other than a single blank; the end of a word of two letters or more.
_PIECES, _WHITE = re.compile(f"({WORD})"), re.compile(r"[^\S\x1c-\x1f]{2,}|[^\S\x1c-\x1f ]")
_CUT = re.compile(f"(?<=[{LETTERS}]{{2}})(?![{LETTERS}'’])")


def pre_normal(text: str, compose: bool) -> str:
    """pre_normalize() of one text."""
    if not text.isascii():
        text = (unicodedata.normalize("NFKC", text) if compose else text).replace("“", '"').replace("”", '"').replace("—", "--")
    return text.replace("`", "'")


class Pieces(dict):
    """What pieces of texts, words and what is between them, become; `moved` has the origins of their characters where these do not stay in their places."""

    def __init__(self, spell: Callable[[str], str], keep_double_newlines: bool):
        self.spell, self.double = spell, "\n" if keep_double_newlines else " "
        self.moved: dict[str, np.ndarray] = {}

    def __missing__(self, piece: str) -> str:
        origins = None
        if piece[:1] in _LETTER:
            out = self.spell(piece)
            low = out.lower()
            if (_CLEAN.sub("", low) if "’" in low else low) in _PLACES:  # known places have a capital
                out = out[:1].upper() + out[1:].lower()
            lt, lo = len(piece), len(out)
            if lt != lo or piece in _O:
                origins = np.minimum(np.arange(lo) * (lt - 1) // max(lo - 1, 1), lt - 1)  # spread evenly
        else:
            out = _WHITE.sub(lambda m: self.double if "\n\n" in m[0] else " ", piece)
            if len(out) != len(piece):
                gone = np.zeros(len(piece), bool)
                for m in _WHITE.finditer(piece):
                    gone[m.start() + 1 : m.end()] = True
                origins = np.flatnonzero(~gone)
        self[piece] = out = piece if out == piece else out  # one object, where it stays
        if origins is not None:
            self.moved[piece] = origins.astype(np.int32)
        return out

    def trim(self) -> None:
        """Begin anew when there are too many, between texts."""
        if len(self) > KNOWN:
            self.clear()
            self.moved.clear()


_LETTER = frozenset("ÁÉÍÓÚáéíóú" + string.ascii_letters)
_SURNAMES, _PLACES, _O = frozenset(L.SURNAMES), frozenset(L.PLACE_NAMES), frozenset("oOóÓ")


def put_together(pre: str, known: Pieces) -> tuple[str, np.ndarray]:
    """(text, origin of each of its characters in pre) of one pre-normalised text.

    An `I` that the text begins with becomes `I,`. `O` joins the surname that follows it, over white space and single marks, as
    `O'`, and eats what is between. Known places get a capital. White space becomes a blank, or a newline if it has two in a row.
    Characters between pieces that move keep their places. A long text is taken in stretches, which end behind a word other than `O`.
    """
    texts: list[str] = []
    maps: list[np.ndarray] = []
    at = done = 0  # characters of pre before the stretch, and that are dealt with
    while at < len(pre):
        cut = _CUT.search(pre, at + STRETCH) if len(pre) - at > STRETCH else None
        stop = cut.start() if cut else len(pre)
        pieces = _PIECES.split(pre[at:stop])
        out, moved = list(map(known.__getitem__, pieces)), known.moved
        places = [i for i, p in enumerate(pieces) if p in moved]
        if at == 0 and pieces[0] == "" and len(pieces) > 1 and pieces[1] == "I":
            out[1] = "I,"
            places = [1, *places]
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces))) + at if places else ()
        eaten = 0
        for i in places:
            if i < eaten:
                continue
            piece, end = pieces[i], int(ends[i])
            start = end - len(piece)
            if i == 1 and out[1] == "I,":
                origins = np.zeros(2, np.int32)
            elif piece in _O and i + 2 < len(pieces) and not any(map(str.isalnum, pieces[i + 1])) and _CLEAN.sub("", own := known.spell(name := pieces[i + 2])).lower() in _SURNAMES:
                begin, end, eaten = int(ends[i + 1]) - start, int(ends[i + 2]), i + 3
                out[i : i + 3] = f"{piece}'{own}", "", ""
                origins = np.array([0, 0, *(begin + min(k, len(name) - 1) for k in range(len(own)))], np.int32)
            else:
                origins = moved[piece]
            maps += (np.arange(done, start, dtype=np.int32), origins + np.int32(start))
            done = end
        texts.extend(out)
        at = stop
    maps.append(np.arange(done, len(pre), dtype=np.int32))
    return "".join(texts), np.concatenate(maps)


def _assembler(spell: Callable[[], Callable[[str], str]] | None, keep_double_newlines: bool, compose: bool | None = None):
    """An Arrow function (text) or (text, map of the row's own words) to struct<normalized, char_map>; spell() gives the words' spelling. compose: texts are
    yet to be pre-normalised, with composition or without."""
    known: list[Pieces] = []
    kind = pa.struct([("normalized", pa.string()), ("char_map", pa.list_(pa.int32()))])

    def packed(out: list[str | None], sizes: list[int], maps: list[np.ndarray]) -> pa.Array:
        each = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *maps])))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), each], ["normalized", "char_map"]).cast(kind)

    def whole(texts: pa.Array, words) -> pa.Array:
        done, out, sizes, maps, held = [], [], [0], [], 0
        for t, pieces in zip(texts, words):
            t = t.as_py()
            if t is None:
                out.append(None)
                sizes.append(0)
                continue
            text, at = put_together(t if compose is None else pre_normal(t, compose), pieces)
            pieces.trim()
            out.append(text)
            maps.append(at)
            sizes.append(len(at))
            held += len(at)
            if held > 10 * AT_ONCE:
                done.append(packed(out, sizes, maps))
                out, sizes, maps, held = [], [0], [], 0
        return pa.concat_arrays([*done, packed(out, sizes, maps)])

    def shared(pre: pa.Array) -> pa.Array:
        if not known:
            known.append(Pieces(spell(), keep_double_newlines))
        return whole(pre, (known[0] for _ in range(len(pre))))

    def own(pre: pa.Array, words: pa.Array) -> pa.Array:
        return whole(pre, (Pieces(listed(dict(w.as_py() or ())), keep_double_newlines) for w in words))

    run = shared if spell else own
    run.__annotations__ = {"pre": pa.Array, **({} if spell else {"words": pa.Array}), "return": pa.Array}
    return F.arrow_udf(run, "struct<normalized:string,char_map:array<int>>")


def listed(words: dict[str, str]) -> Callable[[str], str]:
    """The spelling of words that are listed; others stay."""
    return lambda w: words.get(w, w)


def normalize(
    docs: DataFrame, mode: str = "heuristic", frequencies: DataFrame | None = None, compose: bool = True, keep_double_newlines: bool = True,
    id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, visual, normalized, char_map): char_map[i] is where character i of normalized comes from in the pre-normalised text.

    Null text stays null, with an empty map. Rows are taken each for itself, whatever their ids. See put_together() for what is done beside the
    words' spelling.
    """
    rows = in_batches(spread(docs)).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("visual"))
    if mode == "heuristic":  # the rules look at nothing but the word, so each worker spells the words that it meets
        made = rows.withColumn("_made", _assembler(lambda: spelt, keep_double_newlines, compose)("visual"))
        return made.select("doc_id", "visual", "_made.normalized", "_made.char_map")
    base = rows.withColumn("_pre", pre_normalize(F.col("visual"), compose))
    changed = settle(normalize_words(distinct_words(base, "_pre"), mode, frequencies).filter("out <> tok"))
    n, size = changed.limit(SENT_WORDS + 1).agg(
        F.count("*"), F.coalesce(F.sum(F.octet_length("tok") + F.octet_length("out")), F.lit(0))
    ).first()
    if n <= SENT_WORDS and size <= SENT_BYTES:
        sent = docs.sparkSession.sparkContext.broadcast({r.tok: r.out for r in changed.toLocalIterator()})
        made = base.withColumn("_made", _assembler(lambda: listed(sent.value), keep_double_newlines)("_pre"))
    else:
        # Each row's own words travel to the changed ones and come back as a map; rows equal in id and text share it.
        key = [F.col("doc_id").alias("_id"), F.xxhash64("_pre").alias("_hash")]
        own = base.select(*key, F.explode(F.array_distinct(words_of(F.col("_pre")))).alias("tok")).distinct().join(changed, "tok")
        maps = own.groupBy("_id", "_hash").agg(F.map_from_entries(F.collect_list(F.struct("tok", "out"))).alias("_words"))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("_pre") == F.col("_hash"))
        made = base.join(maps, same, "left").withColumn("_made", _assembler(None, keep_double_newlines)("_pre", "_words"))
    return made.select("doc_id", "visual", "_made.normalized", "_made.char_map")
