"""String functions as Column expressions, and the few that need Arrow functions."""

from __future__ import annotations

import difflib
import re
import unicodedata
from array import array

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The letters that make up words.
LETTERS = "A-Za-zÁÉÍÓÚáéíóú"
WORD = rf"[{LETTERS}]+(?:['’][{LETTERS}]+)*"
#: Covers a text whole: words, digits, white space, single characters. (?U) gives \d and \s their Unicode meaning.
TOKEN = rf"(?sU)({WORD}|\d+|\s+|.)"


#: The same in Python, where \\s has four control characters more.
TOKEN_HERE = re.compile(rf"(?P<word>{WORD})|(?P<digits>\d+)|(?P<space>[^\S\x1c-\x1f]+)|(?P<other>.)", re.S)


def lit_set(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def lit_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def look_up(pairs: dict[str, str], key: Column) -> Column:
    """The value of key, or null. The map is searched from end to end, so only keys of a hashed set get that far."""
    return F.when(key.isin(*pairs), F.try_element_at(lit_map(pairs), key))


def filled(c: Column) -> Column:
    """Null for null, empty and blank strings."""
    return F.nullif(F.trim(c), F.lit(""))


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Code points start..end-1, counted from 0."""
    return F.substring(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))


def clean_for_match(token: Column) -> Column:
    """Letters, apostrophes and hyphens only, lower case."""
    return F.lower(F.regexp_replace(token, f"[^{LETTERS}'-]", ""))


def capitalized(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, F.lit(2), F.length(c))))


def preserve_case(modern: Column, original: Column) -> Column:
    """All upper case stays so, an upper first letter makes a capital, anything else is left."""
    first = F.substring(original, 1, 1)
    return (
        F.when((original == F.upper(original)) & (original != F.lower(original)), F.upper(modern))
        .when((first == F.upper(first)) & (first != F.lower(first)), capitalized(modern))
        .otherwise(modern)
    )


def straight_quotes(text: Column) -> Column:
    """Curly double quotes, back ticks and em dashes to their ASCII forms; curly apostrophes stay."""
    return F.replace(F.translate(text, "“”`", "\"\"'"), F.lit("—"), F.lit("--"))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition."""
    return text.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


#: Values that an Arrow function holds as Python objects at most, beside those of one text.
AT_ONCE = 200_000


def found_in(pattern: re.Pattern):
    """An Arrow function from a text to its matches, array<struct<tok, start, kind>>: places in code points, kind the matching group's name.

    Places come from the scan itself, so no window over a document's rows is needed. Null text has none.
    """
    kind = pa.list_(pa.struct([("tok", pa.string()), ("start", pa.int32()), ("kind", pa.string())]))

    def packed(sizes: array, toks: list[str], starts: array, kinds: list[str]) -> pa.Array:
        parts = [pa.array(toks, pa.string()), pa.array(starts, pa.int32()), pa.array(kinds, pa.string())]
        flat = pa.StructArray.from_arrays(parts, ["tok", "start", "kind"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), flat).cast(kind)

    def run(text: pa.Array) -> pa.Array:
        done, sizes, toks, starts, kinds = [], array("i", [0]), [], array("i"), []
        for t in text:
            for m in pattern.finditer(t.as_py() or ""):
                toks.append(m[0])
                starts.append(m.start())
                kinds.append(m.lastgroup)
            sizes.append(len(toks))
            if len(toks) > AT_ONCE:
                done.append(packed(sizes, toks, starts, kinds))
                sizes, toks, starts, kinds = array("i", [0]), [], array("i"), []
        return pa.concat_arrays([*done, packed(sizes, toks, starts, kinds)])

    run.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<tok:string,start:int,kind:string>>")


def alpha_only(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z]", "")


def place_text(c: Column) -> Column:
    """A place's name for comparison: a-z and digits, without `the`, `of`, `town` and `towne`; null becomes empty."""
    plain = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^a-z0-9\s]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"\b(the|of|towne|town)\b", " "), r"(?U)\s+", " "))


def split_pipe(c: Column) -> Column:
    """Trimmed, non-empty parts between `|`; none for null."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def flip_names(c: Column) -> Column:
    """Parts between `|`, `Surname, Forename` turned about; the forename keeps its leading blank."""
    return F.transform(
        split_pipe(c),
        lambda x: F.when(
            F.instr(x, ",") > 0,
            F.concat(F.substring_index(F.substring(x, F.instr(x, ",") + 1, F.length(x)), ",", 1), F.lit(" "), F.substring_index(x, ",", 1))
        ).otherwise(x)
    )


def fragments(uris: Column) -> Column:
    """Distinct parts after the last `#` of the URIs that have one."""
    return F.array_distinct(F.transform(F.filter(uris, lambda u: F.instr(u, "#") > 0), lambda u: F.substring_index(u, "#", -1)))


def uri_segment(uri: Column, which: int) -> Column:
    """A segment between slashes, counted from 0, or from the end below 0; null where there is none."""
    parts = F.split(F.regexp_replace(uri, "/+$", ""), "/")
    return F.try_element_at(parts, F.lit(which + 1 if which >= 0 else which))


def uri_source(uri: Column) -> Column:
    """What the fifth segment of a URI names, else `External Link`; `Not Known` without a URI."""
    return F.when(filled(uri).isNull(), F.lit("Not Known")).otherwise(
        F.coalesce(filled(F.try_element_at(F.split(uri, "/"), F.lit(5))), F.lit("External Link"))
    )


def context(text: Column, mention: Column, window: int) -> Column:
    """Lower-case text up to `window` characters around the first occurrence of mention in any case; empty if there is none."""
    low, m = F.lower(F.coalesce(text, F.lit(""))), F.lower(F.coalesce(mention, F.lit("")))
    at = F.position(m, low)
    start = F.greatest(at - 1 - window, F.lit(0))
    return F.when(at > 0, slice_text(low, start, F.least(F.length(low), at - 1 + F.length(m) + window))).otherwise(F.lit(""))


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def ratio_of(a: str, b: str, how: str = "lcs") -> float:
    """Similarity in percent, rounded: 2 * common / both lengths; two empty strings are alike by `lcs` and not compared by `difflib`."""
    if not a and not b:
        return 100.0 if how == "lcs" else 0.0
    if how == "difflib":
        return float(round(100 * difflib.SequenceMatcher(None, a, b).ratio()))
    return float(round(100 * 2 * lcs_length(a, b) / (len(a) + len(b))))


def sorted_tokens(s: str) -> str:
    return " ".join(sorted(re.sub(r"[\W_]", " ", s.lower()).split()))


def _pairwise(fn):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else fn(x, y) for x, y in zip(a, b)], dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, T.DoubleType())


#: Percent similarity of two strings, and of their sorted words.
ratio = _pairwise(ratio_of)
ratio_difflib = _pairwise(lambda a, b: ratio_of(a, b, "difflib"))
token_sort_ratio = _pairwise(lambda a, b: ratio_of(sorted_tokens(a), sorted_tokens(b)))
sequence_ratio = _pairwise(lambda a, b: difflib.SequenceMatcher(None, a, b).ratio())


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where a length is 0."""
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))
