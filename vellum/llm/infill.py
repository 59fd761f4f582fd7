"""Fill-in-the-middle over an index of distinct texts.

Identical texts are grouped by the SHA-256 of their content, checked by length and a second hash when documents come back to it. Each
distinct text is cut into tokens once, and the places where tokens end are kept as an Elias-Fano list: some two bits a token, of which
any entry can be selected. Documents come back to the index by digest, without their texts, and each selects the two cuts that its id
seeds. So a text crosses the network once, however many copies it has. An entry of the index holds the ids of its documents, HOT at most; a text of
more copies is in a table of its own, which is joined to them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.llm.common import column, fresh, in_batches, settle, small_or_not

#: Copies of a text beyond which they are dealt.
HOT = 1_000
#: Characters that are looked at at a time.
SLICE = 1 << 20
PRE, SUF, MID = "<P>", "<S>", "<M>"

_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def token_ends(text: str):
    """Yields the places (in code points) where tokens end, ascending, a slice of the text after the other: runs of A-Z and a-z are a token, and so is any other character."""
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at : at + SLICE + 1].encode("utf-32-le"), "<u4")  # one more, to see whether a run goes on
        letter = ((codes | 32) >= 97) & ((codes | 32) <= 122)
        goes_on = np.append(letter[:-1] & letter[1:], False)
        yield np.flatnonzero(~goes_on[:SLICE]) + (at + 1)


def elias_fano(text: str) -> bytes:
    """The token ends of a text: number of tokens and of characters (8 bytes each), width of the low parts (1), unary high parts, low parts."""
    n, size = sum(len(e) for e in token_ends(text)), len(text)
    if not n:
        return bytes(17)
    width = max(0, (size // n).bit_length() - 1)
    high, low, done = np.zeros(n + (size >> width) + 1, bool), np.zeros(n * width, bool), 0
    for ends in token_ends(text):
        high[(ends >> width) + np.arange(done, done + len(ends))] = True
        if width:
            low[done * width : (done + len(ends)) * width] = ((ends[:, None] >> np.arange(width)) & 1).ravel()
        done += len(ends)
    head = np.array([n, size], "<i8").tobytes() + bytes([width])
    return head + np.packbits(high, bitorder="little").tobytes() + np.packbits(low, bitorder="little").tobytes()


class Selector:
    """Selects entries of an Elias-Fano list."""

    def __init__(self, data: bytes):
        self.n, self.size = (int(x) for x in np.frombuffer(data, "<i8", 2))
        self.width = data[16]
        n_high = -(-(self.n + (self.size >> self.width) + 1) // 8) if self.n else 0
        self.high = np.frombuffer(data, np.uint8, n_high, 17)
        self.low = data[17 + n_high :]
        self.upto = np.cumsum(_ONES[self.high], dtype=np.int64)

    def end(self, units: int) -> int:
        """Characters of the first `units` tokens."""
        if not units:
            return 0
        byte = int(np.searchsorted(self.upto, units))
        rest = units - (int(self.upto[byte - 1]) if byte else 0)
        bit = int(np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))[rest - 1])
        first = (units - 1) * self.width
        piece = int.from_bytes(self.low[first // 8 : (first + self.width + 7) // 8], "little") >> (first % 8)
        return ((byte * 8 + bit - (units - 1)) << self.width) | (piece & ((1 << self.width) - 1))


def boundaries(text: Column) -> Column:
    """The Elias-Fano list of a text's token ends."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([elias_fano(t.as_py()) for t in texts], pa.binary())

    return F.arrow_udf(run, "binary")(text)


def cuts(index: Column, first: Column, second: Column) -> Column:
    """struct(n, prefix, upto): number of tokens, and the characters before the smaller and the larger of the two seeded cuts."""

    def run(index: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        out, last, chosen = [], None, None
        for data, a, b in zip(index, first.to_pylist(), second.to_pylist()):
            data = data.as_py()
            if data != last:  # copies come one after the other
                last, chosen = data, Selector(data)
            a, b = sorted((a % (chosen.n + 1), b % (chosen.n + 1)))
            out.append((chosen.n, chosen.end(a), chosen.end(b)))
        kind = pa.struct([(c, pa.int64()) for c in ("n", "prefix", "upto")])
        return pa.array([dict(zip(("n", "prefix", "upto"), x)) for x in out], kind)

    return F.arrow_udf(run, "struct<n:long,prefix:long,upto:long>")(index, first, second)


def seeds(id_col: Column, seed: str = "1") -> list[Column]:
    """Four numbers of 32 bits from the SHA-256 of `seed:id`; a null id counts as an empty one."""
    hexed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(hexed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form alone."""
    after = lambda s, mark: F.split_part(s, F.lit(mark), F.lit(2))
    before = lambda s, mark: F.split_part(s, F.lit(mark), F.lit(1))
    psm = F.concat(before(after(output, PRE), SUF), after(output, MID), before(after(output, SUF), MID))
    spm = F.concat(before(after(output, PRE), MID), after(output, MID), before(after(output, SUF), PRE))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def _checked(rows: DataFrame) -> DataFrame:
    """rows whose size and check agree with those of the text that their digest led to; it is an error if two texts share a digest."""
    same = (F.col("size") == F.octet_length("text")) & (F.col("check") == F.xxhash64("text"))
    return rows.withColumn("text", F.when(same, F.col("text")).otherwise(F.raise_error(F.lit("two texts share a digest"))))


def _index(rows: DataFrame) -> DataFrame:
    """(digest, text, docs, _ends) of each distinct text of rows, docs being the rows that have it."""
    docs = F.collect_list(F.struct("doc_id", "kept", "size", "check")).alias("docs")
    return rows.groupBy("digest").agg(F.first("text").alias("text"), docs).withColumn("_ends", boundaries(F.col("text")))


def with_boundaries(rows: DataFrame) -> DataFrame:
    """rows(doc_id, text not null, kept) with _ends, the Elias-Fano list of their text.

    Map tasks send each of their distinct texts once, with the ids that have it; a text of more than HOT copies
    goes without its ids, and is joined to them.
    """
    rows = in_batches(rows).withColumns(
        {"digest": F.unhex(F.sha2("text", 256)), "size": F.octet_length("text"), "check": F.xxhash64("text")}
    )
    hot = settle(rows.groupBy("digest").count().filter(F.col("count") > HOT).select(
        F.col("digest").alias("_hot"), F.ceil(F.col("count") / HOT).cast("int").alias("_parts")
    ))
    columns = ["doc_id", "kept", "text", "_ends"]
    cold = rows
    if not hot.isEmpty():
        listed, _ = small_or_not(hot, 500_000)
        cold = rows.join(listed, F.col("digest") == F.col("_hot"), "left_anti")
    out = _index(cold).select("text", "_ends", F.explode("docs").alias("_doc")).select("text", "_ends", "_doc.*")
    out = _checked(out).select(*columns)
    if cold is rows:
        return out
    dealt = rows.join(listed, F.col("digest") == F.col("_hot"))
    found = dealt.groupBy("digest").agg(F.first("text").alias("_text")).select(
        F.col("digest").alias("_digest"), "_text", boundaries(F.col("_text")).alias("_ends")
    )
    on = F.col("digest") == F.col("_digest")
    found, small = small_or_not(settle(found), 100_000)
    if not small:
        found = found.join(listed, F.col("_digest") == F.col("_hot")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        found = found.drop("_hot", "_parts")
        dealt = dealt.withColumn("_own", F.pmod(F.xxhash64("doc_id"), F.col("_parts")).cast("int"))
        on = on & (F.col("_own") == F.col("_salt"))
    return out.unionByName(_checked(dealt.drop("text").join(found, on).withColumnRenamed("_text", "text")).select(*columns))


def fill_in_middle(
    docs: DataFrame, seed: str = "1", id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, plain_percent: int = 10, spm_percent: int = 20
) -> DataFrame:
    """Per row of docs: doc_id, n, form, prefix_chars, middle_chars, output and the columns in `keep`.

    Null and empty texts, and texts that hold a marker, keep the form plain, like one in ten of the others; null counts as empty. Rows that share an id share the seeds, those
    with a null id the seeds of an empty one; equal rows give equal rows. An empty table gives no rows. A kept column with the name of one of these has underscores behind it.
    """
    own, names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"], {}
    for c in keep or []:
        names[c] = fresh(c, own + list(names.values()))
    rows = docs.select(
        column(id_col).alias("doc_id"), F.coalesce(column(text_col), F.lit("")).alias("text"),
        F.struct(F.lit(0).alias("end"), *[column(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("kept")
    )
    h1, h2, h3, h4 = seeds(F.col("doc_id"), seed)
    text = F.col("text")
    found = with_boundaries(rows).withColumn("_cut", cuts(F.col("_ends"), h1, h2))
    marked = F.contains(text, F.lit(PRE)) | F.contains(text, F.lit(SUF)) | F.contains(text, F.lit(MID))
    form = F.when((text == "") | marked | (h3 % 100 >= 100 - plain_percent), "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm")
    first, last = F.col("_cut.prefix").cast("int"), F.col("_cut.upto").cast("int")
    found = found.withColumn("form", form)
    cut = F.col("form") != "plain"
    prefix, middle, suffix = F.left(text, first), F.substring(text, first + 1, last - first), F.substring(text, last + 1, F.lit(2**31 - 1))
    output = F.when(~cut, text).when(
        F.col("form") == "psm", F.concat(F.lit(PRE), prefix, F.lit(SUF), suffix, F.lit(MID), middle)
    ).otherwise(F.concat(F.lit(SUF), suffix, F.lit(PRE), prefix, F.lit(MID), middle))
    return found.select(
        "doc_id", F.col("_cut.n").alias("n"), "form", F.when(cut, F.col("_cut.prefix")).alias("prefix_chars"),
        F.when(cut, F.col("_cut.upto") - F.col("_cut.prefix")).alias("middle_chars"), output.alias("output"),
        *[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(names.values())]
    )
