"""The engine's functions for SQL: after register(spark) they are called by name.

Table functions take a table as their argument: `SELECT * FROM vellum_chunks(TABLE(SELECT doc_id, text FROM documents))`. They are handed Arrow batches of it and keep
nothing between rows, so Spark deals the table over its tasks as it likes.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from vellum.functions import lexicon as L
from vellum.functions.strings import TOKEN_HERE, ratio, token_sort_ratio
from vellum.operators.chunk import OVERLAP, SIZE, chunk_offsets
from vellum.operators.tag import CAPITALS

_PLACES = frozenset({*L.COUNTIES, *L.PLACE_NAMES})


def _each(batch: pa.RecordBatch, names: tuple[str, ...], kinds: tuple[pa.DataType, ...], rows_of) -> pa.Table:
    """A table of the ids, repeated, and the rows that rows_of makes of each text. The argument's first column is the id, the second the text."""
    counts, out = [], []
    for text in batch.column(1).to_pylist():
        own = rows_of(text) if text else []
        counts.append(len(own))
        out.extend(own)
    at = [i for i, n in enumerate(counts) for _ in range(n)]
    ids = batch.column(0).take(pa.array(at, pa.int64())).cast(pa.int64())
    columns = list(zip(*out)) if out else [()] * len(names)
    return pa.table([ids, *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", *names])


class Chunks:
    """(doc_id, chunk_no, off, chunk) of a table of ids and texts."""

    def eval(self, batch: pa.RecordBatch):
        cut = lambda t: [(k, a, t[a:b]) for k, (a, b) in enumerate(chunk_offsets(t, SIZE, OVERLAP))]
        yield _each(batch, ("chunk_no", "off", "chunk"), (pa.int32(), pa.int32(), pa.string()), cut)


class Tags:
    """(doc_id, text, label, start, end): runs of capitalised words, as the tagger by rules finds them."""

    def eval(self, batch: pa.RecordBatch):
        found = lambda t: [(m[0], "LOC" if m[0].lower() in _PLACES else "PER", m.start(), m.end()) for m in CAPITALS.finditer(t)]
        yield _each(batch, ("text", "label", "start", "end"), (pa.string(), pa.string(), pa.int32(), pa.int32()), found)


class Tokens:
    """(doc_id, token, start, kind): words, digits, white space and other characters, which cover a text whole."""

    def eval(self, batch: pa.RecordBatch):
        found = lambda t: [(m[0], m.start(), m.lastgroup) for m in TOKEN_HERE.finditer(t)]
        yield _each(batch, ("token", "start", "kind"), (pa.string(), pa.int32(), pa.string()), found)


FUNCTIONS = {
    "vellum_chunks": (Chunks, "doc_id bigint, chunk_no int, off int, chunk string"), "vellum_tags": (Tags, "doc_id bigint, text string, label string, start int, end int"),
    "vellum_tokens": (Tokens, "doc_id bigint, token string, start int, kind string"),
}


def register(spark: SparkSession) -> None:
    """Register vellum_chunks, vellum_tags and vellum_tokens, and vellum_ratio(a, b) and vellum_token_sort_ratio(a, b), the likeness of two strings in percent."""
    for name, (made, kind) in FUNCTIONS.items():
        spark.udtf.register(name, F.arrow_udtf(made, returnType=kind))
    spark.udf.register("vellum_ratio", ratio)
    spark.udf.register("vellum_token_sort_ratio", token_sort_ratio)
