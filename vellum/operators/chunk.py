"""Overlapping chunks of long texts, cut at sentence ends."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.operators.rows import in_batches

SIZE, OVERLAP, LEAST = 1200, 100, 40


def chunk_offsets(text: str, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the chunks of one text.

    A chunk ends after the last `.`, `!` or `?` of its window if more than LEAST characters in, else at the last blank
    beyond that, else at the window's end; the next one starts `overlap` earlier, at the first character that is not white.
    """
    out, start, n = [], 0, len(text)
    while start < n:
        limit = min(start + size, n)
        sentence = max(text.rfind(mark, start, limit) for mark in ".!?") + 1
        if sentence > start + LEAST:
            cut = sentence
        else:
            blank = text.rfind(" ", start, limit)
            cut = blank if blank > start + LEAST else limit
        out.append((start, cut))
        start = cut - overlap if cut - overlap > start else cut
        while start < n and text[start].isspace():
            start += 1
    return out


def chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_no, off, chunk). Null and empty texts have no chunks."""

    def cut(text: pa.Array) -> pa.Array:
        sizes, offs, found = [0], [], []
        for t in text:
            t = t.as_py() or ""
            for a, b in chunk_offsets(t, size, overlap):
                offs.append(a)
                found.append(t[a:b])
            sizes.append(len(offs))
        each = pa.StructArray.from_arrays([pa.array(offs, pa.int32()), pa.array(found, pa.string())], ["off", "chunk"])
        return pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), each)

    cut.__annotations__ = {"text": pa.Array, "return": pa.Array}
    each = F.arrow_udf(cut, "array<struct<off:int,chunk:string>>")
    return in_batches(docs).select(
        F.col(id_col).alias("doc_id"), F.posexplode(each(F.col(text_col))).alias("chunk_no", "_c")
    ).select("doc_id", "chunk_no", "_c.off", "_c.chunk")
