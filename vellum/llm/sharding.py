"""Sharding by a Feistel permutation of global row numbers.

Law `rows`: row number i of 0..N-1 goes to p = permutation(i), shard p mod S and slot p div S, so
shard sizes differ by one at most, the order is shuffled reproducibly, and shard and slot can be
computed from a row number alone (and back, by locate()).

The global row number needs no global sort: rows are dealt to hash buckets by id and checksum, the bucket
counts (4,096 numbers, or 65,536 for large tables) are summed up, and a window numbers the rows
inside each bucket. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import column, feistel, feistel_inverse, fresh, hash_bits, long_array

KEY = "vellum-shard-1"


def utf8_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def place(row: Column, n: int, shards: int, key: str = KEY) -> tuple[Column, Column]:
    """Shard and slot of row numbers below n."""
    p = feistel(row, F.lit(n).cast("long"), F.lit(key))
    return F.pmod(p, F.lit(shards)).cast("int"), F.floor(p / F.lit(shards)).cast("long")


def locate(shard: Column, slot: Column, n: int, shards: int, key: str = KEY) -> Column:
    """The row number at a shard and slot: the inverse of place()."""
    return feistel_inverse(slot.cast("long") * shards + shard.cast("long"), F.lit(n).cast("long"), F.lit(key))


def hex_digits(n: int) -> int:
    """Digits of the bucket hash for n rows: 3, or 4 where a bucket would hold more than 65,536 rows on the average."""
    return 3 if n <= 2**28 else 4


def shard_documents(
    docs: DataFrame, shards: int = 8, key: str = KEY, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Rows of docs with doc_id, size, text_crc32, law, shard, slot, row_number and the columns in `keep`.

    Null text: size 1, checksum that of the empty string. Rows with a null or a repeated id are spread by their
    text's checksum. Rows that repeat whole are numbered in any order among themselves, which no output column shows.
    An empty table gives no rows. Equal texts form no group here: under the law `rows` each row is placed alone, and
    its checksum tells where equal texts are. A kept column with the name of one of the columns above has underscores
    put behind its name.
    """
    own = ["doc_id", "size", "text_crc32", "law", "shard", "slot", "row_number"]
    kept = {}
    for c in keep or []:
        kept[c] = fresh(c, own + list(kept.values()))
    rows = docs.select(
        column(id_col).alias("doc_id"), utf8_size(column(text_col)).alias("size"), F.crc32(
            F.coalesce(column(text_col), F.lit(""))
        ).alias("text_crc32"),
        F.xxhash64(column(text_col)).alias("_tie"), F.struct(
            *[column(c).alias(f"c{i}") for i, c in enumerate(kept)], F.lit(0).alias("end")
        ).alias("_kept"),
    )
    digits = hex_digits(docs.count())
    bucket = hash_bits([F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32").cast("string")], digits)
    rows = rows.withColumn("_bucket", bucket)
    counts = dict(rows.groupBy("_bucket").count().collect())  # at most 16 ** digits rows
    starts, n = [], 0
    for i in range(16**digits):
        starts.append(n)
        n += counts.get(i, 0)
    # What tells rows with equal ids and texts apart: a hash of the kept columns, maps by their JSON.
    rest = [
        F.col(f"_kept.c{i}") if "map<" not in docs.schema[c].dataType.simpleString() else F.to_json(F.struct(f"_kept.c{i}")) for i,
        c in enumerate(kept) if c != text_col
    ]
    order = Window.partitionBy("_bucket").orderBy("doc_id", "text_crc32", "size", "_tie", F.xxhash64(F.lit(0), *rest))
    rows = rows.withColumn("row_number", F.get(long_array(starts), F.col("_bucket").cast("int")) + F.row_number().over(order) - 1)
    shard, slot = place(F.col("row_number"), n, shards, key)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.alias("slot"), "row_number",
        *[F.col(f"_kept.c{i}").alias(c) for i, c in enumerate(kept.values())]
    )
