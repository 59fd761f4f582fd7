"""Mixing sources to target weights by fixed-length blocks.

The words of each source, its documents laid end to end, are packed into blocks of BLOCK words (the
last block may be shorter). A source's target decides how many blocks the mix takes of it. Each output
shard draws its source counts by a multinomial with the targets' shares; what the draws miss of the
targets by their own noise is put right within the shards (see dealt()). Slot g of a source maps to block
permutation(g mod n_blocks), with a new pseudorandom permutation in each pass over the source, and
slots and blocks are joined by that index. At most 3 * n_blocks slots are drawn, so nothing is
taken more than three times.

Nothing is gathered in one task but one row per source; a source's rows are spread over hash buckets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import WORD, column, fast_bits, feistel, hash_bits, n_words, settle

BLOCK = 32
BUCKETS = 1024
MOST = 3
WEIGHTS = (5, 2, 1)
SHARDS = 8
KEY = "vellum-mix-1"
#: Slots made by one row before they are dealt to other tasks.
STRETCH = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(src, source, source_size, target) from (source, size): weights repeat over the sources by code point, null last.

    Targets share the sum of all sizes by weight; a target stops at `most` times its source's size and
    the rest shares what is left over. With sources ordered by their limit a unit of weight, those that
    stop are a prefix of the order, so one pass of running sums finds the level of the others.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordinal = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("_weight", F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(ordinal, F.lit(len(weights)))).cast("double"))
    by = by.withColumn("_limit", (F.lit(most) * F.col("source_size")).cast("double"))
    line = Window.orderBy(F.col("_limit") / F.col("_weight"), F.col("source").asc_nulls_last())
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    after = line.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn(
        "_level",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    )
    by = by.withColumn("_level", F.max("_level").over(everything))
    return by.select(
        source_key().alias("src"), "source", "source_size", F.least("_limit", F.col("_level") * F.col("_weight")).alias("target")
    )


def source_key():
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))


def laid_out(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None
) -> DataFrame:
    """doc_id, source, src, size, bucket and a tie breaker of every row, without the text; settled."""
    text = column(text_col)
    return settle(
        docs.select(
            column(id_col).alias("doc_id"), column(source_col).cast("string").alias("source"), n_words(text).alias("size"),
            F.xxhash64(text).alias("tie")
        )
        .withColumn("src", source_key())
        .withColumn(
            "bucket", hash_bits([F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("tie").cast("string")], 8) % BUCKETS
        )
    )


def offsets(rows: DataFrame) -> DataFrame:
    """rows with `first`: the number of words of the source before the row's own."""
    per = rows.groupBy("src", "bucket").agg(F.sum("size").alias("_sum"))
    along = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("src", "bucket", F.coalesce(F.sum("_sum").over(along), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("src", "bucket").orderBy("doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_upto", F.sum("size").over(inside))
    return rows.join(per, ["src", "bucket"]).withColumn("first", F.col("_before") + F.col("_upto") - F.col("size")).drop("_before", "_upto")


def dealt(n_slots: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots by shard and source. Each shard draws its source counts by a multinomial with the sources' shares of all slots.

    The draws' totals miss the sources' numbers by their own noise, and could pass the bound on repeats; so as many slots as
    a source was drawn too often are given, in the shards that drew them, to sources drawn too seldom.
    """
    total = int(n_slots.sum())
    rng = np.random.Generator(np.random.PCG64(seed))
    sizes = [total // shards + (k < total % shards) for k in range(shards)]
    drawn = np.array([rng.multinomial(n, n_slots / total) for n in sizes], np.int64).reshape(shards, -1)
    miss = drawn.sum(axis=0) - n_slots
    free = np.zeros(shards, np.int64)
    for s in np.flatnonzero(miss > 0):
        away = _shares(int(miss[s]), drawn[:, s])
        drawn[:, s] -= away
        free += away
    for s in np.flatnonzero(miss < 0):
        more = _shares(-int(miss[s]), free)
        drawn[:, s] += more
        free -= more
    return drawn


def _shares(n: int, room: np.ndarray) -> np.ndarray:
    """n cut in proportion to room, no part over its room; n is the sum of room at most."""
    out = np.array([n * r // max(1, int(room.sum())) for r in room.tolist()], np.int64)
    for k in np.argsort(out - room, kind="stable"):  # the roomiest first
        out[k] += (more := min(n - int(out.sum()), int(room[k] - out[k])))
        if not n - out.sum():
            break
    return out


def draws(targets: DataFrame, shards: int = SHARDS, block: int = BLOCK, most: int = MOST, key: str = KEY) -> DataFrame:
    """(src, n_blocks, n_slots, shard, start, drawn): the slots that each output shard draws of each source, numbered through by source.

    One task sees one row a source, as a shard's draw is over all sources.
    """

    schema = pa.schema(
        [("src", pa.string())] + [(c, pa.int64()) for c in ("n_blocks", "n_slots")]
        + [("shard", pa.int32()), ("start", pa.int64()), ("drawn", pa.int64())]
    )

    def deal(rows: pa.Table) -> pa.Table:
        rows = rows.select(["src", "n_blocks", "n_slots"]).sort_by("src")
        seed = int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big")
        by = dealt(rows.column("n_slots").to_numpy(), shards, seed)
        start = np.cumsum(by, axis=0) - by
        parts = [[*rows.columns, pa.array([k] * len(rows), pa.int32()), pa.array(start[k]), pa.array(by[k])] for k in range(shards)]
        return pa.concat_tables([pa.Table.from_arrays(p, schema=schema) for p in parts])

    n_blocks = F.ceil(F.col("source_size") / block).cast("long")
    plan = targets.filter("source_size > 0").select(
        "src", n_blocks.alias("n_blocks"),
        F.least(F.lit(most) * n_blocks, F.round(F.col("target") * n_blocks / F.col("source_size")).cast("long")).alias("n_slots")
    )
    return plan.filter("n_slots > 0").groupBy(F.lit(0).alias("all")).applyInArrow(
        deal, "src string, n_blocks long, n_slots long, shard int, start long, drawn long"
    )


def slots(drawn: DataFrame, key: str = KEY) -> DataFrame:
    """One row per slot: (src, shard, slot, block), block by the permutation of the slot's pass."""
    pieces = drawn.filter("drawn > 0").withColumn(
        "_from", F.explode(F.sequence("start", F.col("start") + F.col("drawn") - 1, F.lit(STRETCH).cast("long")))
    )
    # A given number of partitions: stretches are few bytes but much work, so they must not be coalesced by size.
    pieces = pieces.repartition(int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions")), "src", "_from")
    last = F.least(F.col("_from") + STRETCH, F.col("start") + F.col("drawn")) - 1
    every = pieces.withColumn("slot", F.explode(F.sequence(F.col("_from"), last)))
    turn = F.floor(F.col("slot") / F.col("n_blocks")).cast("string")
    return every.select(
        "src", "shard", "slot",
        feistel(
            F.pmod("slot", "n_blocks"), F.col("n_blocks"), F.concat_ws(":", F.lit(key), F.col("src"), turn), rounds=4, mix=fast_bits
        ).alias("block")
    )


def pieces_of(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per document and block: (src, block, from_word, n), counted in the document's own words.

    A document without words has one row, whose block is null and n is 0.
    """
    first, end = F.col("first"), F.col("first") + F.col("size")
    blocks = F.when(
        F.col("size") > 0, F.sequence(F.floor(first / block), F.floor((end - 1) / block))
    ).otherwise(F.array(F.lit(None).cast("long")))
    lay = rows.withColumn("block", F.explode(blocks))
    start = F.greatest(F.col("block") * block, first)
    stop = F.least((F.col("block") + 1) * block, end)
    return lay.withColumns(
        {"from_word": F.coalesce(start - first, F.lit(0)), "n": F.when(F.col("block").isNull(), 0).otherwise(stop - start)}
    )


def mix_counts(
    docs: DataFrame, shards: int = SHARDS, block: int = BLOCK, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, key: str = KEY,
    **columns
) -> DataFrame:
    """Per row: doc_id, source, size, source_size, target, taken.

    Null or empty text has size 0 and is never taken; rows that repeat whole are packed one after the
    other and counted each for itself. A null source is a source of its own, the last. An empty table
    gives no rows.
    """
    rows = laid_out(docs, **columns)
    targets = settle(source_targets(rows, weights, most))
    times = slots(draws(targets, shards, block, most, key), key).groupBy("src", "block").agg(F.count("*").alias("times"))
    # Slots are made from a few rows, so their number is not in the plan's estimates; they must not be broadcast.
    pieces = pieces_of(offsets(rows), block).join(times.hint("merge"), ["src", "block"], "left")
    taken = pieces.groupBy("src", "first", "bucket", "tie", "doc_id", "source", "size").agg(
        F.sum(F.col("n") * F.coalesce("times", F.lit(0))).alias("taken"), F.count(F.when(F.col("block").isNull(), 1)).alias("empty")
    )
    taken = taken.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.greatest("empty", F.lit(1)).cast("int"))))  # wordless rows that repeat whole
    return taken.join(targets.select("src", "source_size", "target"), "src").select(
        "doc_id", "source", "size", "source_size", "target", "taken"
    )


def mix_documents(
    docs: DataFrame, shards: int = SHARDS, block: int = BLOCK, most: int = MOST, weights: tuple[int, ...] = WEIGHTS, key: str = KEY,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: list[str] | None = None
) -> DataFrame:
    """The mix itself: one row per slot and document piece in it.

    Columns: mix_shard, slot, block, doc_id, from_word, text (the piece's words joined by one space), source, and `kept`, a struct
    with the columns in `keep`, so that their names may be any. Null, empty and white texts are in no block. Rows with equal id
    and text are each laid out and taken for themselves, with the kept columns of the first of them by their JSON.
    An empty table gives no rows.
    """
    rows = laid_out(docs, id_col, text_col, source_col)
    targets = settle(source_targets(rows, weights, most))
    pieces = pieces_of(offsets(rows), block).filter("n > 0").groupBy("doc_id", "tie", "src", "first").agg(
        F.collect_list(F.struct("block", "from_word", "n")).alias("_pieces")
    )
    text = column(text_col)
    # Texts travel as texts: as arrays of words they would take several times the room.
    kept = F.struct(*[column(c).alias(c) for c in keep or []], *([] if keep else [F.lit(None).cast("string").alias("none")]))
    full = docs.select(column(id_col).alias("_id"), F.xxhash64(text).alias("_tie"), text.alias("_text"), kept.alias("kept"))
    full = full.groupBy("_id", "_tie").agg(F.min("_text").alias("_text"), F.min_by("kept", F.to_json("kept")).alias("kept"))
    piece = lambda words: lambda p: F.struct(p["block"].alias("block"), p["from_word"].alias("from_word"), F.array_join(F.slice(words, (p["from_word"] + 1).cast("int"), p["n"].cast("int")), " ").alias("text"))
    # The outer transform, over one array of words, binds it, so a text is cut into words once.
    each = F.get(
        F.transform(F.array(F.regexp_extract_all("_text", F.lit(f"({WORD})"))), lambda words: F.transform("_pieces", piece(words))),
        F.lit(0)
    )
    cut = full.join(pieces, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_tie") == F.col("tie"))).withColumn("_p", F.explode(each))
    cut = cut.select("doc_id", "src", "_p.block", "_p.from_word", "_p.text", "kept")
    mixed = cut.join(slots(draws(targets, shards, block, most, key), key).hint("merge"), ["src", "block"])
    return mixed.select(
        F.col("shard").alias("mix_shard"), "slot", "block", "doc_id", "from_word", "text",
        F.when(F.col("src") != "", F.substring("src", 2, 2**30)).alias("source"), "kept"
    )
