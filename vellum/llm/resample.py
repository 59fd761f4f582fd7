"""Target-distribution importance resampling: documents drawn as if from the target's distribution of hashed n-grams.

Features are the runs of 1 to 3 words, hashed into buckets. A bucket's gain is the scaled logarithm of its share in the target over
its share in the documents; a document's weight is the sum of its features' gains, and a Gumbel number by its id makes the highest
scores a draw without replacement.

A text longer than CHUNK bytes is split at word boundaries. Each chunk owns the features that start in its words and carries the
n - 1 words behind them, chunks are dealt over the cluster, and their counts and weights are summed by document; so no task has to
work off a very long text alone. Corpus counts leave a task as one number a bucket. The ranks come from a range partitioning
with numbers inside the partitions, never from one sorted task.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.llm.common import column, fresh, long_array, settle, spread
from vellum.llm.crc import gram_checksums

BUCKETS = 10_000
WIDTH = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes of a text beyond which it is split; about the bytes of a chunk.
CHUNK = 65_536
#: Bytes of texts that are hashed at a time.
SLICE = 4_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: digits, letters, and all of characters beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(_WORD[data].view(np.int8), prepend=0, append=0))
    return edge[0::2], edge[1::2]


def _slices(texts: pa.Array):
    """(first row, bytes with a space between texts, places where texts start) for stretches of about SLICE bytes."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE, "right")) - 1)
        own = offsets[at : end + 1] - offsets[at]
        piece = data[offsets[at] : offsets[end]]
        yield at, np.insert(piece, own[1:-1], 0x20), own[:-1] + np.arange(end - at)
        at = end


def features(texts: pa.Array, owned: pa.Array, buckets: int, width: int):
    """Yields (first row, number of rows, words by row, rows of the features, buckets of the features).

    owned: how many of a row's words it owns, the rest being carried along; null: all.
    """
    own = owned.fill_null(-1).to_numpy(zero_copy_only=False)
    for at, data, begins in _slices(texts):
        starts, ends = word_bounds(data)
        row = np.searchsorted(begins, starts, "right") - 1
        words = np.bincount(row, minlength=len(begins))
        limit = own[at : at + len(begins)]
        mine = np.arange(len(row)) - (np.cumsum(words) - words)[row] < np.where(limit < 0, words, limit)[row]
        rows, hashed = [], []
        for first, crc in gram_checksums(_LOWER[data], starts, ends, row, width):
            keep = mine[first]
            rows.append(row[first[keep]])
            hashed.append((crc[keep] % np.uint32(buckets)).astype(np.int64))
        yield at, len(begins), np.bincount(row[mine], minlength=len(begins)), np.concatenate(rows), np.concatenate(hashed)


def split_long(docs: DataFrame, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """(key, doc_id, kept, text, owned) of docs(doc_id, kept, text) without null texts: the chunks of every text. kept is in the first chunk of a text alone."""
    rows = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "kept", "text")
    # All may be null, as kept is beyond the first chunk.
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in rows.schema], T.StructField("owned", T.LongType())])
    names = schema.fieldNames()

    def run(batches):
        for batch in batches:
            for i in range(len(batch)):
                data = batch.column("text")[i].as_buffer()
                starts, ends = word_bounds(np.frombuffer(data, np.uint8))
                cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data), chunk)))
                cuts = np.append(cuts[cuts < len(starts)], len(starts)).tolist() if len(starts) else [0, 0]
                texts = [bytes(data[int(starts[a]) : int(ends[min(b + width - 1, len(starts)) - 1])]) if b else b"" for a, b in zip(cuts, cuts[1:])]
                again = [batch.column(c).take(pa.array([i] * len(texts))) for c in ("key", "doc_id")]
                kept = batch.column("kept").take(pa.array([i] + [None] * (len(texts) - 1), pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*again, kept, pa.array(texts, pa.binary()).cast(pa.string()), pa.array([b - a for a, b in zip(cuts, cuts[1:])], pa.int64())],
                    names=names,
                )

    return rows.mapInArrow(run, schema)


def _parted(docs: DataFrame, width: int, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Short texts as they are and the chunks of long ones, dealt; both (key, doc_id, kept, text, owned)."""
    long = F.coalesce(F.octet_length("text") > chunk, F.lit(False))
    short = spread(docs.filter(~long)).select(F.lit(None).cast("long").alias("key"), "doc_id", "kept", "text", F.lit(None).cast("long").alias("owned"))
    return short, split_long(docs.filter(long), width, chunk).repartition("key", "owned", F.xxhash64("text"))


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS, width: int = WIDTH, chunk: int = CHUNK) -> np.ndarray:
    """How many features of docs(doc_id, kept, text) each bucket holds. One number a bucket, so the driver holds them."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for *_, hashed in features(batch.column(0), batch.column(1), buckets, width):
                total += np.bincount(hashed, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    parts = [p.select("text", "owned").mapInArrow(run, "bucket long, n long") for p in _parted(docs, width, chunk)]
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts[0].union(parts[1]).groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(ours: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in ours."""
    n, s, t = len(ours), float(ours.sum()), float(target.sum())
    return np.array(
        [math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(ours.tolist(), target.tolist())], np.int64
    )


def weigh(docs: DataFrame, gain: np.ndarray, width: int = WIDTH, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, kept, n_words, n_features, weight) of every row of docs(doc_id, kept, text)."""
    buckets, names = len(gain), ["key", "doc_id", "kept", "n_words", "n_features", "weight"]
    kind = docs.schema["kept"].dataType
    ids = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("key", T.LongType()), T.StructField("doc_id", ids), T.StructField("kept", kind)]
        + [T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")]
    )

    def run(batches):
        for batch in batches:
            n = np.zeros((3, len(batch)), np.int64)
            for at, m, words, rows, hashed in features(batch.column("text"), batch.column("owned"), buckets, width):
                n[0, at : at + m] = words
                n[1, at : at + m] = np.bincount(rows, minlength=m)
                np.add.at(n[2, at : at + m], rows, gain[hashed])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("key", "doc_id", "kept")], *map(pa.array, n)], names=names
            )

    short, chunks = (p.mapInArrow(run, schema) for p in _parted(docs, width, chunk))
    summed = chunks.groupBy("key", "doc_id").agg(
        F.first("kept", ignorenulls=True).alias("kept"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")]
    )
    return short.drop("key").unionByName(summed.drop("key"))


def gumbel(id_col: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u by the SHA-256 of `seed:id`; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return F.floor(-1000 * F.ln(-F.ln((h.cast("long").cast("double") + 0.5) / 4294967296.0))).cast("long")


def ranked(rows: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows(doc_id, n_words, score, ...) with rank: 1, 2, ... for the floor(percent N / 100) best of the N rows of enough words, else null."""
    rows = rows.withColumn("_in", F.col("n_words") >= least_words)
    order = [F.desc("_in"), F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    part, inside = F.spark_partition_id(), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))
    counts = {r.part: r for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.count_if("_in").alias("inside")).collect()}
    starts, n = [], 0
    for i in range(max(counts, default=-1) + 1):
        starts.append(n)
        n += counts[i].n if i in counts else 0
    drawn = percent * sum(r.inside for r in counts.values()) // 100
    at = F.get(long_array(starts), part) + inside + 1
    return placed.withColumn("rank", at).withColumn("rank", F.when(F.col("_in") & (F.col("rank") <= drawn), F.col("rank"))).drop("_in")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", keep: list[str] | None = None,
    buckets: int = BUCKETS, width: int = WIDTH, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, chunk: int = CHUNK
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_features, weight, score, rank (null: not drawn) and the columns in `keep`.

    Null and empty texts have no features, weight 0, and are never drawn. A null id draws the number of an empty one and comes last among
    equal scores; rows that repeat are each scored and drawn for themselves, equal ones in any order, which no column shows. An empty table
    gives no rows; an empty target leaves gains of its smoothing alone. A kept column with the name of one above has underscores behind it.
    """
    own, names = ["doc_id", "n_words", "n_features", "weight", "score", "rank", "_in"], {}
    for c in keep or []:
        names[c] = fresh(c, own + list(names.values()))
    kept = F.struct(F.lit(0).alias("end"), *[column(c).alias(f"c{i}") for i, c in enumerate(names)]).alias("kept")
    rows = docs.select(column(id_col).alias("doc_id"), kept, column(text_col).alias("text"))
    # Counting reads no kept column.
    plain = F.struct(F.lit(0).alias("end")).alias("kept")
    ours = bucket_counts(rows.withColumn("kept", plain), buckets, width, chunk)
    wanted = bucket_counts(target.select(F.lit(0).cast("long").alias("doc_id"), plain, column(target_text).alias("text")), buckets, width, chunk)
    scored = settle(weigh(rows, gains(ours, wanted), width, chunk).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    return ranked(scored, percent, least_words).select(
        "doc_id", "n_words", "n_features", "weight", "score", "rank", *[F.col(f"kept.c{i}").alias(c) for i, c in enumerate(names.values())]
    )


def drawn_documents(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, all their columns, with n_features, weight, score and rank behind them."""
    id_col = options.get("id_col", "doc_id")
    others = [c for c in docs.columns if c != id_col]
    return resample(docs, target, keep=others, **options).filter(F.col("rank").isNotNull())
