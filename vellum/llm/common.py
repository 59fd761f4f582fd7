"""Shared helpers: table access, durable checkpoints, keyed permutations and bucketed row numbers."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """A column by its plain name, whatever characters the name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, the shared one that spark.checkpoint.dir names.

    Where that is unset a local session gets a folder of its own; on a cluster it is an error, as a folder
    of one machine cannot be read by the others.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="vellum-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Write df to the session's shared checkpoint folder and cut its lineage; it survives lost executors."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(name: str, taken) -> str:
    """name, or name with as many underscores behind it as make it differ from the taken ones (in any case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def anti_join(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows of df whose column `on` has no equal among keys' one column, null being equal to null; df keeps its columns, whatever their names."""
    key = fresh("_gone", df.columns)
    keys = keys.toDF(key)
    return df.join(keys, column(on).eqNullSafe(F.col(key)), "left_anti")


#: Bytes that are broadcast at most.
BROADCAST_BYTES = 32_000_000


def small_or_not(df: DataFrame, rows: int, most_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, bool]:
    """df, marked for broadcast if it has at most `rows` rows of most_bytes together; df must be cheap to read (settled).

    A string or binary counts with its length, any other value with 16 bytes.
    """
    each = [
        F.coalesce(F.octet_length(column(f.name)), F.lit(0)) + 16 if isinstance(f.dataType, (T.StringType, T.BinaryType)) else F.lit(16) for f in df.schema
    ]
    n, size = df.limit(rows + 1).select(
        sum(each[1:], each[0]).cast("long").alias("size")
    ).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    fits = n <= rows and size <= most_bytes
    return (F.broadcast(df) if fits else df), fits


#: Rows of one key that a task gets at most, on the average, where a join deals hot keys by a salt.
HOT = 10_000


def join_dealt(left: DataFrame, right: DataFrame, key: str, by: str, keys: DataFrame | None = None) -> DataFrame:
    """The inner join of left and right on column `key`, with a key that more than HOT rows of left have dealt by a salt, the hash of
    left's column `by`; right's rows of that key go to each part. keys: left's keys from a cheaper table, if there is one."""
    counted = (left if keys is None else keys).groupBy(key).count().filter(F.col("count") > HOT)
    hot = settle(counted.select(F.col(key).alias("_hot"), F.ceil(F.col("count") / HOT).cast("int").alias("_parts")))
    if hot.isEmpty():
        return left.join(right, key)
    hot, _ = small_or_not(hot, 1_000_000)
    salt = F.coalesce(F.pmod(F.xxhash64(by), F.col("_parts")), F.lit(0)).cast("int")
    dealt = left.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_parts")
    parts = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    sent = right.join(hot, F.col(key) == F.col("_hot"), "left").withColumn("_salt", parts).drop("_hot", "_parts")
    return dealt.join(sent, [key, "_salt"]).drop("_salt")


def n_words(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_bits(parts: list[Column], hex_digits: int) -> Column:
    """A number of 4 * hex_digits bits from the MD5 of the joined parts (the same in any SQL engine)."""
    joined = F.concat_ws(":", *parts)
    return F.conv(F.substring(F.md5(joined), 1, hex_digits), 16, 10).cast("long")


#: Walking steps. A walk leaves the domain's overhang (fewer than a = ceil(sqrt n) of a * b points): for a <= 33
#: it cannot be longer than this, beyond that its chance is below (1 / a) ** 32.
WALK = 32


def feistel(x: Column, n: Column, key: Column, rounds: int = 6, mix=hash_bits) -> Column:
    """A keyed permutation of 0..n-1 by an alternating Feistel network on Z_a x Z_b with cycle walking.

    mix(list of columns, 8) gives the round function's number. Null x or n gives null.
    """
    return _walk(x, n, key, list(range(rounds)), 1, mix)


def feistel_inverse(y: Column, n: Column, key: Column, rounds: int = 6, mix=hash_bits) -> Column:
    """The inverse of feistel()."""
    return _walk(y, n, key, list(range(rounds))[::-1], -1, mix)


def fast_bits(parts: list[Column], _: int) -> Column:
    """A round function cheaper than hash_bits, known to Spark only."""
    return F.xxhash64(*parts)


def _walk(x: Column, n: Column, key: Column, order: list[int], sign: int, mix) -> Column:
    """Value v is left * b + right; even rounds move the left half, odd rounds the right one.

    The folds carry one number each, so nothing is computed twice: a point still to be moved, v, is
    kept as -v - 1, a point that has arrived below n as itself.
    """
    a = F.ceil(F.sqrt(n.cast("double"))).cast("long")
    b = F.floor((n + a - 1) / a).cast("long")

    def turn(p: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, p["r"]).otherwise(p["l"])
        size = F.when(even, a).otherwise(b)
        own = F.when(even, p["l"]).otherwise(p["r"])
        moved = F.pmod(own + sign * F.pmod(mix([key, i.cast("string"), other.cast("string")], 8), size), size)
        return F.struct(F.when(even, moved).otherwise(other).alias("l"), F.when(even, other).otherwise(moved).alias("r"))

    def sides(v: Column) -> Column:
        return F.struct(F.floor(v / b).cast("long").alias("l"), F.pmod(v, b).cast("long").alias("r"))

    def step(acc: Column, _: Column) -> Column:
        once = F.aggregate(
            F.array(*[F.lit(i) for i in order]), sides(-acc - 1), turn,
            lambda p: F.when(p["l"] * b + p["r"] < n, p["l"] * b + p["r"]).otherwise(-(p["l"] * b + p["r"]) - 1)
        )
        return F.when(acc >= 0, acc).otherwise(once)

    end = lambda acc: F.when(acc >= 0, acc).otherwise(F.when(acc < 0, F.raise_error(F.lit("cycle walk too long")).cast("long")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), -x.cast("long") - 1, step, end)


def long_array(values: list[int]) -> Column:
    """A constant array<bigint> column."""
    return F.from_json(F.lit(json.dumps(values)), T.ArrayType(T.LongType()))


#: Rows of an Arrow batch of texts at most.
BATCH_ROWS = 1_000


def in_batches(rows: DataFrame) -> DataFrame:
    """rows, with the session's Arrow batches held to BATCH_ROWS rows, so that what a worker and its executor hold of texts at a time is small."""
    conf, name = rows.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return rows


#: Bytes of input for each core under which a table's files are taken to be too few to keep all cores busy.
SMALL = 4_000_000


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt over all cores if the table is so small that its files would keep few of them busy; a larger table is left as it is. In batches, see in_batches()."""
    cores = in_batches(rows).sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SMALL else rows
