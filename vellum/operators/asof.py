"""As-of join: to each row the latest row of another table that is not after it.

Both tables are laid in one order of key and time, and the last value of the right one is filled forward, so no row meets more than its neighbours. The rows of a
key with more than HOT of them are cut into slices at quantiles of their times; what a slice begins with is carried over from the slices before it, a row a
slice, so a hot key is filled by as many tasks as it has slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.rows import fits
from vellum.plans.durable import settle

HOT = 50_000
#: Slices of a key at most. A key of more than SLICES * HOT rows has larger slices, which a task sorts on disk.
SLICES = 256


def asof_join(
    left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str, order: list[str] | None = None, tolerance: int | None = None, strict: bool = False
) -> DataFrame:
    """(l, r): every row of left as a struct, with the latest row of right of equal `by` whose time is not later (strict: is earlier), or null.

    Of rows of right at one time the greatest by the columns `order` counts, without them any. tolerance: seconds that the row of right may be older.
    Rows of left with a null key or time have no partner, such rows of right are none's. Rows that repeat are each kept. Any column names are allowed.
    """
    micros = lambda c: F.unix_micros(F.col(f"`{c}`").cast("timestamp"))
    struct = lambda d: F.struct(*[F.col(f"`{c}`") for c in d.columns])
    keys = [f"_k{i}" for i in range(len(by))]
    named = [F.col(f"`{c}`").alias(k) for c, k in zip(by, keys)]
    none = lambda d: F.lit(None).cast(d.schema)
    tie = F.struct(*[F.col(f"`{c}`") for c in order]) if order else F.struct(F.lit(0).alias("none"))
    no_tie = right.select(tie.alias("x")).schema["x"].dataType
    # At one time rows of right come before those of left, or behind them where they have to be earlier.
    a = left.select(*named, micros(left_ts).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(no_tie).alias("_tie"), struct(left).alias("l"), none(right).alias("r"))
    b = right.select(*named, micros(right_ts).alias("_t"), F.lit(2 if strict else 0).alias("_side"), tie.alias("_tie"), none(left).alias("l"), struct(right).alias("r"))
    whole = F.col("_t").isNotNull()
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    alone = a.filter(~whole).select("l", "r")
    rows = a.filter(whole).unionByName(b.filter(whole))
    hot = settle(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > HOT))
    if hot.isEmpty():
        return _filled(rows.withColumn("_slice", F.lit(0)), keys, tolerance).unionByName(alone)
    small = fits(hot, 500_000)
    listed = F.broadcast(hot) if small else hot
    # Approximate quantiles decide where slices begin, not what they hold, so the result doesn't depend on them.
    quantiles = F.percentile_approx("_t", F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)]), 10 * SLICES)
    at = rows.join(listed, keys).groupBy(*keys).agg(quantiles.alias("_q"), F.max("n").alias("n"))
    step = F.greatest(F.floor(F.lit(SLICES) / F.ceil(F.col("n") / HOT)), F.lit(1))  # of the quantiles, as many as the key has slices
    at = settle(at.select(*keys, F.array_distinct(F.filter("_q", lambda x, i: (i + 1) % step == 0)).alias("_q")))
    at = F.broadcast(at) if small else at
    slice_ = F.coalesce(F.size(F.filter("_q", lambda x: x < F.col("_t"))), F.lit(0))
    return _filled(rows.join(at, keys, "left").withColumn("_slice", slice_).drop("_q"), keys, tolerance).unionByName(alone)


def _filled(rows: DataFrame, keys: list[str], tolerance: int | None) -> DataFrame:
    """The rows of left with the last row of right before them, of their slice or carried over from those before."""
    ends = rows.filter(F.col("r").isNotNull()).groupBy(*keys, "_slice").agg(F.max_by(F.struct("_t", "r"), F.struct("_t", "_tie")).alias("_end"))
    # To every later slice: rows of slices are few, and only keys with several have any.
    slices = rows.filter("_slice > 0").select(*keys, "_slice").distinct().withColumn("_end", F.lit(None).cast(ends.schema["_end"].dataType))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    every = ends.unionByName(slices).groupBy(*keys, "_slice").agg(F.first("_end", ignorenulls=True).alias("_end"))
    carried = every.withColumn("_c", F.last("_end", ignorenulls=True).over(before)).filter("_slice > 0 AND _c IS NOT NULL").select(*keys, "_slice", "_c")
    line = Window.partitionBy(*keys, "_slice").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("_f", F.last(F.when(F.col("r").isNotNull(), F.struct("_t", "r")), ignorenulls=True).over(line)).filter(F.col("l").isNotNull())
    out = filled.join(carried, [*keys, "_slice"], "left").withColumn("_f", F.coalesce("_f", "_c"))
    found = F.col("_f.r") if tolerance is None else F.when(F.col("_t") - F.col("_f._t") <= tolerance * 1_000_000, F.col("_f.r"))
    return out.select("l", found.alias("r"))
