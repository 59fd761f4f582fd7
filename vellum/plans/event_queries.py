"""As-of joins, sketches and variants over events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import asof, sketches, variants
from vellum.plans.registry import query

TOLERANCE = 3_600


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("asof_orders", """
WITH o AS (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderdate)
SELECT e.event_id, e.user_id, o.o_orderkey, o.o_orderdate FROM events e ASOF LEFT JOIN o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate
""")
def asof_orders(spark, sf_dir):
    """The latest order of each event's user."""
    found = asof.asof_join(
        _table(spark, sf_dir, "events"), _table(spark, sf_dir, "orders").withColumn("user_id", F.col("o_custkey")), ["user_id"], "ts", "o_orderdate", order=["o_orderkey"]
    )
    return found.select("l.event_id", "l.user_id", "r.o_orderkey", "r.o_orderdate")


@query("asof_errors", f"""
WITH r AS (SELECT user_id, ts, max(event_id) AS error_id FROM events WHERE event_type = 'error' GROUP BY user_id, ts),
j AS (SELECT e.event_id, e.ts, r.error_id, r.ts AS err_ts FROM events e ASOF LEFT JOIN r ON e.user_id = r.user_id AND e.ts > r.ts)
SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(err_ts) <= {TOLERANCE * 1_000_000} THEN error_id END AS error_id, CASE WHEN epoch_us(ts) - epoch_us(err_ts) <= {TOLERANCE * 1_000_000} THEN epoch_us(ts) - epoch_us(err_ts) END AS micros FROM j
""")
def asof_errors(spark, sf_dir):
    """The last error of the same user within an hour before each event."""
    e = _table(spark, sf_dir, "events")
    found = asof.asof_join(e, e.filter("event_type = 'error'"), ["user_id"], "ts", "ts", order=["event_id"], tolerance=TOLERANCE, strict=True)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return found.select("l.event_id", F.col("r.event_id").alias("error_id"), (micros("l.ts") - micros("r.ts")).alias("micros"))


@query("sketch_rollup", """
SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_users, true AS users_in_bound, true AS median_in_bound, true AS p90_in_bound FROM events GROUP BY ROLLUP (event_type)
""")
def sketch_rollup(spark, sf_dir):
    """Sketches by day and type, merged to types and to all, beside the exact counts, and whether they keep to their bounds."""
    e = _table(spark, sf_dir, "events")
    daily = sketches.sketch(e.withColumn("day", F.to_date("ts")), ["day", "event_type"], "user_id", "value")
    rolled = sketches.merged(daily, ["event_type"]).unionByName(sketches.merged(daily, []).withColumn("event_type", F.lit(None).cast("string")))
    est = rolled.select(
        F.col("event_type").alias("_type"), F.col("n").alias("_n"), sketches.distinct_estimate(F.col("users")).alias("_users"),
        *[sketches.quantile(F.col("spread"), q).alias(f"_q{i}") for i, q in enumerate((0.5, 0.9))]
    )
    exact = e.rollup("event_type").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))
    both = exact.join(est, F.col("event_type").eqNullSafe(F.col("_type")))
    # Ranks of the estimated quantiles among the values: how many are below, and how many not above.
    ranks = e.join(F.broadcast(est.select("_type", "_q0", "_q1")), F.col("_type").isNull() | (F.col("_type") == F.col("event_type"))).groupBy("_type").agg(
        *[F.struct(F.count_if(F.col("value") < F.col(f"_q{i}")).alias("below"), F.count_if(F.col("value") <= F.col(f"_q{i}")).alias("upto"), F.count("value").alias("n")).alias(f"_r{i}") for i in (0, 1)]
    ).withColumnRenamed("_type", "_of")
    near = lambda i, q: (F.col(f"_r{i}.below") / F.col(f"_r{i}.n") <= q + sketches.RANK_ERROR) & (F.col(f"_r{i}.upto") / F.col(f"_r{i}.n") >= q - sketches.RANK_ERROR)
    return both.join(ranks, F.col("_type").eqNullSafe(F.col("_of"))).select(
        "event_type", F.col("_n").alias("n"), "n_users", (F.abs(F.col("_users") - F.col("n_users")) <= F.ceil(F.col("n_users") * sketches.DISTINCT_ERROR)).alias("users_in_bound"),
        near(0, 0.5).alias("median_in_bound"), near(1, 0.9).alias("p90_in_bound")
    )


@query("variant_fields", """
SELECT event_type, k.key AS key, count(*) AS n, 'BIGINT' AS types, CAST(sum(CAST(json_extract(props, '$.' || k.key) AS BIGINT)) AS BIGINT) AS total FROM (SELECT event_type, props, unnest(json_keys(props)) AS key FROM events) k GROUP BY ALL
""".replace("k.key AS key", "key").replace("'$.' || k.key", "'$.' || key"))
def variant_fields(spark, sf_dir):
    """The fields of the events' properties, found in them."""
    return variants.fields_of(variants.parsed(_table(spark, sf_dir, "events"), "props"), "v", ["event_type"])


@query("variant_columns", """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events""")
def variant_columns(spark, sf_dir):
    """The events' properties as typed columns, by the schema that all of them have in common."""
    flat = variants.flatten(variants.parsed(_table(spark, sf_dir, "events"), "props"), "v", "props_")
    return flat.select("event_id", *[c for c in flat.columns if c.startswith("props_")])
