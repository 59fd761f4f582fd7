"""Plain relational queries that exercise the base engine: join, grouping, window, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.plans.registry import query


def t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("revenue_by_flag", """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-06-01' GROUP BY l_returnflag, l_linestatus
""")
def revenue_by_flag(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.to_timestamp(F.lit("2000-06-01")))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
        F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n")
    )


@query(
    "balance_grouping_sets",
    "SELECT r_name, c_mktsegment, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY GROUPING SETS ((r_name, c_mktsegment), (r_name), ())"
)
def balance_grouping_sets(spark, sf_dir):
    j = t(spark, sf_dir, "customer").join(
        t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).join(t(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupingSets([["r_name", "c_mktsegment"], ["r_name"], []], "r_name", "c_mktsegment").agg(
        F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance")
    )


@query(
    "last_orders",
    "SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS n FROM orders) o WHERE n <= 2"
)
def last_orders(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return t(spark, sf_dir, "orders").withColumn("n", F.row_number().over(w)).filter("n <= 2").select("o_custkey", "o_orderkey", "n")


@query("customers_without_open_orders", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def customers_without_open_orders(spark, sf_dir):
    return t(spark, sf_dir, "customer").select("c_custkey").join(
        t(spark, sf_dir, "orders").filter("o_orderstatus = 'P'"), F.col("c_custkey") == F.col("o_custkey"), "left_anti"
    ).distinct()
