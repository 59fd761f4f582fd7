"""Nearest vectors through an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import vectors
from vellum.plans.durable import settle
from vellum.plans.registry import query


@query("ivf_nearest")
def ivf_nearest(spark, sf_dir):
    """The five nearest of every hundredth vector, through cells, with the fewest probes that a sample of other vectors needs."""
    rows = vectors.usable(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    centres = vectors.fit_centres(rows)
    index = settle(vectors.assign(rows, centres))
    as_query = lambda x: x.select(F.col("id").alias("q"), "v")
    probes = vectors.calibrate(index, as_query(rows.filter("id % 100 <> 0")), centres)
    return vectors.search(index, as_query(rows.filter("id % 100 = 0")), centres, probes=probes).select("q", F.col("id").alias("vec_id"), "neural", "rank")
