"""Durable intermediate tables."""

from __future__ import annotations

import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, for what jobs write for one another.

    Where that is unset a local session gets a folder of its own; on a cluster it is an error, as a folder
    of one machine cannot be read by the others.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
            folder = tempfile.mkdtemp(prefix="vellum-")
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint df in the shared folder; it survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def no_constraints(spark: SparkSession):
    """Plans made within carry no constraints. Those that a settled table keeps can name columns that it has not, and a union of such tables then fails."""
    name = "spark.sql.constraintPropagation.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)
