"""Keys of documents for operators that bring a document's rows together, and their spreading over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.plans.durable import settle


def keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """((doc_id, full), names): documents under a key that is never null and never comes twice, and (doc_id, name) to lead back from it.

    Where the ids are such keys already they are kept and names is None. Where some are null or come twice, each row gets
    a number, in a settled table, so that it is the same in every use.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("full"))
    if texts.groupBy("doc_id").count().filter("doc_id IS NULL OR count > 1").isEmpty():
        return texts, None
    rows = settle(texts.withColumn("_row", F.monotonically_increasing_id()))
    return rows.select(F.col("_row").alias("doc_id"), "full"), rows.select(F.col("_row").alias("doc_id"), F.col("doc_id").alias("name"))


def named(result: DataFrame, names: DataFrame | None) -> DataFrame:
    """result with the documents' own ids again."""
    if names is None:
        return result
    cols = [F.col("name").alias(c) if c == "doc_id" else F.col(c) for c in result.columns]
    return result.join(names, "doc_id").select(*cols)


#: Bytes of input for each core under which a table's files are taken to be too few to keep all cores busy.
SMALL = 4_000_000


def spread(rows: DataFrame) -> DataFrame:
    """rows, dealt over all cores if the table is so small that its files would keep few of them busy; a larger table is left as it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if size < cores * SMALL else rows


def fits(df: DataFrame, rows: int, size: int = 32_000_000) -> bool:
    """Whether df has `rows` rows of `size` bytes together at most, so that it may be broadcast. A string counts with its length, any other value with 16 bytes."""
    each = [
        F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) + 16 if isinstance(f.dataType, T.StringType) else F.lit(16)
        for f in df.schema
    ]
    n, total = df.limit(rows + 1).select(
        sum(each[1:], each[0]).cast("long").alias("size")
    ).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return n <= rows and total <= size


#: Rows and bytes of an Arrow batch of texts at most.
BATCH_ROWS, BATCH_BYTES = 1_000, 4_000_000


def in_batches(rows: DataFrame) -> DataFrame:
    """rows, with the session's Arrow batches held to BATCH_ROWS rows and about BATCH_BYTES bytes for good, as they are made when a plan runs: what a worker holds of texts and of what it makes of them
    is small then, however large the table's files are. Narrower settings stay."""
    conf = rows.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return rows


#: Bytes of input that one task brings together at most, about; tasks at most.
DEALT, MOST_TASKS = 16_000_000, 20_000


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows by their keys over as many tasks as the tables that they are made of call for, so that what a task sorts or counts does not grow with them; small tables are left to Spark.

    Spark joins small partitions of its own exchanges by their compressed bytes, many times less than what sorting them takes.
    """
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    n = min(MOST_TASKS, -(-sum(x for x in sizes if x < 2**60) // DEALT))
    return rows.repartition(n, *keys) if n > rows.sparkSession.sparkContext.defaultParallelism else rows
