"""Nearest vectors through an inverted file: every vector lies in the cell of its nearest centre, and a query looks into the cells nearest to it.

Centres are fitted by k-means on a bounded sample (PER_CELL vectors a cell, by a hash of the id); every vector is then assigned. How many cells a query has to
look into is measured: calibrate() takes the fewest that find the wanted share of the true neighbours of a bounded sample of queries. With all cells the search
is exact. A cell that holds many vectors, copies say, is dealt in parts, and queries come to a part in blocks, so what meets in a task is bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.operators.rows import in_batches
from vellum.plans.durable import settle

#: Vectors of a cell that centres are fitted on, on the average; bytes of centres at most, which are sent to all workers.
PER_CELL = 64
CENTRE_BYTES = 16_000_000
#: Vectors of a part of a cell and queries of a block, about.
PART = 20_000
BLOCK = 4_096
#: Scores that a worker holds at a time.
AT_ONCE = 1_000_000
#: Queries that calibrate() measures at most.
MEASURED = 256


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, v) of the vectors with an id and a direction: not null, no null, NaN or infinite component, not all 0."""
    v = F.col(f"`{vector_col}`")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = in_batches(vectors).filter(F.col(f"`{id_col}`").isNotNull() & v.isNotNull() & ~odd & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.cast("array<double>").alias("v"))


def fit_centres(rows: DataFrame, cells: int | None = None, per_cell: int = PER_CELL, seed: int = 7) -> np.ndarray:
    """Unit centres by spherical k-means (Spark ML) on cells * per_cell of rows(id, v). cells: about 4 times the root of the number of rows, as far as the centres fit."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n:
        return np.zeros((0, 1))
    most = max(1, CENTRE_BYTES // (8 * dim))
    cells = max(1, min(cells or round(4 * n**0.5), most, n // 4))
    share = min(1.0, cells * per_cell / n)
    sample = rows.filter((F.size("v") == dim) & (F.pmod(F.xxhash64("id"), F.lit(2**31)) < int(share * 2**31))).select(array_to_vector("v").alias("features"))
    sample = settle(sample)  # k-means reads it again and again
    if cells == 1 or sample.count() <= cells:
        return np.ones((1, dim)) / dim**0.5
    model = KMeans(k=cells, maxIter=8, seed=seed, distanceMeasure="cosine", initMode="random").fit(sample)
    centres = np.array(model.clusterCenters())
    return centres / np.linalg.norm(centres, axis=1, keepdims=True)


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of the vectors of the right length, and which these are."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat, at = vectors.values.to_numpy(), vectors.offsets.to_numpy()
    right = np.flatnonzero(sizes == dim)
    x = np.stack([flat[at[i] : at[i] + dim] for i in right]) if len(right) else np.zeros((0, dim))
    return x / np.abs(x).max(1, keepdims=True) / np.linalg.norm(x / np.abs(x).max(1, keepdims=True), axis=1, keepdims=True), right


def nearest_cells(v: Column, centres: np.ndarray, probes: int) -> Column:
    """The `probes` cells nearest to a vector, nearest first; none for a vector of another length."""
    probes = min(probes, len(centres))

    def run(vectors: pa.Array) -> pa.Array:
        x, right = _matrix(vectors, centres.shape[1])
        out: list = [[] for _ in range(len(vectors))]
        if probes:
            step = max(1, AT_ONCE // len(centres))
            for at in range(0, len(x), step):
                found = np.argsort(-(x[at : at + step] @ centres.T), axis=1, kind="stable")[:, :probes]
                for i, cells in zip(right[at : at + step], found.astype(np.int32)):
                    out[i] = cells
        return pa.array(out, pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(v)


def assign(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """The index: (cell, id, v) of every row of rows(id, v) of the centres' length. Write it partitioned or bucketed by cell to keep it."""
    return rows.withColumn("cell", F.get(nearest_cells(F.col("v"), centres, 1), F.lit(0))).filter("cell IS NOT NULL").select("cell", "id", "v")


def search(index: DataFrame, queries: DataFrame, centres: np.ndarray, k: int = 5, probes: int | None = None) -> DataFrame:
    """(q, id, neural, rank, cell): for each of queries(q, v) the k nearest of the index but itself, by (cosine + 1) / 2 to five places, ties by id.

    probes: cells that a query looks into; without it all, which is exact. index must be cheap to read twice.
    """
    looked = queries.withColumn("cell", F.explode(nearest_cells(F.col("v"), centres, probes or len(centres))))
    parts = F.broadcast(index.groupBy("cell").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))  # a row a cell
    blocks = max(1, -(-queries.count() // BLOCK))
    left = index.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")
    left = left.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = looked.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = right.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
    dim = centres.shape[1]

    def best(key, vectors: pa.Table, asked: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("id", pa.int64()), ("cosine", pa.float64()), ("cell", pa.int32())])
        if not len(vectors) or not len(asked):
            return schema.empty_table()
        x, _ = _matrix(vectors.column("x").combine_chunks(), dim)
        y, _ = _matrix(asked.column("y").combine_chunks(), dim)
        ids, qs = vectors.column("id").to_numpy(), asked.column("q").to_numpy()
        out = []
        step = max(1, AT_ONCE // len(ids))
        for at in range(0, len(qs), step):
            s = y[at : at + step] @ x.T
            s[qs[at : at + step, None] == ids[None, :]] = -9
            kth = np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
            # Scores are rounded and ties go by id, so what may tie with the k-th stays.
            q, i = np.nonzero((s >= np.maximum(kth, -2)[:, None] - 4e-5) & (s > -2))
            out.append((qs[at + q], ids[i], s[q, i]))
        q, i, s = (np.concatenate(c) for c in zip(*out))
        return pa.Table.from_arrays([pa.array(q), pa.array(i), pa.array(s), pa.array(np.full(len(q), key[0].as_py(), np.int32))], schema=schema)

    by = ["cell", "part", "block"]
    # New names tell the two sides apart, which may come from one table.
    left = left.select(*[F.col(c).alias(f"_{c}") for c in by], "id", F.col("v").alias("x"))
    right = right.select(*[F.col(c).alias(f"_{c}") for c in by], "q", F.col("v").alias("y"))
    by = [f"_{c}" for c in by]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, "q long, id long, cosine double, cell int")
    neural = F.round(F.least(F.greatest((F.col("cosine") + 1) / 2, F.lit(0.0)), F.lit(1.0)), 5)
    order = Window.partitionBy("q").orderBy(F.desc("neural"), "id")
    ranked = found.select("q", "id", neural.alias("neural"), "cell").withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= k).select("q", "id", "neural", "rank", "cell")


def calibrate(index: DataFrame, sample: DataFrame, centres: np.ndarray, k: int = 5, wanted: float = 0.93) -> int:
    """The fewest probes that find the wanted share of the k nearest of the queries sample(q, v), of which MEASURED are taken; they are found exactly first."""
    asked = settle(sample.orderBy(F.xxhash64("q"), "q").limit(MEASURED))
    true = search(index, asked, centres, k).select("q", "cell")
    ranks = true.join(asked.select("q", nearest_cells(F.col("v"), centres, len(centres)).alias("cells")), "q")
    places = sorted(r[0] for r in ranks.select(F.array_position("cells", F.col("cell"))).collect())  # k * MEASURED at most
    return int(places[max(0, -(-int(len(places) * wanted * 1000) // 1000) - 1)]) if places else 1
