"""Exact top-k search by integer inner product, over document-range blocks that are pruned one at a time.

Vectors are ordered by their strongest components, cut into ranges of BLOCK vectors, and each range is kept as one row: its forward
index (the vectors themselves), and each component's largest and smallest value in the range. A query's products with these, summed, bound
its scores in the block. A query takes the blocks in the order of their bounds and stops where a bound falls below its k-th best score, which
starts at what the query finds among the blocks around its own. Queries are sent to the blocks in passes of bounded size, so no vector
is ever shuffled to meet a query, and each task returns k rows a query at most.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.common import checkpoint_folder, column, settle

K = 5
#: Vectors in a block; blocks that a task orders at a time.
BLOCK = 64
TOGETHER = 128
#: Queries, and bytes of them, that are sent at a time.
PASS_ROWS = 16_384
PASS_BYTES = 16_000_000
_NONE = np.iinfo(np.int64).max

BLOCKS = "block long, dim int, item int, ids array<long>, vectors binary, high binary, low binary"
FOUND = "row long, query_id long, vec_id long, score long"


def whole(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: neither it nor a component is null, and all components are finite."""
    bad = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return vector.isNotNull() & ~F.exists(vector, bad)


def blocks_of(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The blocks of all vectors that take part, settled."""
    v = F.col("v")
    rows = vectors.filter(usable(column(vector_col))).select(column(id_col).cast("long").alias("id"), whole(column(vector_col)).alias("v"))
    order = [F.size(v), F.array_position(v, F.array_max(v)), F.array_position(v, F.array_min(v)), F.asc_nulls_last("id")]
    rows = rows.withColumns({f"_{i}": o for i, o in enumerate(order[:3])})
    order = ["_0", "_1", "_2", F.asc_nulls_last("id")]
    # As many partitions as the session asks for: blocks are few bytes and much work, so they must not be coalesced by size.
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id", "v").mapInArrow(_pack, BLOCKS))


def _pack(batches):
    block = TaskContext.get().partitionId() << 26
    for batch in batches:
        lists, ids, out = batch.column("v"), batch.column("id"), []
        offsets = lists.offsets.to_numpy()
        values, dims, at = lists.values.to_numpy(), np.diff(offsets), 0
        while at < len(dims):
            end = min(at + BLOCK, len(dims))
            other = np.flatnonzero(dims[at:end] != dims[at])
            end = at + int(other[0]) if len(other) else end
            x = values[offsets[at] : offsets[end]].reshape(end - at, int(dims[at]))
            kind = next(k for k in ("<i1", "<i2", "<i4", "<i8") if not x.size or (x.min() >= np.iinfo(k).min and x.max() <= np.iinfo(k).max))
            out.append((block, x.shape[1], int(kind[2]), ids[at:end], x.astype(kind).tobytes(), x.max(0).astype("<i8").tobytes(), x.min(0).astype("<i8").tobytes()))
            block, at = block + 1, end
        cols = list(zip(*out)) if out else [[]] * 7
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array([i.to_pylist() for i in cols[3]], pa.list_(pa.int64()))]
            + [pa.array(c, pa.binary()) for c in cols[4:]], names=["block", "dim", "item", "ids", "vectors", "high", "low"]
        )


class Search:
    """The k best vectors of some queries of one dimension, over blocks as they come.

    exact: the numbers' type, float64 where every score is below 2**53, else Python's integers.
    """

    def __init__(self, queries: np.ndarray, rows: np.ndarray, floors: np.ndarray, k: int, exact):
        self.queries, self.rows, self.k, self.exact = queries.astype(exact), rows, k, exact
        self.over, self.under = np.maximum(self.queries, 0), np.minimum(self.queries, 0)
        self.scores = np.full((len(rows), k), -np.inf, exact)
        self.ids = np.full((len(rows), k), _NONE)
        self.kth = floors.astype(exact)
        self.scored = self.seen = 0

    def take(self, blocks: list[tuple]) -> None:
        """blocks: (block, ids with _NONE for null, vectors, high, low)."""
        high, low = (np.stack([b[i] for b in blocks]).astype(self.exact) for i in (3, 4))
        bounds = self.over @ high.T + self.under @ low.T
        self.seen += bounds.size
        order = np.argsort(-bounds, axis=1, kind="stable")
        at, step = 0, 1
        active = np.arange(len(self.rows))
        while at < len(blocks) and len(active):
            near = order[active, at : at + step]
            own = np.repeat(active, near.shape[1])
            near = near.ravel()
            sort = np.argsort(near, kind="stable")
            which, first = np.unique(near[sort], return_index=True)
            for b, who in zip(which, np.split(own[sort], first[1:])):
                who = who[bounds[who, b] >= self.kth[who]]
                if len(who):
                    self.score(blocks[b], who)
            at, step = at + step, min(2 * step, TOGETHER)
            if at < len(blocks):
                active = active[bounds[active, order[active, at]] >= self.kth[active]]

    def score(self, block: tuple, who: np.ndarray) -> None:
        number, ids, vectors, *_ = block
        self.scored += len(who)
        s = self.queries[who] @ vectors.astype(self.exact).T
        own = self.rows[who] - number * BLOCK
        mine = np.flatnonzero((own >= 0) & (own < len(ids)))
        s[mine, own[mine]] = -np.inf
        hit = np.flatnonzero((s >= self.kth[who][:, None]).any(1) & (s > -np.inf).any(1))
        if not len(hit):
            return
        who = who[hit]
        scores = np.hstack([self.scores[who], s[hit]])
        every = np.hstack([self.ids[who], np.broadcast_to(ids, (len(who), len(ids)))])
        if self.exact is object:
            best = np.array([sorted(range(len(x)), key=lambda i: (-x[i], y[i]))[: self.k] for x, y in zip(scores, every)])
        else:
            best = np.lexsort((every, -scores))[:, : self.k]
        self.scores[who], self.ids[who] = np.take_along_axis(scores, best, 1), np.take_along_axis(every, best, 1)
        self.kth[who] = np.maximum(self.kth[who], self.scores[who, -1])


def _read(batch: pa.RecordBatch):
    """(dimension, blocks) of a batch of blocks, TOGETHER at most of one dimension at a time."""
    dims, items = batch.column("dim").to_pylist(), batch.column("item").to_pylist()
    at = 0
    while at < len(dims):
        end = at + 1
        while end < len(dims) and end - at < TOGETHER and dims[end] == dims[at]:
            end += 1
        out = []
        for i in range(at, end):
            ids = np.array([_NONE if x is None else x for x in batch.column("ids")[i].as_py()], np.int64)
            get = lambda c, kind: np.frombuffer(batch.column(c)[i].as_buffer(), kind)  # noqa: B023, E731
            out.append((batch.column("block")[i].as_py(), ids, get("vectors", f"<i{items[i]}").reshape(len(ids), dims[i]), get("high", "<i8"), get("low", "<i8")))
        yield dims[at], out
        at = end


def _queries(every: int, k: int, exact):
    """The queries among the blocks, each with the k-th best score among the blocks around its own."""

    def run(batches):
        for batch in batches:
            for _, blocks in _read(batch):
                picked = [(b[0] * BLOCK + i, int(b[1][i]), b[2][i]) for b in blocks for i in np.flatnonzero((b[1] != _NONE) & (b[1] % every == 0))]
                if not picked:
                    continue
                rows, ids, vectors = zip(*picked)
                near = Search(np.stack(vectors), np.array(rows), np.full(len(rows), -np.inf), k, exact)
                near.take(blocks)
                floors = [None if exact is object or not np.isfinite(x) else float(x) for x in near.kth]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array([v.astype("<i8").tobytes() for v in vectors], pa.binary()), pa.array(floors, pa.float64())],
                    names=["row", "query_id", "vector", "floor"],
                )

    return run


def _search(asked: list, k: int, exact):
    """asked: rows (row, query_id, vector, floor)."""
    by_dim: dict[int, list] = {}
    for r in asked:
        by_dim.setdefault(len(r[2]) // 8, []).append(r)

    def run(batches):
        running: dict[int, tuple] = {}
        for batch in batches:
            for dim, blocks in _read(batch):
                if dim in by_dim:
                    if dim not in running:
                        rows, ids, vectors, floors = zip(*by_dim[dim])
                        q = np.stack([np.frombuffer(v, "<i8") for v in vectors])
                        running[dim] = ids, Search(q, np.array(rows), np.array([-np.inf if f is None else f for f in floors]), k, exact)
                    running[dim][1].take(blocks)
        for ids, s in running.values():
            q, j = np.nonzero(s.scores.astype(float) > -np.inf)
            limit = 2**63 - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(s.rows[q], pa.int64()), pa.array(np.array(ids)[q], pa.int64()),
                    pa.array([None if x == _NONE else int(x) for x in s.ids[q, j]], pa.int64()),
                    pa.array([max(-limit, min(limit, int(x))) for x in s.scores[q, j]], pa.int64()),
                ], names=["row", "query_id", "vec_id", "score"],
            )

    return run


def top_k(
    vectors: DataFrame, every: int = 50, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", pass_rows: int = PASS_ROWS
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other vectors for each whose id is divisible by `every`.

    A score is the inner product of floor(256 * x). Vectors that are null or hold a null, NaN or infinite component take no part. Ties go to the smaller id,
    a null id comes last. A vector with a null id is a candidate and no query; rows that share an id, equal ones too, are candidates of one another, and each is a query
    of its own. Vectors are scored against those of their own length alone; empty ones score 0. A component beyond 64 bits counts as
    the largest number of 64 bits, and so does such a score, though it is ordered by its true size within a task. An empty table gives no rows.
    """
    spark, blocks = vectors.sparkSession, blocks_of(vectors, id_col, vector_col)
    item, dim = blocks.agg(F.max("item"), F.max("dim")).first()
    # Scores stay below 2**53 for components of up to 16 bits; wider ones are taken as Python's integers.
    exact = np.float64 if not item or item <= 2 and dim < 2**21 else object
    queries = settle(blocks.mapInArrow(_queries(every, k, exact), "row long, query_id long, vector binary, floor double"))
    n, length = queries.agg(F.count("*"), F.max(F.octet_length("vector"))).first()
    size = max(1, min(pass_rows, PASS_BYTES // max(1, length or 1)))
    passes = -(-n // size)
    part = F.pmod(F.xxhash64("row"), F.lit(max(1, passes)))
    found = spark.createDataFrame([], FOUND)
    if passes == 1:
        found = blocks.mapInArrow(_search([tuple(r) for r in queries.collect()], k, exact), FOUND)
    elif passes:
        path = f"{checkpoint_folder(spark)}/topk-{uuid.uuid4().hex}"
        for i in range(passes):
            asked = [tuple(r) for r in queries.filter(part == i).collect()]  # about `size` of them
            blocks.mapInArrow(_search(asked, k, exact), FOUND).write.mode("append").parquet(path)
        found = spark.read.schema(FOUND).parquet(path)
    best = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
