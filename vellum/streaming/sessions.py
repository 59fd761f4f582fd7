"""Sessions of a stream of events, as session windows, or as keyed state with event-time timers.

Each key's open sessions are its state. An event joins the open sessions that it is not further than the gap from, and makes one of them where it bridges
several, so events may come in any order within the watermark's delay. A session is put out once, when the watermark has passed its end by the gap. The state
lives in the checkpoint, so a query that is started again goes on with the sessions that were open.

Spark's session windows, which run without Python, leave out an event that is behind the watermark by the gap or more; one that is behind it by less joins what is open, or
begins a session of its own. With strict, Python keeps the state and leaves out all events behind the watermark, so nothing that could belong to a session comes after it is out.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = T.StructType([T.StructField(c, T.LongType()) for c in ("first", "last", "n", "amount")])


def merge(sessions: list[tuple[int, int, int, int]], gap: int) -> list[tuple[int, int, int, int]]:
    """(first, last, n, amount) of sessions in any order, those within the gap of one another made one."""
    out: list[tuple[int, int, int, int]] = []
    for first, last, n, amount in sorted(sessions):
        if out and first - out[-1][1] <= gap:
            a, b, m, s = out[-1]
            out[-1] = (a, max(b, last), m + n, s + amount)
        else:
            out.append((first, last, n, amount))
    return out


class Sessions(StatefulProcessor):
    """gap: microseconds."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self._known()
        new = [(t, t, 1, a) for frame in rows for t, a in zip(frame["us"].tolist(), frame["amount"].tolist())]
        self._keep(merge(known + new, self.gap), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        known = self._known()
        over = [s for s in known if self._due(s) <= now]
        self._keep([s for s in known if self._due(s) > now], now, bool(known))
        if over:
            yield pd.DataFrame([(key[0], *s) for s in over], columns=["user_id", "first", "last", "n", "amount"])

    def _known(self) -> list[tuple[int, int, int, int]]:
        return [tuple(int(x) for x in s) for s in self.open.get()]

    def _due(self, session: tuple[int, int, int, int]) -> int:
        """The millisecond from which the watermark leaves nothing that could join a session."""
        return -(-(session[1] + self.gap) // 1000)

    def _keep(self, sessions: list[tuple[int, int, int, int]], now: int, had: bool = True) -> None:
        """Store a key's open sessions, with one timer: that of the first to end. When it fires, all that are over then go out and the next one gets it."""
        if sessions:
            self.open.put(sessions)
            self.handle.registerTimer(max(min(map(self._due, sessions)), now + 1))
        elif had:
            self.open.clear()

    def close(self) -> None:
        pass


@contextmanager
def _state_store(spark: SparkSession):
    """The session's setting for keyed state while a query starts; the query keeps it, the session gets its own back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def sessions(events: DataFrame, gap_seconds: int, delay: str, key: str = "user_id", ts: str = "ts", amount: str = "value", strict: bool = False) -> DataFrame:
    """(user_id, first, last, n, amount) of closed sessions of a stream; first and last in microseconds, amount the sum in hundredths.

    Events with a null key or time are left out, a null amount counts as 0. strict: see above; a few calls between Python and the state for each key, so for streams of few.
    """
    rows = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).cast("long").alias("user_id"), F.col(ts).cast("timestamp").alias("at"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.coalesce(F.round(F.col(amount) * 100), F.lit(0)).cast("long").alias("amount")
    ).withWatermark("at", delay)
    if strict:
        return rows.groupBy("user_id").transformWithStateInPandas(
            statefulProcessor=Sessions(gap_seconds * 1_000_000), outputStructType="user_id long, first long, last long, n long, amount long", outputMode="Append",
            timeMode="EventTime"
        )
    return rows.groupBy("user_id", F.session_window("at", f"{gap_seconds} seconds")).agg(
        F.min("us").alias("first"), F.max("us").alias("last"), F.count("*").alias("n"), F.sum("amount").alias("amount")
    ).select("user_id", "first", "last", "n", "amount")


def session_stream(spark: SparkSession, source: str, target: str, checkpoint: str, gap_seconds: int = 1_800, delay: str = "10 minutes", files: int = 100, strict: bool = False):
    """Start a query that reads the Parquet files of events that source (a folder or a pattern of paths) has, `files` at a time, and appends closed sessions to target; it ends when all are read.

    Started again with the same checkpoint it reads new files only and goes on with the open sessions.
    """
    schema = spark.read.parquet(source).schema
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    with _state_store(spark):
        return sessions(events, gap_seconds, delay, strict=strict).writeStream.format("parquet").option("path", target).option(
            "checkpointLocation", checkpoint
        ).outputMode("append").trigger(availableNow=True).start()
