"""Stateful streams over the table of events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from vellum.plans.durable import shared_folder
from vellum.plans.registry import query
from vellum.streaming.sessions import session_stream

#: Seconds without an event that end a session, and the watermark's delay.
GAP, DELAY = 1_800, 600


@query("session_events", f"""
WITH e AS (SELECT user_id, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS amount FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
b AS (SELECT *, CASE WHEN us - lag(us) OVER w <= {GAP * 1_000_000} THEN 0 ELSE 1 END AS fresh FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM b),
x AS (SELECT user_id, min(us) AS first, max(us) AS last, count(*) AS n, CAST(sum(coalesce(amount, 0)) AS BIGINT) AS amount FROM s GROUP BY user_id, k)
SELECT * FROM x WHERE ceil((last + {GAP * 1_000_000}) / 1000) <= (SELECT max(us) FROM e) // 1000 - {DELAY * 1000}
""")
def session_events(spark, sf_dir):
    """Sessions of all users by a stream over the events, as far as the watermark closes them."""
    folder = f"{shared_folder(spark)}/sessions-{uuid.uuid4().hex}"
    # A pattern, as the table may be one file, and a stream takes a plain path for a folder.
    session_stream(spark, f"{sf_dir}/events.parque[t]", f"{folder}/out", f"{folder}/state", GAP, f"{DELAY} seconds").awaitTermination()
    return spark.read.schema("user_id long, first long, last long, n long, amount long").parquet(f"{folder}/out").select("user_id", "first", "last", "n", F.col("amount"))
