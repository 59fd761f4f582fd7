"""Sessions by keyed state against a batch version: several files, late rows, a restart."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone

from vellum.streaming import sessions

BASE = datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
GAP, DELAY = 60, 30


def events(n, seed, users=5):
    rng, t, out = random.Random(seed), 0.0, []
    for i in range(n):
        t += rng.choice([0.5, 5, 20, 70])
        out.append((i, BASE + timedelta(seconds=t + rng.uniform(-10, 10)), rng.randrange(users), "click", round(rng.uniform(0, 9), 2), None))
    return out


def batch(rows, watermark):
    """Closed sessions of all rows."""
    out = Counter()
    micros = lambda t: round((t - BASE).total_seconds() * 1e6) + round(BASE.replace(tzinfo=timezone.utc).timestamp() * 1e6)
    for u in {r[2] for r in rows}:
        own = sorted((micros(r[1]), round(r[4] * 100)) for r in rows if r[2] == u)
        at = 0
        for i in range(1, len(own) + 1):
            if i == len(own) or own[i][0] - own[i - 1][0] > GAP * 1_000_000:
                part = own[at:i]
                if -(-(part[-1][0] + GAP * 1_000_000) // 1000) <= watermark // 1000:
                    out[u, part[0][0], part[-1][0], len(part), sum(a for _, a in part)] += 1
                at = i
    return out, micros


def run(spark, folder, files=1):
    sessions.session_stream(spark, str(folder / "in"), str(folder / "out"), str(folder / "state"), GAP, f"{DELAY} seconds", files).awaitTermination()
    return Counter(tuple(r) for r in spark.read.parquet(str(folder / "out")).select("user_id", "first", "last", "n", "amount").collect())


def put(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder / "in"))


def test_merge_bridges_sessions_in_any_order():
    assert sessions.merge([(50, 60, 1, 1), (0, 10, 2, 5), (15, 45, 1, 2)], 5) == [(0, 60, 4, 8)]
    assert sessions.merge([(50, 60, 1, 1), (0, 10, 2, 5)], 5) == [(0, 10, 2, 5), (50, 60, 1, 1)]
    assert sessions.merge([], 5) == []


def test_several_files_and_a_restart_equal_the_batch(spark, tmp_path):
    rows = events(400, 1)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    for i in range(0, 200, 50):
        put(spark, tmp_path, rows[i : i + 50])
    first = run(spark, tmp_path)
    assert spark.conf.get(setting, None) == before
    assert first and max(first.values()) == 1
    for i in range(200, 400, 50):  # the query starts again from its checkpoint, with sessions open
        put(spark, tmp_path, rows[i : i + 50])
    got = run(spark, tmp_path)
    _, micros = batch([], 0)
    want, _ = batch(rows, max(micros(r[1]) for r in rows) - DELAY * 1_000_000)
    assert got == want and got != first and set(first) <= set(got)
    assert run(spark, tmp_path) == got  # nothing new


def test_late_rows_and_rows_without_key_or_time_are_left_out(spark, tmp_path):
    rows = [(0, BASE + timedelta(seconds=s), 1, "click", 1.0, None) for s in (0, 30, 1_000)]
    put(spark, tmp_path, rows)
    run(spark, tmp_path)
    put(spark, tmp_path, [(1, BASE + timedelta(seconds=40), 1, "click", 1.0, None), (2, None, 1, "click", 1.0, None), (3, BASE + timedelta(seconds=2_000), None, "click", None, None),
                          (4, BASE + timedelta(seconds=990), 1, "click", None, None), (5, BASE + timedelta(seconds=3_000), 2, "click", 1.0, None)])
    got = run(spark, tmp_path)
    assert sorted((u, n, a) for u, _, _, n, a in got) == [(1, 2, 100), (1, 2, 200)]  # the row at 40 s came behind the watermark, the one at 990 s did not


def test_an_event_a_little_late_joins_its_open_session_or_is_left_out_when_strict(spark, tmp_path):
    want = {False: [(1, 2, 200)], True: [(1, 1, 100)]}
    for strict in (False, True):
        folder = tmp_path / str(strict)
        at = lambda s: BASE + timedelta(seconds=s)
        for i, rows in enumerate(([(0, at(1_000), 1, "click", 1.0, None)], [(1, at(960), 1, "click", 1.0, None), (2, at(5_000), None, "click", 1.0, None), (3, at(5_000), 2, "click", 1.0, None)])):
            put(spark, folder, rows)
            sessions.session_stream(spark, str(folder / "in"), str(folder / "out"), str(folder / "state"), GAP, f"{DELAY} seconds", strict=strict).awaitTermination()
        got = spark.read.parquet(str(folder / "out")).select("user_id", "n", "amount").collect()
        assert sorted(map(tuple, got)) == want[strict]


def test_the_stream_keeps_its_state_without_python(spark, tmp_path):
    put(spark, tmp_path, events(40, 3))
    stream = sessions.sessions(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), GAP, f"{DELAY} seconds")
    plan = stream._jdf.queryExecution().analyzed().toString()
    assert "session_window" in plan.lower() and "transformwithstate" not in plan.lower()
