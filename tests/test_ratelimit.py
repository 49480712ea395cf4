"""The moving-window limit: batch and stream against a plain fold."""

import datetime as dt
import random
from collections import defaultdict, deque

import pytest

from larkspur.operators import ratelimit

START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SCHEMA = "event_id long, user_id long, ts timestamp"


def micros(t):
    return (t - START) // dt.timedelta(microseconds=1)


def brute(rows, seconds=60, most=10):
    out, by = [], defaultdict(list)
    for event, user, t in rows:
        if t is None:
            out.append((event, user, False))
        else:
            by[user].append((micros(t), event is not None, event or 0))
    for user, events in by.items():
        times = []
        for t, named, event in sorted(events):
            live = [x for x in times if x > t - seconds * 1_000_000]
            ok = len(live) < most
            times = live + [t] if ok else live
            out.append((event if named else None, user, ok))
    return sorted(out, key=repr)


def some(n, seed, users=(1, 2, None)):
    rng, rows = random.Random(seed), []
    at = dict.fromkeys(users, 0.0)
    for i in range(n):
        user = rng.choice(users)
        at[user] += rng.choice([0, 0, 0.000001, 0.5, 1, 3, 5.999999, 6, 20, 59.999999, 60, 60.000001, 700 if rng.random() < 0.2 else 1])
        rows.append((i if rng.random() < 0.98 else None, user, START + dt.timedelta(seconds=at[user])))
    return rows


def result(df):
    return sorted(((r.event_id, r.user_id, r.admitted) for r in df.collect()), key=repr)


def test_batch_equals_the_fold(spark):
    rows = some(3000, 1)
    rows += rows[:50] + [(9000, 1, None), (9001, None, None)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert result(ratelimit.admitted(df)) == brute(rows)
    assert result(ratelimit.admitted(df, seconds=7, most=2)) == brute(rows, 7, 2)
    assert result(ratelimit.admitted(df, seconds=1, most=1)) == brute(rows, 1, 1)
    assert result(ratelimit.admitted(df.limit(0))) == []
    with pytest.raises(ValueError):
        ratelimit.admitted(df, most=0)


def test_a_user_with_a_million_events_and_no_pause(spark):
    """One chain, scanned with a state of ten times; the first ten of each window are admitted."""
    n = 1_000_000
    df = spark.range(0, n, 1, 8).selectExpr("id as event_id", "7L as user_id", "timestamp_micros(id * 100000L) as ts")
    got = ratelimit.admitted(df).groupBy("admitted").count().collect()
    # Ten in the first second of each minute of 600 events.
    assert {r.admitted: r["count"] for r in got} == {True: n // 600 * 10 + 10, False: n - n // 600 * 10 - 10}


def test_state_does_not_grow():
    recent = deque()
    for _ in range(100):
        ratelimit.decide(list(range(0, 1000)), recent, 10_000, 10)
        assert len(recent) <= 10


def test_a_hot_user_is_cut_at_pauses(spark):
    """A third of all events is one user's; its chains are keys of their own."""
    rows = [(i, 1, START + dt.timedelta(seconds=i % 20 + 7200 * (i // 20))) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("event_id", "user_id", "unix_micros(ts) as at")
    assert ratelimit._chains(df, 60_000_000).select("__chain").distinct().count() == 200
    assert result(ratelimit.admitted(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def stream(spark, tmp_path, batches, **more):
    """Each batch of rows is a file and a micro-batch; then one far later event of another user moves the watermark on, twice."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for i, rows in enumerate([*batches, [(-1, -1, START + dt.timedelta(days=30))], [(-2, -1, START + dt.timedelta(days=60))]]):
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            events = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
            made = ratelimit.admissions(events, **more)
            q = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
            assert q.awaitTermination(180), i
        return sorted(((r.event_id, r.user_id, r.admitted) for r in spark.read.parquet(str(tmp_path / "out")).where("user_id is null or user_id >= 0").collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    """Events come out of order, over micro-batches that cut windows; the query is started anew for each."""
    rows = sorted(some(240, 3, users=(1, 2)), key=lambda r: r[2])
    rng = random.Random(4)
    jittered = sorted(rows, key=lambda r: r[2] + dt.timedelta(seconds=rng.uniform(0, 25)))
    batches = [jittered[:80], jittered[80:160], jittered[160:]]
    got = stream(spark, tmp_path, batches, late="30 seconds")
    assert got == result(ratelimit.admitted(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_late_rows_do_not_count(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [[(i, 1, at(100 + i)) for i in range(9)] + [(50, 2, at(300))], [(60, 2, at(310))], [(70, 1, at(105)), (71, 1, at(320)), (72, 1, None)]]
    got = stream(spark, tmp_path, batches, late="10 seconds")
    kept = [r for b in batches for r in b if r[0] != 70]
    assert got == brute(kept)
