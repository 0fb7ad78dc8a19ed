"""Streaming twins fed in several micro-batches."""

import pytest
from pyspark.sql import functions as F

from privaudit.session import scratch_path
from privaudit.streaming import live, ordered

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def batches(spark):
    """Events split by time into five files, read as five micro-batches in order."""
    ev = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "events-split")
    n = ev.count()
    for i in range(5):
        ev.filter((F.col("event_id") >= i * n // 5) & (F.col("event_id") < (i + 1) * n // 5)).coalesce(1).write.mode("append").parquet(path)
    return ev, spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(path)


@pytest.fixture(scope="module")
def shuffled(spark):
    """Events in five batches whose times overlap by up to three hours, and the delay that covers it."""
    ev = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    at = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(3 * 3600)) * 1_000_000
    return ev, live.replayed(ev, at, {"event_id": -1, "user_id": -1, "event_type": "closing"}), "4 hours"


def test_sampling_counts_across_batches(shuffled):
    ev, stream, delay = shuffled
    got = {r.event_id for r in live.drain(live.sampled_stream(stream, "user_id", 4, delay), "t").collect()}
    seen, want = {}, set()
    for r in ev.orderBy("ts", "event_id").collect():
        seen[r.user_id] = seen.get(r.user_id, 0) + 1
        if seen[r.user_id] % 4 == 1:
            want.add(r.event_id)
    assert got == want


def test_rate_limit_across_batches(shuffled):
    ev, stream, delay = shuffled
    for key, window in (("event_type", 3_600_000), ("user_id", 1000)):
        got = {r.event_id for r in live.drain(live.rate_limited_stream(stream, key, window, delay), "t").collect()}
        last, want = {}, set()
        for r in ev.orderBy("ts", "event_id").collect():
            ms = int(r.ts.timestamp() * 1_000_000) // 1000
            if r[key] not in last or ms - last[r[key]] >= window:
                want.add(r.event_id)
                last[r[key]] = ms
        assert got == want


def test_consent_phases_across_batches(shuffled):
    ev, stream, delay = shuffled
    calls = stream.select(F.col("user_id").alias("package"), "ts", "event_id", F.col("event_type").alias("api"))
    got = {r.event_id: (r.phase, r.gates) for r in live.drain(live.consent_stream(calls, "signup", delay=delay), "t").collect()}
    g, want = {}, {}
    for r in ev.orderBy("ts", "event_id").collect():
        if r.event_type == "signup":
            g[r.user_id] = min(g.get(r.user_id, 0) + 1, 5)
        n = g.get(r.user_id, 0)
        want[r.event_id] = ("gate" if r.event_type == "signup" else "after" if n else "before", n)
    assert got == want


def test_state_keeps_rows_of_one_delay_and_forgets_windows(spark, shuffled):
    """What is left in the state after the last batch: the closing row, no window of the rate limit, no held rows of events."""
    ev, stream, delay = shuffled
    for k, v in ordered.ROCKSDB.items():
        spark.conf.set(k, v)
    out, state = scratch_path(spark, "forget"), scratch_path(spark, "forget-state")
    limited = live.rate_limited_stream(stream, "user_id", 1000, delay)
    q = limited.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(held) < 4 * ev.count() and held[-1] <= 8


def test_tokens_are_kept_as_long_as_asked(spark):
    rows = [("p", 0, 1, "in", "key=abcdefgh"), ("p", 5, 2, "out", "x abcdefgh y"), ("p", 500, 3, "out", "abcdefgh"), ("q", 1, 4, "out", "abcdefgh"), ("p", 501, 5, "out", None)]
    df = spark.createDataFrame(rows, "package string, s long, seq long, role string, text string").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000)).drop("s")
    for keep, want in ((None, {2, 3}), (60_000, {2})):
        stream = live.replayed(df, -F.unix_micros("ts"), {"package": "closing", "seq": -1}, 3)
        assert {r.seq for r in live.drain(live.token_stream(stream, "[a-z]{8,}", "20 minutes", keep), "t").collect()} == want


def test_windows_and_late_rows(spark, batches):
    ev, stream = batches
    calls = stream.select(F.col("user_id").alias("package"), F.col("event_type").alias("api"), "ts")
    w = live.drain(live.api_windows(calls, size="1 day"), "t")
    batch = ev.groupBy(F.col("user_id").alias("package"), F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"))
    edge = ev.agg(F.max("ts")).first()[0]
    want = {(r.package, r.w.start, r.n) for r in batch.collect() if r.w.end.timestamp() <= edge.timestamp() - 11}
    assert {(r.package, r.window_start, r.n) for r in w.collect()} == want
    path = scratch_path(spark, "late-src")
    for i, t in enumerate(("2024-01-01 00:10:00", "2024-01-01 00:00:00", "2024-01-01 00:09:55")):
        spark.sql(f"select {i} id, timestamp'{t}' ts").coalesce(1).write.mode("append").parquet(path)
    src = spark.readStream.schema("id int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    out, late = scratch_path(spark, "o"), scratch_path(spark, "l")
    live.write_with_late_table(src, out, late, scratch_path(spark, "c")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [0, 2]
    assert [r.id for r in spark.read.schema("id int, ts timestamp").parquet(late).collect()] == [1]


def test_router_precedence(spark):
    msgs = ['{"type":"send","payload":{"category":"CryptoAPI","class":"C","method":"m"}}', '{"type":"send","payload":"{\\"class\\":\\"C\\",\\"method\\":\\"m\\"}"}', '{"type":"send","payload":{"fs":{"function":"write"}}}',
            '{"type":"send","payload":{"fs":{"x":1}}}', '{"type":"send","payload":{"deviceid":"d1"}}', '{"type":"error","stack":"s"}', '{"type":"send","payload":[1]}']
    got = live.route_messages(spark.createDataFrame([(i, m) for i, m in enumerate(msgs)], "id int, message string"))
    assert {(r.id, r.kind) for r in got.collect()} == {(0, "crypto"), (1, "api"), (2, "fs"), (4, "deviceid")}
    assert {r.id: r.body for r in got.collect()}[2] == '{"function":"write"}'


def test_rows_of_a_null_key_leave_other_keys_alone(spark):
    keys = [None, 3, 5, 149]
    rows = [(keys[i % 4], f"2024-01-01 00:{i:02d}:00", i) for i in range(40)]
    df = spark.createDataFrame(rows, "user_id long, ts string, event_id long").withColumn("ts", F.col("ts").cast("timestamp"))
    stream = live.replayed(df.coalesce(1), F.unix_micros("ts"), {"user_id": -1, "event_id": -1}, batches=2)
    got = {(r["user_id"], r["event_id"]) for r in live.drain(live.sampled_stream(stream, "user_id", 3, "1 hour"), "null-key").collect()}
    assert got == {(keys[i % 4], i) for i in range(40) if i // 4 % 3 == 0}
