"""Skew-safe scans equal the plain window, whatever the chunking and the shuffle width."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from privaudit.operators import explore
from privaudit.operators.scans import Running, asof_join, run_lengths, running

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def hot(spark):
    """Two thirds of all rows on one key."""
    ev = spark.read.parquet(f"{DATA}/events.parquet")
    return ev.withColumn("key", F.when(F.col("event_id") % 3 != 0, 1).otherwise(F.col("user_id"))).withColumn("sparse", F.when(F.col("event_id") % 5 == 0, F.col("event_id"))).cache()


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("hot_rows", [7, 60, 10**9])
def test_running_equals_window(hot, hot_rows):
    w = W.partitionBy("key").orderBy("ts", "event_id")
    up = w.rowsBetween(W.unboundedPreceding, 0)
    got = running(hot, ["key"], ["ts", "event_id"], [
        Running("n", "count"), Running("s", "sum", F.col("event_id")), Running("l", "last", F.col("sparse")), Running("p", "prev", F.col("sparse"))], hot_rows)
    want = hot.select("event_id", F.row_number().over(w).cast("long"), F.sum("event_id").over(up), F.last("sparse", True).over(up), F.lag("sparse").over(w))
    assert rows(got.select("event_id", "n", "s", "l", "p")) == rows(want)


@pytest.mark.parametrize("hot_rows", [13, 10**9])
def test_run_lengths(hot, hot_rows):
    got = run_lengths(hot, ["key"], ["ts", "event_id"], F.col("event_type") == "error", "pos", hot_rows=hot_rows).select("event_id", "pos")
    ordered, pos, n = hot.orderBy("key", "ts", "event_id").select("key", "event_id", "event_type").collect(), {}, {}
    for r in ordered:
        n[r.key] = 1 if r.event_type == "error" else n.get(r.key, 0) + 1
        pos[r.event_id] = n[r.key]
    assert {r.event_id: r.pos for r in got.collect()} == pos


@pytest.mark.parametrize("hot_rows", [11, 10**9])
def test_asof(hot, hot_rows):
    left = hot.filter("event_type = 'purchase'").select("key", "ts", "event_id")
    right = hot.filter("event_type = 'signup'").select("key", "ts", "event_id", F.col("value").alias("v"))
    got = asof_join(left, right, ["key"], "ts", "event_id", ["v"], hot_rows)
    r = right.collect()
    want = {}
    for x in left.collect():
        c = [y for y in r if y.key == x.key and y.ts <= x.ts]
        want[x.event_id] = max(c, key=lambda y: (y.ts, y.event_id)).v if c else None
    assert {x.event_id: x.v for x in got.collect()} == want


@pytest.mark.parametrize("chunk_ms", [60_000, 3_600_000, 10**10])
def test_rate_limit_is_independent_of_chunks(spark, hot, chunk_ms):
    got = explore.rate_limited(hot.select("key", "ts", "event_id"), "key", "ts", 1_800_000, chunk_ms)
    want, last, seen = set(), {}, set()
    for r in hot.select("key", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms")).orderBy("key", "ms", "event_id").collect():
        if (r.key, r.ms) in seen:
            continue
        seen.add((r.key, r.ms))
        if r.key not in last or r.ms - last[r.key] >= 1_800_000:
            want.add(r.event_id)
            last[r.key] = r.ms
    assert {r.event_id for r in got.collect()} == want


@pytest.mark.parametrize("window", [1500, 700, 5300])
def test_rate_limit_over_many_chunks(spark, window):
    """One key in some 1,700 chunks, gaps of many chunks and a window longer than a chunk included."""
    ms = [i * 700 + (i * i) % 613 + (i // 100) * 300_000 for i in range(2_500)]
    df = spark.createDataFrame([("k", m) for m in ms] + [(None, 5), ("n", None)], "key string, ms long").withColumn("ts", F.timestamp_millis("ms"))
    want, free = [], -1
    for m in sorted(set(ms)):
        if m >= free:
            want.append(m)
            free = m + window
    assert sorted(r.ms for r in explore.rate_limited(df, "key", "ts", window, 1000).collect()) == want


def test_same_answer_for_any_shuffle_width(spark, hot):
    s = hot.select(F.col("key").alias("run_id"), "ts", "event_id", F.col("value").alias("reward"), F.array("event_type").alias("api_list"), F.col("event_type").alias("activity"))
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        r = explore.running_metrics(s, ["run_id"], ["ts", "event_id"], hot_rows=50)
        seen.append(rows(r.select("run_id", "event_id", F.round("cum_reward", 4), "unique_apis", "unique_activities")))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2]


def test_trapped_after_ten_stuck_steps(spark):
    rows_ = [(1, i, "s", 1.0, True, i == 13) for i in range(1, 21)]
    st = explore.stuck_runs(spark.createDataFrame(rows_, "run_id int, step int, state_id string, xml_score double, img_same boolean, recovered boolean"), ["run_id"], ["step"])
    got = {r.step: (r.stuck_run, r.trapped) for r in st.collect()}
    assert got[11] == (11, True) and got[10] == (10, True) and got[9] == (9, False) and got[13] == (0, False) and got[14] == (1, False)


@pytest.mark.parametrize("hot_rows", [9, 10**9])
def test_stuck_and_repeat_runs_on_a_hot_run(hot, hot_rows):
    s = hot.select(F.col("key").alias("run_id"), "ts", "event_id", F.col("event_type").alias("state_id"), (F.col("value") / 50).alias("xml_score"), (F.col("event_id") % 2 == 0).alias("img_same"), F.lit(False).alias("recovered"))
    want, prev, n, act, rep = {}, {}, {}, {}, {}
    for r in s.orderBy("run_id", "ts", "event_id").collect():
        votes = (prev.get(r.run_id) == r.state_id) + (r.xml_score > 0.97) + r.img_same
        n[r.run_id] = n.get(r.run_id, 0) + 1 if votes >= 2 else 0
        rep[r.run_id] = rep[r.run_id] + 1 if prev.get(r.run_id) == r.state_id else 0
        prev[r.run_id] = r.state_id
        want[r.event_id] = (n[r.run_id], rep[r.run_id])
    a = {r.event_id: r.stuck_run for r in explore.stuck_runs(s, ["run_id"], ["ts", "event_id"], hot_rows).collect()}
    b = {r.event_id: r.repeat_count for r in explore.repeat_runs(s, ["run_id"], ["ts", "event_id"], "state_id", hot_rows).collect()}
    assert {k: (a[k], b[k]) for k in a} == want
