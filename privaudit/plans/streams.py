"""Streaming twins on the events and conversations tables; the SQL is the batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from privaudit.plans.registry import query
from privaudit.session import scratch_path, table
from privaudit.streaming import live


def events(spark, sf):
    return live.stream_table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


#: Hours by which events arrive late in the replay, and how long rows are waited for.
DISORDER, DELAY = 6, "7 hours"


def arrival():
    """Microseconds at which an event arrives: its time and up to DISORDER hours more."""
    return F.unix_micros("ts") + (F.col("event_id") * 7919 % (DISORDER * 3600)) * 1_000_000


def shuffled(spark, sf, **closing):
    """Events in five batches by arrival time, so that a batch brings rows older than some of the batch before."""
    ev = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return live.replayed(ev, arrival(), {"user_id": -1, "event_type": "closing", "event_id": -1, **closing})


def _ntz(df):
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).withColumn("window_end", F.col("window_end").cast("timestamp_ntz")).withColumn("apis", F.array_join("apis", ","))


# a window is emitted once its end is no later than the watermark, which has millisecond precision
MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 SECOND FROM events)"


@query("stream_window_apis", f"""
SELECT user_id AS package, date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS apis, count(*) AS n
FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {MARK} GROUP BY 1, 2, 3""")
def stream_window_apis(spark, sf):
    calls = events(spark, sf).select(F.col("user_id").alias("package"), F.col("event_type").alias("api"), "ts")
    return _ntz(live.drain(live.api_windows(calls, size="1 day"), "window-apis"))


@query("stream_sliding_apis", f"""
WITH e AS (SELECT event_type AS package, 'u' || (user_id % 7) AS api, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS ws FROM events)
SELECT package, ws AS window_start, ws + INTERVAL 2 HOUR AS window_end, string_agg(DISTINCT api, ',' ORDER BY api) AS apis, count(*) AS n FROM e WHERE ws + INTERVAL 2 HOUR <= {MARK} GROUP BY 1, 2, 3""")
def stream_sliding_apis(spark, sf):
    calls = events(spark, sf).select(F.col("event_type").alias("package"), F.concat(F.lit("u"), (F.col("user_id") % 7).cast("string")).alias("api"), "ts")
    return _ntz(live.drain(live.api_windows(calls, size="2 hours", slide="1 hour"), "sliding-apis"))


@query("stream_session_apis", f"""
WITH g AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 6 HOUR)::INT AS brk FROM events),
s AS (SELECT *, sum(coalesce(brk, 1)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS sid FROM g),
w AS (SELECT user_id AS package, min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS apis, count(*) AS n FROM s GROUP BY user_id, sid)
SELECT * FROM w WHERE window_end <= {MARK}""")
def stream_session_apis(spark, sf):
    calls = events(spark, sf).select(F.col("user_id").alias("package"), F.col("event_type").alias("api"), "ts")
    return _ntz(live.drain(live.api_windows(calls, gap="6 hours"), "session-apis"))


@query("stream_correlation", """
SELECT c.user_id AS package, c.event_id AS call_id, t.event_id AS seq FROM events c JOIN events t ON c.user_id = t.user_id
 AND t.ts BETWEEN c.ts - INTERVAL 60 SECOND AND c.ts + INTERVAL 3600 SECOND WHERE c.event_type = 'click' AND t.event_type = 'error'""")
def stream_correlation(spark, sf):
    c = events(spark, sf).filter("event_type = 'click'").select(F.col("user_id").alias("package"), F.col("event_id").alias("call_id"), "ts")
    t = events(spark, sf).filter("event_type = 'error'").select(F.col("user_id").alias("package"), F.col("event_id").alias("seq"), "ts")
    return live.drain(live.correlate_stream(c, t, "60 seconds", "3600 seconds"), "correlation").select("package", "call_id", "seq")


@query("stream_router", """
SELECT CASE WHEN event_id % 5 = 4 THEN 'crypto' WHEN event_type = 'click' THEN 'api' WHEN event_type = 'view' THEN 'java' WHEN event_type = 'error' THEN 'hookerror' ELSE 'deviceid' END AS kind,
       (event_id % 2 + 1)::INT AS stage, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_id % 7 <> 0 AND event_type <> 'purchase' GROUP BY 1, 2""")
def stream_router(spark, sf):
    """Events as hook messages, some with a JSON-string payload, some of another type or without a known key."""
    e, k = F.col("event_type"), F.col("event_id")
    body = (F.when(e == "purchase", F.to_json(F.struct(F.col("user_id").alias("other"))))
            .when(k % 5 == 4, F.to_json(F.struct(F.lit("CryptoAPI").alias("category"), F.col("user_id"), F.lit("C").alias("class"), F.lit("m").alias("method"))))
            .when(e == "click", F.to_json(F.struct(F.lit("C").alias("class"), F.lit("m").alias("method"), F.col("user_id"))))
            .when(e == "view", F.to_json(F.struct(F.struct(F.col("user_id")).alias("java"))))
            .when(e == "error", F.to_json(F.struct(F.struct(F.col("user_id")).alias("hookerror")))).otherwise(F.to_json(F.struct(F.col("user_id").alias("deviceid")))))
    as_text = F.to_json(F.struct(F.lit("send").alias("type"), body.alias("payload")))
    as_object = F.concat(F.lit('{"type":"send","payload":'), body, F.lit("}"))
    msg = F.when(k % 7 == 0, '{"type":"error"}').when(k % 3 == 0, as_text).otherwise(as_object)
    raw = events(spark, sf).select(msg.alias("message"), (k % 2 + 1).cast("int").alias("stage_no"), "user_id")
    out = scratch_path(spark, "router")
    live.write_by_kind(live.route_messages(raw, stage=F.col("stage_no")), out, scratch_path(spark, "router-state")).awaitTermination()
    return spark.read.parquet(out).groupBy("kind", "stage").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("stream_rate_limit", """
WITH RECURSIVE e AS (SELECT event_type, epoch_ms(ts) AS ms, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2),
k AS (SELECT event_type, min(ms) AS ms FROM e GROUP BY 1 UNION ALL SELECT k.event_type, (SELECT min(ms) FROM e WHERE e.event_type = k.event_type AND e.ms >= k.ms + 1800000) FROM k WHERE k.ms IS NOT NULL)
SELECT k.event_type, e.event_id FROM k JOIN e ON e.event_type = k.event_type AND e.ms = k.ms""")
def stream_rate_limit(spark, sf):
    return live.drain(live.rate_limited_stream(shuffled(spark, sf), "event_type", 1_800_000, DELAY), "rate-limit")


@query("stream_sampling", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn % 10 = 1")
def stream_sampling(spark, sf):
    return live.drain(live.sampled_stream(shuffled(spark, sf), "user_id", 10, DELAY), "sampling")


@query("stream_consent", """
WITH e AS (SELECT user_id AS package, event_id, event_type AS api, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
SELECT package, event_id, api, CASE WHEN api = 'signup' THEN 'gate' WHEN g > 0 THEN 'after' ELSE 'before' END AS phase, least(g, 5)::INT AS gates FROM e""")
def stream_consent(spark, sf):
    calls = shuffled(spark, sf).select(F.col("user_id").alias("package"), "ts", "event_id", F.col("event_type").alias("api"))
    return live.drain(live.consent_stream(calls, "signup", delay=DELAY), "consent")


@query("stream_tokens", """
WITH w AS (SELECT conv_id, unnest(regexp_extract_all(text, '[a-zA-Z]{8,}')) AS token, turn FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, token, min(turn) AS t0 FROM w GROUP BY 1, 2)
SELECT a.conv_id AS package, a.turn AS seq, token FROM conversations a JOIN c ON a.conv_id = c.conv_id AND a.turn >= t0 AND contains(a.text, token) WHERE a.role = 'assistant'""")
def stream_tokens(spark, sf):
    """Turns arrive up to three minutes after their time, one second per turn; the delay covers the longest conversation."""
    t = table(spark, sf, "conversations").where("role in ('user', 'assistant')").withColumn("ts", F.timestamp_seconds(F.col("turn") + 1_700_000_000))
    late = F.unix_micros("ts") + F.pmod(F.xxhash64("conv_id", "turn"), F.lit(180)) * 1_000_000
    longest = t.agg(F.max("turn") - F.min("turn")).first()[0] or 0
    rows = live.replayed(t, late, {"conv_id": -1, "turn": -1}).select(
        F.col("conv_id").alias("package"), "ts", F.col("turn").alias("seq"), F.when(F.col("role") == "user", "in").otherwise("out").alias("role"), "text")
    return live.drain(live.token_stream(rows, "[a-zA-Z]{8,}", f"{longest + 181} seconds"), "tokens")


@query("stream_tls", """
WITH c AS (SELECT event_id, ts, event_type = 'error' AS failed, CASE user_id % 10 WHEN 0 THEN 'a.qq.com' ELSE 'h' || user_id || '.example.com' END AS sni FROM events),
f AS (SELECT sni, min(ts) AS ft FROM c WHERE failed GROUP BY 1)
SELECT c.sni, event_id, contains(c.sni, 'qq.com') OR coalesce(ft < ts, false) AS passthrough FROM c LEFT JOIN f ON c.sni = f.sni""")
def stream_tls(spark, sf):
    sni = F.when(F.col("user_id") % 10 == 0, "a.qq.com").otherwise(F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(".example.com")))
    return live.drain(live.tls_stream(shuffled(spark, sf).select(sni.alias("sni"), "ts", "event_id", (F.col("event_type") == "error").alias("failed")), DELAY), "tls")


@query("stream_running_metrics", """
WITH s AS (SELECT user_id AS run_id, ts, event_id, value, event_type FROM events),
f AS (SELECT *, (row_number() OVER (PARTITION BY run_id, event_type ORDER BY ts, event_id) = 1)::INT AS fresh FROM s)
SELECT run_id, event_id, round(sum(value) OVER w, 2) AS cum_reward, (sum(fresh) OVER w)::BIGINT AS unique_apis, (sum(fresh * (event_type <> 'error')::INT) OVER w)::BIGINT AS unique_activities
FROM f WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def stream_running_metrics(spark, sf):
    e = shuffled(spark, sf).select(F.col("user_id").alias("run_id"), "ts", "event_id", F.col("value").alias("reward"), F.array("event_type").alias("api_list"),
                                 F.when(F.col("event_type") == "error", "unknown").otherwise(F.col("event_type")).alias("activity"))
    return live.drain(live.running_stream(e, DELAY), "running").withColumn("cum_reward", F.round("cum_reward", 2))


# batches by arrival time; a row is late if it is more than an hour older than the newest row of earlier batches
LATE_SQL = """
WITH a AS (SELECT user_id, ts, event_id, epoch_us(ts) + event_id * 7919 % 21600 * 1000000 AS arr FROM events),
b AS (SELECT *, 5 * (arr - min(arr) OVER ()) // (max(arr) OVER () - min(arr) OVER () + 1) AS batch FROM a),
m AS (SELECT batch, max(max(ts)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b GROUP BY batch),
r AS (SELECT b.*, coalesce(ts < seen - INTERVAL 3600 SECOND, false) AS late FROM b JOIN m USING (batch))
"""


def late_tables(spark, sf):
    """On-time and late rows of the shuffled events."""
    out, late = scratch_path(spark, "on-time"), scratch_path(spark, "late")
    src = shuffled(spark, sf).where("event_id >= 0").select("user_id", "ts", "event_id")
    live.write_with_late_table(src, out, late, scratch_path(spark, "late-state"), 3600).awaitTermination()
    return spark.read.schema(src.schema).parquet(out), spark.read.schema(src.schema).parquet(late)


@query("stream_late_rows", LATE_SQL + "SELECT user_id, count(*) FILTER (NOT late) AS n, count(*) FILTER (late) AS late FROM r GROUP BY 1")
def stream_late_rows(spark, sf):
    """Events in five shuffled batches, those beyond the watermark in the side table."""
    good, late = late_tables(spark, sf)
    both = good.select("user_id", F.lit(0).alias("late")).unionAll(late.select("user_id", F.lit(1).alias("late")))
    return both.groupBy("user_id").agg(F.count_if(F.col("late") == 0).alias("n"), F.count_if(F.col("late") == 1).alias("late"))


@query("stream_late_repair", LATE_SQL + """
, w AS (SELECT user_id, date_trunc('day', ts) AS window_start, count(*) FILTER (NOT late) AS before_repair, count(*) AS n, bool_or(late) AS touched FROM r GROUP BY 1, 2)
SELECT user_id, window_start, before_repair, n FROM w WHERE touched""")
def stream_late_repair(spark, sf):
    """Daily counts that late rows touch, as the stream had them and counted again."""
    good, late = late_tables(spark, sf)
    streamed, again = live.repaired_windows(good, late, ["user_id"], "1 day")
    was = streamed.withColumnRenamed("n", "before_repair")
    return (again.join(was, ["user_id", "window_start"], "left")
            .select("user_id", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.coalesce("before_repair", F.lit(0).cast("long")).alias("before_repair"), "n"))
