"""Live operators on hook messages, calls and flows.

Built-in streaming aggregates and joins come first; only rules that depend on the last emitted row, a counter or
a set of captured values keep their own state per key (``ordered``). Late rows beyond the watermark go to a side table.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from privaudit import dictionaries as D
from privaudit.session import scratch_path
from privaudit.streaming import ordered

DEFAULT_DELAY = "10 seconds"


# --- plumbing -------------------------------------------------------------------------------------

def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A table folder as a stream of files; the number of files per micro-batch bounds what a keyed rule holds at once."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over everything available into a table in the shared folder and read it back."""
    spark = stream.sparkSession
    out, state = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    for k, v in ordered.ROCKSDB.items():
        spark.conf.set(k, v)
    q = (stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", state)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def replayed(df: DataFrame, arrival: Column, closing: dict, batches: int = 5, ts: str = "ts") -> DataFrame:
    """``df`` as a stream of ``batches`` micro-batches by arrival time (a long), and a last one that holds one row with the
    values ``closing`` far in the future, which moves the watermark past all others."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "replay")
    timed = df.withColumn("_at", arrival)
    lo, hi, last = timed.agg(F.min("_at"), F.max("_at"), F.max(ts)).first()
    files = max(1, df.rdd.getNumPartitions())
    if lo is not None:
        batch = F.floor((F.col("_at") - lo) * batches / F.lit(hi - lo + 1))
        for b in range(batches):
            timed.where(batch == b).drop("_at").repartition(files).write.mode("append").parquet(path)
    end = (last or dt.datetime(2000, 1, 1)) + dt.timedelta(days=3650)
    spark.createDataFrame([(end, *closing.values())], f"{ts} timestamp, " + ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in closing)).select(
        *[F.col(c) if c == ts or c in closing else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns]).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(path)


def write_by_kind(routed: DataFrame, out: str, checkpoint: str):
    """Append each micro-batch to one folder per kind and stage."""
    def save(batch: DataFrame, batch_id: int) -> None:
        # the batch id is part of the path, so a replayed batch overwrites itself
        batch.write.mode("overwrite").partitionBy("kind", "stage").parquet(f"{out}/batch={batch_id}")
    return routed.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- router ---------------------------------------------------------------------------------------

def route_messages(messages: DataFrame, message: str = "message", stage=None) -> DataFrame:
    """Kind and body of each hook message, in fixed precedence; the payload may be a JSON string.

    Messages of other types and payloads without a known key get no kind and are dropped.
    """
    inner = F.get_json_object(message, "$.payload")
    m = messages.filter(F.get_json_object(message, "$.type") == "send").withColumn("payload", inner)

    def has(key):
        return F.get_json_object("payload", f"$.{key}").isNotNull()

    fs_ok = F.get_json_object("payload", "$.fs.function").isNotNull()
    kind = (F.when((F.get_json_object("payload", "$.category") == "CryptoAPI") | has("crypto"), "crypto")
            .when(has("class") & has("method"), "api").when(has("java"), "java").when(has("native"), "native").when(has("media"), "media")
            .when(has("fs"), F.when(fs_ok, "fs")))
    for k in ("deviceid", "hookerror", "hookstat", "diag"):
        kind = kind.when(has(k), k)
    nested = [F.when(F.col("kind") == k, F.get_json_object("payload", f"$.{k}")) for k in ("java", "native", "media", "fs", "deviceid", "hookerror", "hookstat", "diag")]
    out = m.withColumn("kind", kind).filter("kind is not null").withColumn("body", F.coalesce(*nested, F.col("payload")))
    return out.withColumn("stage", F.lit(1) if stage is None else stage).drop("payload", message)


# --- windows --------------------------------------------------------------------------------------

def api_windows(calls: DataFrame, ts: str = "ts", api: str = "api", keys=("package",), size: str = "1 minute", slide: str | None = None,
                gap: str | None = None, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Distinct APIs per package and tumbling, sliding or session window."""
    w = F.session_window(ts, gap) if gap else F.window(ts, size, slide) if slide else F.window(ts, size)
    out = calls.withWatermark(ts, delay).groupBy(*keys, w.alias("w")).agg(F.array_sort(F.collect_set(api)).alias("apis"), F.count("*").alias("n"))
    return out.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "apis", "n")


def correlate_stream(calls: DataFrame, traffic: DataFrame, before: str = "1 second", after: str = "5 seconds", delay: str = DEFAULT_DELAY) -> DataFrame:
    """Calls joined with traffic of the same package from ``before`` to ``after`` the call.

    ``calls``: package, call_id, ts; ``traffic``: package, seq, ts. Both sides are watermarked, so old state is dropped.
    """
    c = calls.withWatermark("ts", delay)
    t = traffic.select(F.col("package").alias("t_package"), "seq", F.col("ts").alias("t_ts")).withWatermark("t_ts", delay)
    near = (F.col("package") == F.col("t_package")) & (F.col("t_ts") >= F.col("ts") - F.expr(f"interval {before}")) & (F.col("t_ts") <= F.col("ts") + F.expr(f"interval {after}"))
    return c.join(t, near).select("package", "call_id", "ts", "seq", "t_ts")


# --- keyed state ----------------------------------------------------------------------------------

def rate_limited_stream(df: DataFrame, key: str, window_ms: int = 1500, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Rows at least ``window_ms`` after the last emitted row of their key; ``df``: key, ts, event_id."""
    return ordered.ordered(df, ordered.RateLimit(window_ms), key, [], "", delay)


def sampled_stream(df: DataFrame, key: str, mod: int, delay: str = DEFAULT_DELAY) -> DataFrame:
    """First, N+1st, … row of each key; ``df``: key, ts, event_id."""
    return ordered.ordered(df, ordered.Sample(mod), key, [], "", delay)


def consent_stream(df: DataFrame, consent: str, max_gates: int = 5, delay: str = DEFAULT_DELAY) -> DataFrame:
    """APIs with the phase they were called in; a package counts up to ``max_gates`` consent clicks.

    ``df``: package, ts, event_id, api.
    """
    return ordered.ordered(df.withColumnRenamed("api", "called"), ordered.Consent(consent, max_gates), "package", ["called"], "api string, phase string, gates int", delay)


def token_stream(df: DataFrame, pattern: str, delay: str = DEFAULT_DELAY, keep_ms: int | None = None) -> DataFrame:
    """Captured values that show up in the same or a later outbound text of the package.

    ``df``: package, ts, seq, role ('in' captures, 'out' is searched), text. The state of a package is the set of its
    captured values, each kept for ``keep_ms`` if given.
    """
    return ordered.ordered(df, ordered.Tokens(pattern, keep_ms), "package", ["role", "text"], "token string", delay, tie="seq")


def tls_stream(df: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Connections to hosts that are whitelisted or failed a handshake before; ``df``: sni, ts, event_id, failed."""
    return ordered.ordered(df, ordered.Passthrough(tuple(D.TLS_PASSTHROUGH_HOSTS)), "sni", ["failed"], "passthrough boolean", delay)


def running_stream(df: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Cumulative reward and distinct APIs and activities per run; ``df``: run_id, ts, event_id, reward, api_list, activity."""
    return ordered.ordered(df, ordered.Running(), "run_id", ["reward", "api_list", "activity"], "cum_reward double, unique_apis long, unique_activities long", delay)


# --- late data ------------------------------------------------------------------------------------

def split_late(batch: DataFrame, seen_until, delay_s: float, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Rows of a micro-batch inside and beyond the watermark ``seen_until - delay``."""
    if seen_until is None:
        return batch, batch.limit(0)
    edge = F.lit(seen_until) - F.expr(f"interval {delay_s} seconds")
    late = F.coalesce(F.col(ts) < edge, F.lit(False))
    return batch.filter(~late), batch.filter(late)


def write_with_late_table(stream: DataFrame, out: str, late_out: str, checkpoint: str, delay_s: float = 10, ts: str = "ts"):
    """On-time rows to ``out``, late rows to a side table that ``repaired_windows`` picks up.

    The largest time seen is a state row of its own per batch (below ``checkpoint``), so a batch reads one row of the batch
    before it, a repeated batch finds what it found the first time, and no output is read again.
    """
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = spark.read.schema("seen timestamp").parquet(f"{checkpoint}-seen/batch={batch_id - 1}").first()[0] if batch_id > 0 else None
        batch = batch.persist()
        newest = batch.agg(F.max(ts)).first()[0]
        known = max((t for t in (seen, newest) if t is not None), default=None)
        spark.createDataFrame([(known,)], "seen timestamp").coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}-seen/batch={batch_id}")
        good, late = split_late(batch, seen, delay_s, ts)
        good.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        late.write.mode("overwrite").parquet(f"{late_out}/batch={batch_id}")
        batch.unpersist()
    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def repaired_windows(on_time: DataFrame, late: DataFrame, keys: list[str], size: str, ts: str = "ts") -> tuple[DataFrame, DataFrame]:
    """Window counts (keys, window_start, n) as the stream has them without late rows, and those of the windows that late
    rows touch, counted again from the rows of these windows only."""
    def placed(df):
        return df.select(*keys, F.window(ts, size)["start"].alias("window_start"))

    touched = placed(late).distinct()
    again = placed(on_time).join(touched, [*keys, "window_start"], "left_semi").unionAll(placed(late))
    count = [F.count("*").alias("n")]
    return placed(on_time).groupBy(*keys, "window_start").agg(*count), again.groupBy(*keys, "window_start").agg(*count)
