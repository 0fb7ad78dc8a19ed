"""Correlation of API calls with traffic and leaks in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.operators.scans import HOT_ROWS, window_ranks


def _side(calls: DataFrame, other: DataFrame, name: str, before_s: float, after_s: float, first_n: int | None, hot_rows: int) -> DataFrame:
    """Per call: number of rows of the other side in its window, and the first few of them."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    ranges, ranked = window_ranks(calls, other, ["package"], "call_id", micros, micros, "seq",
                                  int(before_s * 1_000_000), int(after_s * 1_000_000), hot_rows)
    ranges = ranges.withColumn(f"n_{name}", F.col("hi") - F.col("lo")).filter(f"n_{name} > 0")
    wanted = ranges.select("package", "call_id", F.explode(
        F.sequence(F.col("lo") + 1, F.col("hi") if first_n is None else F.least(F.col("hi"), F.col("lo") + first_n))).alias("rank"))
    listed = (wanted.join(ranked, ["package", "rank"]).groupBy("package", "call_id")
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "match"))), lambda r: r["match"]).alias(f"related_{name}")))
    return ranges.select("package", "call_id", f"n_{name}").join(listed, ["package", "call_id"])


def correlate(calls: DataFrame, traffic: DataFrame, leaks: DataFrame, before_s: float = 1, after_s: float = 5,
              first_n: int | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Calls with traffic or leaks between ``before_s`` before and ``after_s`` after them.

    ``calls``: package, call_id, ts, …; the other sides: package, seq, ts, …. Counts cover the whole window, the
    related lists all of it or its first ``first_n`` rows. A score needs the whole lists.
    """
    c = calls.filter("ts is not null")
    slim = c.select("package", "call_id", "ts")
    t = _side(slim, traffic.filter("ts is not null"), "traffic", before_s, after_s, first_n, hot_rows)
    lk = _side(slim, leaks.filter("ts is not null"), "leaks", before_s, after_s, first_n, hot_rows)
    found = t.join(lk, ["package", "call_id"], "full")
    zero = {"n_traffic": 0, "n_leaks": 0}
    return c.join(found, ["package", "call_id"]).fillna(zero)


def third_party_targets(correlated: DataFrame, host_sdk: DataFrame, first_n: int | None = None) -> DataFrame:
    """Third-party targets, all or the first ``first_n``, among the related traffic of each call."""
    hosts = correlated.select("package", "call_id", F.posexplode("related_traffic").alias("pos", "t")) \
        .select("package", "call_id", "pos", F.col("t.host").alias("host"))
    hit = hosts.join(host_sdk, "host").groupBy("package", "call_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", "host", "sdk_name"))).alias("_s"))
    hit = hit if first_n is None else hit.withColumn("_s", F.slice("_s", 1, first_n))
    return hit.select("package", "call_id", F.transform("_s", lambda s: F.struct(s["host"], s["sdk_name"])).alias("traffic_sdks"))


def correlation_score(return_value, sdk_name, is_third_party, traffic, leaks):
    """10 per traffic row, 20 per leak, 50 when the return value shows in a leak, 30 when the SDK names a host."""
    rv = F.coalesce(return_value, F.lit(""))
    none_t, none_l = F.coalesce(F.size(traffic), F.lit(0)), F.coalesce(F.size(leaks), F.lit(0))
    n_t, n_l = F.greatest(none_t, F.lit(0)), F.greatest(none_l, F.lit(0))
    shown = (F.length(rv) > 5) & F.coalesce(F.exists(leaks, lambda x: x["value_preview"].contains(rv)), F.lit(False))
    named = is_third_party & F.coalesce(F.exists(traffic, lambda x: F.lower(x["host"]).contains(F.lower(sdk_name))), F.lit(False))
    return (n_t * 10 + n_l * 20 + F.when(shown, 50).otherwise(0) + F.when(named, 30).otherwise(0)).cast("int")
