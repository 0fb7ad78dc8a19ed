"""Integrated view of network leaks and API calls per information type, host and SDK."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit import dictionaries as D
from privaudit.functions.scalars import any_of, blank
from privaudit.operators.joins import first_match, substring_pairs


def top_category(types: DataFrame, mapping: DataFrame, col: str = "privacy_type") -> DataFrame:
    """Top category per distinct type: exact, else the first key that contains it or is contained in it.

    ``mapping``: ord, key, value.
    """
    t = types.select(col).distinct()
    m = mapping.select("ord", F.col("key").alias("_key"), "value", F.lower("key").alias("_lk"))
    exact = t.join(m, F.col(col) == F.col("_key"), "left").groupBy(col).agg(F.max_by("value", "ord").alias("_exact"))
    rest = exact.filter("_exact is null").withColumn("_lt", F.lower(col))
    near = first_match(substring_pairs(rest, "_lt", m, "_lk", both_ways=True).join(m, "_lk"), ["_lt"], ["value"], ["ord"])
    loose = rest.join(near, "_lt").select(col, F.col("value").alias("_loose"))
    return exact.join(loose, col, "left").select(col, F.coalesce("_exact", "_loose", F.lit(D.DEFAULT_LEVEL1)).alias("top_category"))


def facts(leaks: DataFrame, calls: DataFrame) -> DataFrame:
    """Network and API rows in one table with a ``kind`` column."""
    net = leaks.select("package", "privacy_type", F.lit("net").alias("kind"), "outbound", "encrypted", "host", "source",
                       F.lit(None).cast("string").alias("sdk_name"), F.lit(None).cast("string").alias("api"))
    api = calls.select("package", "privacy_type", F.lit("api").alias("kind"), F.lit(None).cast("boolean").alias("outbound"),
                       F.lit(None).cast("boolean").alias("encrypted"), F.lit(None).cast("string").alias("host"),
                       F.lit(None).cast("string").alias("source"), "sdk_name", "api")
    return net.unionByName(api)


def _net(cond=None):
    is_net = F.col("kind") == "net"
    return F.count_if(is_net if cond is None else is_net & cond)


def by_info_type(f: DataFrame) -> DataFrame:
    return f.groupBy("package", "privacy_type").agg(
        F.count_if(F.col("kind") == "api").alias("api_access"), _net(F.col("outbound")).alias("outbound"),
        _net(~F.col("outbound")).alias("inbound"), _net(F.col("encrypted")).alias("encrypted"),
        _net(~F.col("encrypted")).alias("plaintext"), F.countDistinct("host").alias("target_hosts"),
        F.countDistinct("sdk_name").alias("sdks"))


def by_host(f: DataFrame) -> DataFrame:
    return f.filter((F.col("kind") == "net") & ~blank("host")).groupBy("package", "host").agg(
        F.count_if("outbound").alias("outbound"), F.count_if(~F.col("outbound")).alias("inbound"),
        F.countDistinct("privacy_type").alias("privacy_types"), F.count_if("encrypted").alias("encrypted"),
        F.count_if(~F.col("encrypted")).alias("plaintext"))


def by_sdk(f: DataFrame) -> DataFrame:
    return f.filter("kind = 'api'").groupBy("package", "sdk_name").agg(
        F.count("*").alias("api_calls"), F.countDistinct("privacy_type").alias("privacy_types"),
        F.countDistinct("api").alias("apis_used"))


def totals(info: DataFrame) -> DataFrame:
    """Totals per package over the per-type table."""
    return info.groupBy("package").agg(
        F.count("*").alias("total_info_types"), F.sum("api_access").alias("api_access_count"),
        F.sum(F.col("outbound") + F.col("inbound")).alias("network_leak_count"), F.sum("outbound").alias("outbound_count"),
        F.sum("inbound").alias("inbound_count"), F.sum("encrypted").alias("encrypted_count"),
        F.sum("plaintext").alias("plaintext_count"))


def risk_level(privacy_type, outbound, plaintext):
    """Level from keywords, raised once when the type leaves the device in plain text."""
    t = F.lower(privacy_type)
    base = F.when(t.rlike(any_of(D.HIGH_RISK_WORDS)), 0).when(t.rlike(any_of(D.MEDIUM_RISK_WORDS)), 1).otherwise(2)
    rank = F.when((outbound > 0) & (plaintext > 0), F.greatest(base - 1, F.lit(0))).otherwise(base)
    return F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low")), rank + 1)


def risk_items(info: DataFrame) -> DataFrame:
    """Types that were accessed or sent, with their risk level."""
    return (info.filter("outbound > 0 or api_access > 0")
            .withColumn("risk_level", risk_level(F.col("privacy_type"), F.col("outbound"), F.col("plaintext"))))


def ranked_risk(items: DataFrame) -> DataFrame:
    """Report order: level, then most outbound records."""
    rank = F.when(F.col("risk_level") == "high", 0).when(F.col("risk_level") == "medium", 1).otherwise(2)
    return items.orderBy(rank, F.desc("outbound"), "package", "privacy_type")
