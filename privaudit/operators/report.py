"""Readable reports assembled from roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.operators.fleet import top_per_package
from privaudit.operators.leaks import leak_totals, leaks_by_source


def report_totals(leaks: DataFrame, entity_calls: DataFrame) -> DataFrame:
    """Headline numbers of each package: API calls by owner, network leaks by source, local leaks."""
    api = entity_calls.groupBy("package").agg(
        F.sum("total_count").alias("api_total"), F.sum(F.when(F.col("entity_type") == "App-Owned", F.col("total_count")).otherwise(0)).alias("api_own"))
    src = leaks_by_source(leaks).filter("source_key is null and source_class is not null")

    def n(cls):
        return F.sum(F.when(F.col("source_class") == cls, F.col("n")).otherwise(0)).alias(f"n_{cls}")

    s = src.groupBy("package").agg(*[n(c) for c in ("app_self", "third_party", "unknown", "local_file")])
    j = leak_totals(leaks).join(s, "package", "left").join(api, "package", "full")
    zero = [c for c in j.columns if c != "package"]
    return (j.fillna(0, zero).withColumn("api_third", F.col("api_total") - F.col("api_own"))
            .withColumn("network_leaks", F.col("n_app_self") + F.col("n_third_party") + F.col("n_unknown")))


def top_sources(leaks: DataFrame, n: int = 10) -> DataFrame:
    """Largest source keys of every class per package."""
    src = leaks_by_source(leaks).filter("source_key is not null")
    from pyspark.sql import Window as W
    w = W.partitionBy("package", "source_class").orderBy(F.desc("n"), "source_key")
    return src.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).drop("level")


def top_fields(leaks: DataFrame, n: int = 10) -> DataFrame:
    return top_per_package(leaks.groupBy("package", "privacy_field").agg(F.count("*").alias("n")), "privacy_field", n)


def text_report(totals: DataFrame, sources: DataFrame) -> DataFrame:
    """One text per package from the totals and the top sources (both bounded per package)."""
    lines = F.array_sort(F.collect_list(F.struct("source_class", "rank", F.concat(
        F.lit("  "), F.col("source_class"), F.lit(" "), F.col("source_key"), F.lit(": "), F.col("n").cast("string")).alias("line"))))
    s = sources.groupBy("package").agg(lines.alias("_l")).select("package", F.array_join(F.transform("_l", lambda x: x["line"]), "\n").alias("_src"))

    def num(c):
        return F.col(c).cast("string")

    head = F.concat_ws("\n", F.concat(F.lit("package: "), F.col("package").cast("string")),
                       F.concat(F.lit("api calls: "), num("api_total"), F.lit(" (own "), num("api_own"), F.lit(", third party "), num("api_third"), F.lit(")")),
                       F.concat(F.lit("network leaks: "), num("network_leaks"), F.lit(", local leaks: "), num("n_local_file")),
                       F.concat(F.lit("encrypted: "), num("encrypted_count"), F.lit(", plaintext: "), num("plaintext_count")), F.lit("sources:"))
    return totals.join(s, "package", "left").select("package", F.concat_ws("\n", head, "_src").alias("report"))
