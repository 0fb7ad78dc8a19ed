"""Fleet-level roll-ups: evidence metrics, ablations, strategies, coverage and app scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from privaudit.functions.scalars import activity_name, blank, permission_level
from privaudit.operators.leaks import record_flags


def evidence_metrics(leaks: DataFrame, approximate: bool = False) -> DataFrame:
    """Counters and distinct counts over the records of each package.

    Records are counted per category, field and host first, so the exact distinct counts expand that table and not the
    records.
    """
    distinct = F.approx_count_distinct if approximate else F.countDistinct
    r = record_flags(leaks)

    def named(c, cond=None):
        v = F.when(~blank(c), F.trim(c))
        return v if cond is None else F.when(cond, v)

    enc = F.lower(F.trim(F.coalesce("encode_type", F.lit(""))))
    counters = {"total_records": F.lit(True), "network_records": F.col("is_network"), "file_records": F.col("is_file"), "crypt_records": F.col("is_crypt"),
                "encrypted_records": F.coalesce("encrypted", F.lit(False)), "plaintext_records": ~F.coalesce("encrypted", F.lit(False)), "third_party_records": F.col("is_third"),
                "_located": F.col("is_network") & F.col("has_meta"), "decoded_records": (enc != "") & (enc != "normal")}
    few = r.groupBy("package", named("category_level1").alias("_c"), named("privacy_field").alias("_f"), named("host", F.col("is_network")).alias("_h"), named("host", F.col("is_file")).alias("_p")).agg(
        *[F.count_if(c).alias(n) for n, c in counters.items()])
    out = few.groupBy("package").agg(*[F.sum(n).alias(n) for n in counters], distinct("_c").alias("n_categories"), distinct("_f").alias("n_fields"), distinct("_h").alias("n_hosts"), distinct("_p").alias("n_file_paths"))
    ratio = F.when(F.col("network_records") > 0, F.col("_located") / F.col("network_records")).otherwise(0.0)
    return out.withColumn("meta_ratio", F.round(ratio, 4)).drop("_located")


def component_ablation(metrics: DataFrame) -> DataFrame:
    """Records left when a component is switched off, or when only it is on."""
    return metrics.select("package", F.col("total_records").alias("all_records"), (F.col("total_records") - F.col("crypt_records")).alias("no_crypt"),
                          (F.col("total_records") - F.col("file_records")).alias("no_file"), F.col("plaintext_records").alias("plaintext_only"),
                          F.col("network_records").alias("network_only"), F.col("crypt_records").alias("crypt_only"), F.col("encrypted_records").alias("encrypted_only"))


def category_breadth(leaks: DataFrame, runs: DataFrame) -> DataFrame:
    """Major and minor categories per app and configuration; runs without a report stay NULL.

    ``leaks``: app, config, category, field; ``runs``: app, config.
    """
    b = leaks.groupBy("app", "config").agg(F.countDistinct("category").alias("major"), F.countDistinct("category", "field").alias("minor"))
    return runs.select("app", "config").join(b, ["app", "config"], "left")


def strategy_metrics(apps: DataFrame) -> DataFrame:
    """Totals, averages and per-100-step rates per strategy; ``apps``: strategy, package, calls, cats, steps."""
    s = apps.groupBy("strategy").agg(F.count("*").alias("apps"), F.sum("calls").alias("total_calls"), F.sum("cats").alias("total_cats"), F.max("steps").alias("steps"))
    ac, ag = F.col("total_calls") / F.col("apps"), F.col("total_cats") / F.col("apps")
    return s.select("strategy", "apps", "total_calls", "total_cats", F.round(ac, 2).alias("avg_calls"), F.round(ag, 2).alias("avg_cats"),
                    F.round(ac / F.col("steps") * 100, 4).alias("calls_per_100_steps"), F.round(ag / F.col("steps") * 100, 4).alias("cats_per_100_steps"), "steps")


def strategy_comparison(apps: DataFrame, strategies: list[str], a: str | None = None, b: str | None = None) -> DataFrame:
    """One row per package with the metrics of every strategy, zero where it has none."""
    p = apps.withColumn("calls_per_step", F.round(F.col("calls") / F.col("steps"), 4)).withColumn("cats_per_100", F.round(F.col("cats") / F.col("steps") * 100, 4))
    aggs = [F.coalesce(F.max(F.when(F.col("strategy") == s, F.col(m))), F.lit(0)).alias(f"{s}_{m}")
            for s in strategies for m in ("calls", "cats", "calls_per_step", "cats_per_100")]
    out = p.groupBy("package").agg(*aggs)
    if a and b:
        out = out.withColumn("calls_diff", F.col(f"{a}_calls") - F.col(f"{b}_calls"))
    return out


def ordered_comparison(comparison: DataFrame, strategies: list[str]) -> DataFrame:
    """Comparison table, most calls first, strategy by strategy."""
    return comparison.orderBy(*[F.desc(f"{s}_calls") for s in strategies], "package")


def activity_coverage(visited: DataFrame, declared: DataFrame) -> DataFrame:
    """Share of declared activities that were visited; ``visited``/``declared``: package, activity."""
    v = visited.select("package", activity_name("activity", "package").alias("activity")).filter(~blank("activity")).distinct().withColumn("seen", F.lit(1))
    d = declared.select("package", activity_name("activity", "package").alias("activity")).filter(~blank("activity")).distinct()
    return d.join(v, ["package", "activity"], "left").groupBy("package").agg(
        F.count("*").alias("declared"), F.count("seen").alias("visited"), F.avg(F.coalesce("seen", F.lit(0))).alias("coverage"))


def behaviour_score(apps: DataFrame) -> DataFrame:
    """100 minus 2 per dangerous permission and 5 per sensitive API; the level uses the unfloored value.

    ``apps``: package, permissions, sensitive_apis (arrays).
    """
    n_danger = F.size(F.filter("permissions", lambda p: permission_level(p) == "dangerous"))
    raw = F.lit(100) - n_danger * 2 - F.size("sensitive_apis") * 5
    return apps.select("package", n_danger.alias("n_dangerous"), F.size("sensitive_apis").alias("n_apis"), F.greatest(raw, F.lit(0)).alias("score"),
                       F.when(raw < 60, "high").when(raw < 85, "medium").otherwise("low").alias("risk_level"))


def batch_summary(leaks: DataFrame, calls: DataFrame) -> DataFrame:
    """Leaks and calls per app, with a fleet total (``package`` NULL)."""
    a = leaks.groupBy("package").agg(F.count("*").alias("leaks")).withColumn("calls", F.lit(0).cast("long"))
    b = calls.groupBy("package").agg(F.count("*").alias("calls")).withColumn("leaks", F.lit(0).cast("long"))
    return a.unionByName(b).rollup("package").agg(F.sum("leaks").alias("leaks"), F.sum("calls").alias("calls"))


def run_status(runs: DataFrame) -> DataFrame:
    """Runs per status and reason."""
    return runs.groupBy("status", "reason").agg(F.count("*").alias("n"))


def static_facts(info: DataFrame, hooks: DataFrame) -> DataFrame:
    """Permissions and hook list of each app, whichever exists; ``info``: app_name, package, permissions; ``hooks``: app_name, api."""
    h = hooks.groupBy("app_name").agg(F.array_sort(F.collect_set("api")).alias("static_apis"))
    none = F.array().cast("array<string>")
    short = F.transform("permissions", lambda p: F.element_at(F.split(p, r"\."), -1))
    return info.withColumn("permissions", short).join(h, "app_name", "full").select(
        "app_name", F.coalesce("package", "app_name").alias("package"), F.coalesce("permissions", none).alias("permissions"),
        F.coalesce("static_apis", none).alias("static_apis"), F.lit(True).alias("from_cache"))


def merge_app_results(static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Static and dynamic facts per app; the static package name wins."""
    none = F.array().cast("array<string>")
    d = dynamic.select("app_name", F.col("package").alias("_p"), "sensitive_apis")
    return static.join(d, "app_name", "full").select(
        "app_name", F.coalesce(F.nullif("package", F.lit("")), "_p").alias("package"), F.coalesce("permissions", none).alias("permissions"),
        F.coalesce("static_apis", none).alias("static_apis"), F.coalesce("sensitive_apis", none).alias("sensitive_apis"))


def find_reports(apps: DataFrame, reports: DataFrame) -> DataFrame:
    """Report of each app under its package name, else under its app name; ``reports``: name, report_id."""
    names = F.array("package", "app_name")
    cand = apps.select("app_id", F.posexplode(names).alias("rank", "name")).filter(~blank("name") & ~F.col("name").isin("unknown", "error"))
    return cand.join(reports, "name").groupBy("app_id").agg(F.min_by(F.struct("name", "report_id"), F.struct("rank", "report_id")).alias("b")) \
        .select("app_id", "b.name", "b.report_id")


def runtime_evidence(apps: DataFrame, reports: DataFrame, summaries: DataFrame, calls: DataFrame) -> DataFrame:
    """Report of each app with the API summary that lies beside it, if any, and the distinct APIs the app triggered.

    ``apps``, ``reports``: as in :func:`find_reports`; ``summaries``: report_id and its facts; ``calls``: app_id, api.
    The list of an app is bounded by the monitored APIs.
    """
    seen = calls.filter(~blank("api")).select("app_id", "api").distinct().groupBy("app_id").agg(F.array_sort(F.collect_list("api")).alias("triggered_apis"))
    found = find_reports(apps, reports).join(summaries, "report_id", "left")
    return apps.select("app_id").distinct().join(found, "app_id", "left").join(seen, "app_id", "left") \
        .withColumn("triggered_apis", F.coalesce("triggered_apis", F.array().cast("array<string>")))


def top_per_package(counts: DataFrame, key: str, n: int = 10, count: str = "n") -> DataFrame:
    """The ``n`` largest counts of every package, ties by key."""
    w = W.partitionBy("package").orderBy(F.desc(count), key)
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
