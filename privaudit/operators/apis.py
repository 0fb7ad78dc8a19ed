"""API calls: rule matching, retention, caller attribution and roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit import dictionaries as D
from privaudit.functions.scalars import any_contains, caller_class, keeps_api_call
from privaudit.operators.leaks import caller_sdk


def api_rules(entries: DataFrame) -> DataFrame:
    """Raw rule entries (with ``ord``) to rules; rules with a note, or on the content resolver, are conditional."""
    method = F.coalesce(F.nullif(F.col("method"), F.lit("")), F.col("field"))
    return (entries.select("ord", "class", method.alias("method"), F.coalesce("type", F.lit("未知")).alias("privacy_type"),
                           F.coalesce("category", F.lit("")).alias("category"), F.coalesce("note", F.lit("")).alias("note"))
            .filter("class <> '' and method <> ''")
            .withColumn("conditional", (F.col("note") != "") | (F.col("class") == D.CONTENT_RESOLVER)))


def uri_kind(uri):
    """Kind of sensitive content URI, NULL for noise and unknown URIs."""
    u = F.lower(uri)
    u = F.coalesce(F.try_url_decode(u), u)
    kinds = [F.when(any_contains(u, pats), F.lit("访问" + kind)) for kind, pats in D.SENSITIVE_URIS.items()]
    return F.when(any_contains(u, D.URI_NOISE), F.lit(None)).otherwise(F.coalesce(*kinds))


def match_api(calls: DataFrame, rules: DataFrame) -> DataFrame:
    """Calls that match a rule, with its privacy type.

    Rules are grouped to one row per method first, so the join never multiplies calls.
    """
    kw = F.when(F.col("note").contains("="), F.lower(F.element_at(F.split("note", "="), -1))).otherwise("")
    per = rules.groupBy("class", "method").agg(
        F.array_sort(F.collect_list(F.when(F.col("conditional"), F.struct("ord", kw.alias("kw"), "privacy_type", "note")))).alias("_cond"),
        F.max_by(F.struct("privacy_type", "note"), F.when(~F.col("conditional"), F.col("ord"))).alias("_simple"))
    j = calls.join(per, ["class", "method"], "left")
    args = F.coalesce(F.col("args"), F.array().cast("array<string>"))
    hit = F.try_element_at(F.filter("_cond", lambda r: (r["kw"] == "") | F.exists(args, lambda a: F.lower(a).contains(r["kw"]))), F.lit(1))
    is_uri = (F.col("class") == D.CONTENT_RESOLVER) & (F.size(args) > 0)
    ptype = F.when(is_uri, uri_kind(F.try_element_at(args, F.lit(1)))).otherwise(
        F.coalesce(hit["privacy_type"], F.col("_simple.privacy_type")))
    return j.withColumn("privacy_type", ptype).filter("privacy_type is not null").drop("_cond", "_simple")


def privacy_calls(calls: DataFrame, rules: DataFrame, sdk: DataFrame) -> DataFrame:
    """Matched, retained and attributed calls."""
    m = match_api(calls, rules).filter(keeps_api_call("method", "return_value", "args"))
    m = m.withColumn("caller", caller_class("called_from"))
    own = caller_sdk(m, sdk, "caller")
    joined = m.join(own.withColumnRenamed("caller", "_c"), F.col("caller").eqNullSafe(F.col("_c")), "left").drop("_c")
    return joined.withColumn("api", F.concat_ws(".", "class", "method"))


def with_categories(calls: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One row per call and parent category of its privacy type."""
    tx = taxonomy.select(F.col("child").alias("privacy_type"), F.col("parent").alias("category")).distinct()
    return calls.drop("category").join(tx, "privacy_type", "left").withColumn("category", F.coalesce("category", F.lit(D.DEFAULT_LEVEL1)))


def calls_by_category(calls: DataFrame) -> DataFrame:
    """Counts per category, per (category, type) and per (category, api) in one pass."""
    cols = ["package", "category", "privacy_type", "api"]
    sets = [["package", "category"], ["package", "category", "privacy_type"], ["package", "category", "api"]]
    return calls.groupingSets(sets, *cols).agg(F.count("*").alias("n")).select(*cols, "n")


def category_counts(calls: DataFrame) -> DataFrame:
    """Number of calls and categories per package; a call in two categories is counted once."""
    return calls.groupBy("package").agg(F.countDistinct("call_id").alias("total_calls"),
                                        F.countDistinct("category").alias("category_count"))


def calls_by_entity(calls: DataFrame) -> DataFrame:
    """Counts per entity and category with the types inside; the app itself sorts first."""
    third = F.col("is_third_party")
    per = (calls.groupBy("package", F.when(third, "Third-Party").otherwise("App-Owned").alias("entity_type"),
                         F.when(third, F.col("sdk_name")).otherwise(F.col("package").cast("string")).alias("entity_name"),
                         "category", "privacy_type").agg(F.count("*").alias("n")))
    # bounded by the taxonomy: one entry per type of a category
    return (per.groupBy("package", "entity_type", "entity_name", "category")
            .agg(F.sum("n").alias("total_count"),
                 F.array_sort(F.collect_list(F.struct("privacy_type", "n"))).alias("privacy_types")))


def describe_apis(apis: DataFrame, descriptions: DataFrame, api: str = "api") -> DataFrame:
    """Description per API: exact key, else the first key that contains both class and method.

    ``descriptions``: ord, key, description. The fallback joins on the method words of the keys.
    """
    a = apis.select(api).distinct()
    cls = F.regexp_replace(F.col(api), r"\.[^.]*$", "")
    fn = F.element_at(F.split(api, r"\."), -1)
    d = descriptions.select("ord", F.col("key").alias("_key"), "description")
    exact = a.join(d, F.col(api) == F.col("_key"), "left").groupBy(api).agg(F.min_by("description", "ord").alias("_exact"))
    left = exact.filter("_exact is null").withColumn("_cls", cls).withColumn("_fn", fn)
    from privaudit.operators.joins import substring_pairs
    pairs = substring_pairs(d, "_key", left, "_cls")
    loose = (pairs.join(d, "_key").join(left.select(api, "_cls", "_fn"), "_cls").filter(F.contains("_key", "_fn"))
             .groupBy(api).agg(F.min_by("description", "ord").alias("_loose")))
    return exact.join(loose, api, "left").select(api, F.coalesce("_exact", "_loose").alias("description"))
