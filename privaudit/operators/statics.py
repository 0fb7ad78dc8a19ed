"""Static app facts: exported components, method screening, TLS pass-through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privaudit import dictionaries as D
from privaudit.functions.scalars import any_of, blank

# fixed values: type letters of a method descriptor
DESCRIPTOR_TYPES = {"V": "void", "Z": "boolean", "B": "byte", "S": "short", "C": "char", "I": "int", "J": "long",
                    "F": "float", "D": "double"}
COVERAGE_ACTIONS = ["edu.gatech.m3.emma.COLLECT_COVERAGE", "END_COVERAGE", "END_EMMA"]


def _type_name(t: Column) -> Column:
    base = F.regexp_replace(t, r"^\[+", "")
    dims = F.length(t) - F.length(base)
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in DESCRIPTOR_TYPES.items() for x in kv]), base),
                       F.replace(F.regexp_replace(base, "^L|;$", ""), F.lit("/"), F.lit(".")))
    return F.concat(named, F.repeat(F.lit("[]"), dims))


def descriptor(c) -> Column:
    """``(Landroid/content/Context;I)Z`` to ``struct(params, returns)``."""
    d = F.trim(F.col(c))
    inside = F.regexp_extract(d, r"^\(([^)]*)\)(.*)$", 1)
    ret = F.regexp_extract(d, r"^\(([^)]*)\)(.*)$", 2)
    toks = F.regexp_extract_all(inside, F.lit(r"(\[*L[^;]+;|\[*[ZBSCIJFDV])"), F.lit(1))
    return F.struct(F.transform(toks, _type_name).alias("params"), F.when(ret != "", _type_name(ret)).otherwise("void").alias("returns"))


def suspicious_methods(methods: DataFrame) -> DataFrame:
    """Methods worth hooking: root checks, crypto and script bridges; ``methods``: package, class, method, descriptor."""
    m = methods.withColumn("_d", descriptor("descriptor")).withColumn("_m", F.lower("method"))
    plain = ~F.col("method").endswith("-impl") & ~F.col("class").contains("$") & ~F.col("method").contains("$") & (F.col("method") != "")
    texty = F.exists("_d.params", lambda p: p.contains("String") | p.contains("byte")) | F.col("_d.returns").contains("String") | F.col("_d.returns").contains("byte")
    root = F.col("_m").contains("root") & (F.col("_d.returns") == "boolean") & ~F.col("class").rlike("google|kotlin|androidx|support")
    crypto = F.col("_m").rlike("encrypt|decrypt") & (F.size("_d.params") >= 1) & texty
    tags = F.array_compact(F.array(F.when(root, "Root Detection"), F.when(crypto, "Crypto"), F.when(F.col("method") == "addJavascriptInterface", "WebView Risk")))
    return m.filter(plain).select("package", "class", "method", F.explode(tags).alias("category"))


def exported_components(components: DataFrame, actions: DataFrame, permissions: DataFrame) -> DataFrame:
    """Components other apps can reach.

    Exported, or not stated but with an intent action; and without a permission or with a normal or dangerous one.
    ``components``: package, name, type, exported, permission; ``actions``: package, name, action;
    ``permissions``: permission, level.
    """
    real = actions.filter(~F.col("action").rlike(any_of(COVERAGE_ACTIONS)))
    acts = real.groupBy("package", "name").agg(F.array_sort(F.collect_set("action")).alias("actions"))
    lv = permissions.select("permission", F.lower("level").alias("_level"), F.lit(True).alias("_known"))
    j = components.filter(~blank("name")).join(acts, ["package", "name"], "left").join(lv, "permission", "left")
    exported = F.lower(F.coalesce("exported", F.lit("")))
    reach = (exported == "true") | ((exported == "") & F.col("actions").isNotNull())
    open_ = blank("permission") | (F.coalesce("_known", F.lit(False)) & (F.col("_level").isNull() | F.col("_level").isin("", "none", "normal", "dangerous", "0x0", "0x1", "0", "1")))
    return j.filter(reach & open_).select("package", "type", "name", F.coalesce("actions", F.array().cast("array<string>")).alias("actions"))


def tls_passthrough(connections: DataFrame) -> DataFrame:
    """Mark connections to whitelisted hosts and to hosts that failed a handshake earlier.

    ``connections``: sni, ts, failed. Only the first failure of a host matters, so it is one small aggregate.
    """
    first = connections.filter("failed").groupBy("sni").agg(F.min("ts").alias("_fail"))
    white = F.col("sni").rlike(any_of(D.TLS_PASSTHROUGH_HOSTS))
    return (connections.filter(~blank("sni")).join(first, "sni", "left").withColumn("whitelisted", white)
            .withColumn("passthrough", white | F.coalesce(F.col("_fail") < F.col("ts"), F.lit(False))).drop("_fail"))
