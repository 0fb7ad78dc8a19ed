"""Fleet-level roll-ups and static facts on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.operators import fleet, statics
from privaudit.plans.registry import query
from privaudit.session import table

# --- strategies -------------------------------------------------------------------------------------

STRAT_SQL = """
WITH a AS (SELECT 'S' || (user_id % 3) AS strategy, user_id % 40 AS package, count(*) AS calls, count(DISTINCT event_type) AS cats FROM events GROUP BY 1, 2)
"""


def strategy_apps(spark, sf) -> DataFrame:
    return (table(spark, sf, "events").groupBy(F.concat(F.lit("S"), (F.col("user_id") % 3).cast("string")).alias("strategy"), (F.col("user_id") % 40).alias("package"))
            .agg(F.count("*").alias("calls"), F.countDistinct("event_type").alias("cats")).withColumn("steps", F.lit(600)))


@query("strategy_metrics", STRAT_SQL + """
SELECT strategy, count(*) AS apps, sum(calls)::BIGINT AS total_calls, sum(cats)::BIGINT AS total_cats, round(sum(calls) / count(*), 2)::DOUBLE AS avg_calls, round(sum(cats) / count(*), 2)::DOUBLE AS avg_cats,
       round(sum(calls) / count(*) / 600 * 100, 4)::DOUBLE AS calls_per_100_steps, round(sum(cats) / count(*) / 600 * 100, 4)::DOUBLE AS cats_per_100_steps, 600 AS steps FROM a GROUP BY 1""")
def strategy_metrics(spark, sf):
    return fleet.strategy_metrics(strategy_apps(spark, sf))


@query("strategy_compare", STRAT_SQL + "SELECT package, " + ", ".join(
    f"coalesce(max(calls) FILTER (strategy = 'S{i}'), 0) AS S{i}_calls, coalesce(max(cats) FILTER (strategy = 'S{i}'), 0) AS S{i}_cats, "
    f"coalesce(max(round(calls / 600, 4)) FILTER (strategy = 'S{i}'), 0)::DOUBLE AS S{i}_calls_per_step, coalesce(max(round(cats / 600 * 100, 4)) FILTER (strategy = 'S{i}'), 0)::DOUBLE AS S{i}_cats_per_100"
    for i in range(3)) + ", coalesce(max(calls) FILTER (strategy = 'S2'), 0) - coalesce(max(calls) FILTER (strategy = 'S0'), 0) AS calls_diff FROM a GROUP BY 1")
def strategy_compare(spark, sf):
    names = ["S0", "S1", "S2"]
    return fleet.ordered_comparison(fleet.strategy_comparison(strategy_apps(spark, sf), names, "S2", "S0"), names)


@query("strategy_packages", "SELECT user_id AS package FROM events WHERE event_type = 'click' UNION SELECT user_id FROM events WHERE event_type = 'view' UNION SELECT c_custkey FROM customer")
def strategy_packages(spark, sf):
    """Union of the packages seen by any strategy."""
    ev = table(spark, sf, "events")
    a = ev.filter("event_type = 'click'").select(F.col("user_id").alias("package"))
    b = ev.filter("event_type = 'view'").select(F.col("user_id").alias("package"))
    return a.union(b).union(table(spark, sf, "customer").select("c_custkey")).distinct()


@query("coverage", """
WITH d AS (SELECT DISTINCT event_type AS t FROM events), u AS (SELECT DISTINCT user_id AS package FROM events),
v AS (SELECT DISTINCT user_id * 2 AS package, event_type AS t FROM events)
SELECT u.package, count(*) AS declared, count(v.t) AS visited, count(v.t) / count(*) AS coverage FROM u CROSS JOIN d LEFT JOIN v ON v.package = u.package AND v.t = d.t GROUP BY 1""")
def coverage(spark, sf):
    """Visited over declared activities, named in the three notations."""
    ev = table(spark, sf, "events")
    pkg = F.concat(F.lit("com.u"), F.col("user_id").cast("string")).alias("package")
    k, t = F.col("event_id") % 3, F.initcap("event_type")
    # activities are seen under every second package, so the others have visited none
    twice = F.concat(F.lit("com.u"), (F.col("user_id") * 2).cast("string"))
    seen = ev.select(twice.alias("package"), F.when(k == 0, F.concat(twice, F.lit("/."), t)).when(k == 1, F.concat(F.lit("."), t)).otherwise(F.concat(twice, F.lit("."), t)).alias("activity"))
    declared = ev.select(pkg).distinct().withColumn("activity", F.explode(F.array(*[F.lit("." + n) for n in ("Signup", "Error", "Click", "View", "Purchase")])))
    c = fleet.activity_coverage(seen, declared)
    return c.select(F.regexp_extract("package", "u([0-9]+)", 1).cast("long").alias("package"), "declared", "visited", "coverage")


@query("behaviour_score", """
WITH a AS (SELECT user_id AS package, count(DISTINCT event_type) FILTER (value > 97 AND event_type IN ('click', 'view')) * 1 AS d, count(DISTINCT event_id % 10) FILTER (value > 90) AS s FROM events GROUP BY 1)
SELECT package, d::INT AS n_dangerous, s::INT AS n_apis, greatest(100 - d * 2 - s * 5, 0)::INT AS score, CASE WHEN 100 - d * 2 - s * 5 < 60 THEN 'high' WHEN 100 - d * 2 - s * 5 < 85 THEN 'medium' ELSE 'low' END AS risk_level FROM a""")
def behaviour_score(spark, sf):
    perm = F.when(F.col("event_type") == "click", "android.permission.CAMERA").when(F.col("event_type") == "view", "android.permission.READ_SMS").otherwise("android.permission.INTERNET")
    apps = table(spark, sf, "events").groupBy(F.col("user_id").alias("package")).agg(
        F.collect_set(F.when(F.col("value") > 97, perm)).alias("permissions"), F.collect_set(F.when(F.col("value") > 90, F.col("event_id") % 10)).alias("sensitive_apis"))
    return fleet.behaviour_score(apps)


@query("run_status", "SELECT CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS status, CASE WHEN event_type = 'error' THEN 'code' || (event_id % 3) ELSE '' END AS reason, count(*) AS n FROM events GROUP BY 1, 2")
def run_status(spark, sf):
    bad = F.col("event_type") == "error"
    return fleet.run_status(table(spark, sf, "events").select(F.when(bad, "failed").otherwise("success").alias("status"), F.when(bad, F.concat(F.lit("code"), (F.col("event_id") % 3).cast("string"))).otherwise("").alias("reason")))


@query("static_facts", """
WITH i AS (SELECT user_id * 2 AS user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1), h AS (SELECT user_id * 3 AS user_id, count(DISTINCT '[c] ' || event_type || '.' || (event_id % 3)) AS n FROM events GROUP BY 1)
SELECT coalesce(i.user_id, h.user_id) AS app_id, CASE WHEN i.user_id IS NULL THEN 'app' || h.user_id ELSE 'pkg' || i.user_id END AS package, coalesce(i.n, 0)::INT AS n_permissions, coalesce(h.n, 0)::INT AS n_apis, CASE WHEN coalesce(i.user_id, h.user_id) % 2 = 0 THEN 1 ELSE 0 END::INT AS n_sensitive
FROM i FULL JOIN h ON i.user_id = h.user_id""")
def static_facts(spark, sf):
    """Static permissions and hooks merged, then joined with runtime results."""
    from privaudit.sources.readers import hook_list
    ev = table(spark, sf, "events")
    # information about every second id, hooks of every third: some apps have one of them only
    two, three = (F.col("user_id") * 2).cast("string"), (F.col("user_id") * 3).cast("string")
    info = ev.groupBy(F.concat(F.lit("app"), two).alias("app_name"), F.concat(F.lit("pkg"), two).alias("package")).agg(F.collect_set(F.concat(F.lit("android.permission."), "event_type")).alias("permissions"))
    cfg = ev.select(F.concat(F.lit("app"), three).alias("app_name"), F.lit("c").alias("Category"), F.array(F.struct(F.col("event_type").alias("clazz"), (F.col("event_id") % 3).cast("string").alias("method"))).alias("hooks"))
    st = fleet.static_facts(info, hook_list(cfg))
    dyn = st.select("app_name", F.lit("x").alias("package"), F.when(F.regexp_extract("app_name", "([0-9]+)", 1).cast("long") % 2 == 0, F.array(F.lit("a"))).alias("sensitive_apis"))
    m = fleet.merge_app_results(st, dyn)
    return m.select(F.regexp_extract("app_name", "([0-9]+)", 1).cast("long").alias("app_id"), "package", F.size("permissions").alias("n_permissions"), F.size("static_apis").alias("n_apis"), F.size("sensitive_apis").alias("n_sensitive"))


@query("find_reports", """
WITH r AS (SELECT DISTINCT CASE WHEN o_custkey % 3 = 0 THEN 'pkg' ELSE 'app' END || o_custkey AS name, o_custkey AS report_id FROM orders)
SELECT c_custkey AS app_id, r.name, r.report_id FROM customer JOIN r ON r.name = CASE WHEN c_custkey % 3 = 0 THEN 'pkg' ELSE 'app' END || c_custkey""")
def find_reports(spark, sf):
    k = F.col("o_custkey")
    rep = table(spark, sf, "orders").select(F.concat(F.when(k % 3 == 0, "pkg").otherwise("app"), k.cast("string")).alias("name"), k.alias("report_id")).distinct()
    c = F.col("c_custkey").cast("string")
    return fleet.find_reports(table(spark, sf, "customer").select(F.col("c_custkey").alias("app_id"), F.concat(F.lit("pkg"), c).alias("package"), F.concat(F.lit("app"), c).alias("app_name")), rep)


# --- components and methods ---------------------------------------------------------------------------

@query("exported_components", """
WITH c AS (SELECT p_partkey, 'n' || p_partkey AS name, CASE p_size % 3 WHEN 0 THEN 'true' WHEN 1 THEN '' ELSE 'false' END AS exported, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'perm_normal' WHEN 2 THEN 'perm_signature' ELSE 'perm_none' END AS permission, p_type FROM part),
a AS (SELECT l_partkey, string_agg(DISTINCT 'act' || l_linenumber, ',' ORDER BY 'act' || l_linenumber) AS actions FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1)
SELECT p_brand AS package, p_type AS type, name, coalesce(actions, '') AS actions FROM c JOIN part USING (p_partkey, p_type) LEFT JOIN a ON l_partkey = p_partkey
WHERE (exported = 'true' OR (exported = '' AND actions IS NOT NULL)) AND (permission IS NULL OR permission = 'perm_normal')""")
def exported_components(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    comp = p.select(F.col("p_brand").alias("package"), F.concat(F.lit("n"), k.cast("string")).alias("name"), F.col("p_type").alias("type"),
                    F.when(F.col("p_size") % 3 == 0, "true").when(F.col("p_size") % 3 == 1, "").otherwise("false").alias("exported"),
                    F.when(k % 4 == 1, "perm_normal").when(k % 4 == 2, "perm_signature").when(k % 4 == 3, "perm_none").alias("permission"))
    li = table(spark, sf, "lineitem").select("l_partkey", "l_linenumber")
    act = F.when(F.col("l_linenumber") == 7, "END_EMMA").otherwise(F.concat(F.lit("act"), F.col("l_linenumber").cast("string")))
    actions = li.join(p.select("p_partkey", "p_brand"), li.l_partkey == p.p_partkey).select(F.col("p_brand").alias("package"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("name"), act.alias("action"))
    perms = spark.createDataFrame([("perm_normal", "normal"), ("perm_signature", "signature")], "permission string, level string")
    return statics.exported_components(comp, actions, perms).withColumn("actions", F.array_join("actions", ","))


@query("suspicious_methods", """
WITH m AS (SELECT p_partkey, p_brand AS package, CASE p_partkey % 5 WHEN 0 THEN 'com.google.x' WHEN 1 THEN 'com.a$b' ELSE 'com.app.k' || p_partkey END AS class,
  CASE p_size % 4 WHEN 0 THEN 'isRooted' WHEN 1 THEN 'encryptAll' WHEN 2 THEN 'addJavascriptInterface' ELSE 'decryptKey-impl' END AS method,
  CASE p_partkey % 3 WHEN 0 THEN 'Z' WHEN 1 THEN 'S' ELSE 'V' END AS ret FROM part)
SELECT package, class, method, CASE p_size % 4 WHEN 0 THEN 'Root Detection' WHEN 1 THEN 'Crypto' ELSE 'WebView Risk' END AS category FROM m JOIN part USING (p_partkey)
WHERE class NOT LIKE '%$%' AND ((p_size % 4 = 0 AND ret = 'Z' AND class <> 'com.google.x') OR (p_size % 4 = 1 AND (ret = 'Z' OR ret = 'S')) OR p_size % 4 = 2)""")
def suspicious_methods(spark, sf):
    k, z = F.col("p_partkey"), F.col("p_size") % 4
    d = F.when(k % 3 == 0, "(Landroid/content/Context;[B)Z").when(k % 3 == 1, "(I)Ljava/lang/String;").otherwise("(I[[J)V")
    m = table(spark, sf, "part").select(
        F.col("p_brand").alias("package"), F.when(k % 5 == 0, "com.google.x").when(k % 5 == 1, "com.a$b").otherwise(F.concat(F.lit("com.app.k"), k.cast("string"))).alias("class"),
        F.when(z == 0, "isRooted").when(z == 1, "encryptAll").when(z == 2, "addJavascriptInterface").otherwise("decryptKey-impl").alias("method"), d.alias("descriptor"))
    return statics.suspicious_methods(m)


@query("method_descriptors", """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'android.content.Context,byte[]' WHEN 1 THEN 'int' ELSE 'int,long[][]' END AS params, CASE p_partkey % 3 WHEN 0 THEN 'boolean' WHEN 1 THEN 'java.lang.String' ELSE 'void' END AS returns FROM part""")
def method_descriptors(spark, sf):
    k = F.col("p_partkey")
    d = F.when(k % 3 == 0, "(Landroid/content/Context;[B)Z").when(k % 3 == 1, "(I)Ljava/lang/String;").otherwise("(I[[J)V")
    m = table(spark, sf, "part").select("p_partkey", d.alias("d")).withColumn("x", statics.descriptor("d"))
    return m.select("p_partkey", F.array_join("x.params", ",").alias("params"), "x.returns")


@query("tls_passthrough", """
WITH c AS (SELECT event_id, ts, event_type = 'error' AS failed, CASE user_id % 10 WHEN 0 THEN 'a.qq.com' ELSE 'h' || user_id || '.example.com' END AS sni FROM events),
f AS (SELECT sni, min(ts) AS ft FROM c WHERE failed GROUP BY 1)
SELECT event_id, contains(c.sni, 'qq.com') AS whitelisted, contains(c.sni, 'qq.com') OR coalesce(ft < ts, false) AS passthrough FROM c LEFT JOIN f ON c.sni = f.sni""")
def tls_passthrough(spark, sf):
    sni = F.when(F.col("user_id") % 10 == 0, "a.qq.com").otherwise(F.concat(F.lit("h"), F.col("user_id").cast("string"), F.lit(".example.com")))
    c = table(spark, sf, "events").select("event_id", "ts", (F.col("event_type") == "error").alias("failed"), sni.alias("sni"))
    return statics.tls_passthrough(c).select("event_id", "whitelisted", "passthrough")
