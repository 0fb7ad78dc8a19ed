"""API calls, correlation and hook logs on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.functions import scalars as S
from privaudit.operators import apis, correlate, leaks
from privaudit.operators.joins import first_match
from privaudit.plans.registry import query
from privaudit.session import table
from privaudit.sources import readers

# --- categories and entities ------------------------------------------------------------------------

CALLS_SQL = """
WITH tx AS (SELECT * FROM (VALUES ('设备信息', 'click'), ('网络信息', 'click'), ('网络信息', 'view'), ('个人信息', 'signup'), ('位置信息', 'purchase')) v(category, privacy_type)),
c AS (SELECT user_id AS package, event_id AS call_id, event_type AS privacy_type, 'api' || (event_id % 7) AS api, event_id % 4 = 0 AS third,
             CASE WHEN event_id % 4 = 0 THEN 'sdk' || (event_id % 3) ELSE '应用自身业务' END AS sdk_name FROM events),
m AS (SELECT c.*, coalesce(category, '其他信息') AS category FROM c LEFT JOIN tx ON c.privacy_type = tx.privacy_type)
"""


def taxonomy(spark) -> DataFrame:
    rows = [(0, "设备信息", "click"), (1, "网络信息", "click"), (2, "网络信息", "view"), (3, "个人信息", "signup"), (4, "位置信息", "purchase")]
    return spark.createDataFrame(rows, "ord int, parent string, child string")


def call_rows(spark, sf) -> DataFrame:
    third = F.col("event_id") % 4 == 0
    return table(spark, sf, "events").select(
        F.col("user_id").alias("package"), F.col("event_id").alias("call_id"), F.col("event_type").alias("privacy_type"),
        F.concat(F.lit("api"), (F.col("event_id") % 7).cast("string")).alias("api"), third.alias("is_third_party"),
        F.when(third, F.concat(F.lit("sdk"), (F.col("event_id") % 3).cast("string"))).otherwise("应用自身业务").alias("sdk_name"), F.lit("").alias("category"))


@query("api_by_category", CALLS_SQL + """
SELECT package, category, privacy_type, api, count(*) AS n FROM m
GROUP BY GROUPING SETS ((package, category), (package, category, privacy_type), (package, category, api))""")
def api_by_category(spark, sf):
    return apis.calls_by_category(apis.with_categories(call_rows(spark, sf), taxonomy(spark)))


@query("api_category_counts", CALLS_SQL + "SELECT package, count(DISTINCT call_id) AS total_calls, count(DISTINCT category) AS category_count FROM m GROUP BY package")
def api_category_counts(spark, sf):
    return apis.category_counts(apis.with_categories(call_rows(spark, sf), taxonomy(spark)))


@query("api_by_entity", CALLS_SQL + """
SELECT package, CASE WHEN third THEN 'Third-Party' ELSE 'App-Owned' END AS entity_type, CASE WHEN third THEN sdk_name ELSE package::VARCHAR END AS entity_name, category,
       count(*) AS total_count, string_agg(DISTINCT privacy_type, ',' ORDER BY privacy_type) AS privacy_types FROM m GROUP BY ALL""")
def api_by_entity(spark, sf):
    e = apis.calls_by_entity(apis.with_categories(call_rows(spark, sf), taxonomy(spark)))
    return e.withColumn("privacy_types", F.array_join(F.transform("privacy_types", lambda x: x["privacy_type"]), ","))


@query("taxonomy_parents", """
WITH t AS (SELECT n_regionkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
           UNION ALL SELECT 99, n_name, 'ALL' FROM nation WHERE n_nationkey % 2 = 0)
SELECT n_name AS child, arg_max(r_name, n_regionkey) AS parent, count(*) AS n_parents FROM t GROUP BY n_name""")
def taxonomy_parents(spark, sf):
    """Taxonomy JSON parsed and inverted: last parent and number of parents per child."""
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    named = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_regionkey").alias("o"), F.col("r_name").alias("parent"), "n_name")
    rows = named.unionByName(n.filter("n_nationkey % 2 = 0").select(F.lit(99).alias("o"), F.lit("ALL").alias("parent"), "n_name"))
    # a fixed dimension as one JSON document
    doc = rows.groupBy("o", "parent").agg(F.array_sort(F.collect_list("n_name")).alias("kids")).agg(
        F.to_json(F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("o", "parent", "kids"))), lambda x: F.struct(x["parent"], x["kids"])))).alias("value"))
    tx = readers.taxonomy(doc)
    return readers.single_parent(tx).join(tx.groupBy("child").agg(F.count("*").alias("n_parents")), "child")


# --- rules ------------------------------------------------------------------------------------------

RULES = [
    (0, "android.content.ContentResolver", "query", None, "ignored", "", ""),
    (1, "T", "click", None, "first", "c", ""),
    (2, "T", "click", None, "second", "c", ""),
    (3, "T", "view", None, "small", "c", 'arg="k": 1'),
    (4, "T", "view", None, "any", "c", "always"),
    (5, "T", "signup", None, "needs five", "c", "x=5"),
    (6, "T", "", "purchase", "field rule", "c", ""),
]


def rule_table(spark) -> DataFrame:
    return apis.api_rules(spark.createDataFrame(RULES, "ord int, `class` string, method string, field string, type string, category string, note string"))


@query("api_match", """
SELECT event_id AS call_id, privacy_type FROM (
  SELECT event_id, CASE event_type WHEN 'click' THEN 'second' WHEN 'view' THEN CASE WHEN contains(props, '"k": 1') THEN 'small' ELSE 'any' END
         WHEN 'signup' THEN CASE WHEN contains(props, '5') THEN 'needs five' END WHEN 'purchase' THEN 'field rule'
         ELSE CASE (event_id % 6) WHEN 0 THEN '访问contacts' WHEN 1 THEN '访问sms' WHEN 3 THEN '访问media' WHEN 4 THEN '访问calendar' END END AS privacy_type FROM events)
WHERE privacy_type IS NOT NULL""")
def api_match(spark, sf):
    uri = F.element_at(F.array(*[F.lit(u) for u in ("content://com.android.contacts/data", "content%3A%2F%2Fsms/inbox", "content://sms?from=umeng", "content://media/external",
                                                    "content://CalendarContract/x", "content://unknown")]), (F.col("event_id") % 6).cast("int") + 1)
    other = F.col("event_type") == "error"
    calls = table(spark, sf, "events").select(
        F.col("event_id").alias("call_id"), F.when(other, "android.content.ContentResolver").otherwise("T").alias("class"),
        F.when(other, "query").otherwise(F.col("event_type")).alias("method"), F.array(F.when(other, uri).otherwise(F.col("props"))).alias("args"))
    return apis.match_api(calls, rule_table(spark)).select("call_id", "privacy_type")


@query("api_retention", """
SELECT event_type, count(*) AS n_all, count(*) FILTER (event_type = 'signup' OR event_id % 3 <> 0 OR value > 50) AS n_kept FROM events GROUP BY 1""")
def api_retention(spark, sf):
    method = F.when(F.col("event_type") == "signup", "getDeviceId").otherwise(F.col("event_type"))
    ret = F.when(F.col("event_id") % 3 == 0, F.element_at(F.array(F.lit("null"), F.lit("[]"), F.lit("")), (F.col("event_id") % 9 / 3).cast("int") + 1)).otherwise(F.col("props"))
    args = F.when(F.col("value") > 50, F.array("props")).otherwise(F.array().cast("array<string>"))
    keep = S.keeps_api_call(method, ret, args)
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n_all"), F.count_if(keep).alias("n_kept"))


@query("api_descriptions", """
WITH d AS (SELECT * FROM (VALUES (0, 'android.view.click', 'tap'), (1, 'x.android.view.viewAll', 'look'), (2, 'android.error.errorCode', 'fault'), (3, 'android.view.view', 'see')) v(ord, key, description)),
a AS (SELECT DISTINCT CASE WHEN event_type = 'error' THEN 'android.error.error' ELSE 'android.view.' || event_type END AS api FROM events)
SELECT api, coalesce(max(description) FILTER (key = api), arg_min(description, ord) FILTER (contains(key, regexp_replace(api, '\\.[^.]*$', '')) AND contains(key, split_part(api, '.', 3)))) AS description
FROM a CROSS JOIN d GROUP BY api""")
def api_descriptions(spark, sf):
    d = spark.createDataFrame([(0, "android.view.click", "tap"), (1, "x.android.view.viewAll", "look"), (2, "android.error.errorCode", "fault"), (3, "android.view.view", "see")],
                              "ord int, key string, description string")
    e = F.col("event_type")
    return apis.describe_apis(table(spark, sf, "events").select(F.when(e == "error", "android.error.error").otherwise(F.concat(F.lit("android.view."), e)).alias("api")), d)


# --- logs -------------------------------------------------------------------------------------------

@query("hook_log_scan", """
SELECT user_id AS package, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS stage, event_id AS line_no,
       CASE WHEN event_id % 50 <> 0 THEN date_trunc('second', ts) END AS ts, 'com.T.' || event_type AS api, props AS arg, value::VARCHAR AS return_value
FROM events WHERE event_id % 97 <> 0""")
def hook_log_scan(spark, sf):
    """Hook-log lines with some truncated lines and some bad times, parsed back to calls."""
    ev = table(spark, sf, "events")
    stamp = F.when(F.col("event_id") % 50 == 0, "2024-01-01").otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    js = F.to_json(F.struct(stamp.alias("ts"), F.lit("com.T").alias("class"), F.col("event_type").alias("method"), F.array("props").alias("args"), F.col("value").cast("string").alias("ret")))
    line = F.when(F.col("event_id") % 97 == 0, F.left(js, F.length(js) - 5)).otherwise(js)
    lines = ev.select(F.col("user_id").alias("package"), F.when(F.col("event_id") % 2 == 0, 1).otherwise(2).alias("stage"), F.col("event_id").alias("line_no"), line.alias("value"))
    c = readers.api_calls(lines)
    return readers.time_ordered(c, "ts", "line_no").select("package", "stage", "line_no", F.col("ts").cast("timestamp_ntz").alias("ts"), "api", F.element_at("args", 1).alias("arg"), "return_value")


@query("hook_log_rejects", "SELECT count(*) FILTER (event_id % 97 = 0) AS bad, count(*) FILTER (event_id % 97 <> 0) AS good FROM events")
def hook_log_rejects(spark, sf):
    js = F.to_json(F.struct(F.lit("com.T").alias("class"), F.col("event_type").alias("method")))
    lines = table(spark, sf, "events").select(F.when(F.col("event_id") % 97 == 0, F.left(js, F.length(js) - 5)).otherwise(js).alias("value"))
    p = readers.parse_json_lines(lines, "value", "`class` STRING, method STRING")
    return p.agg(F.count_if(F.col(readers.BAD).isNotNull()).alias("bad"), F.count_if(F.col(readers.BAD).isNull()).alias("good"))


@query("monitored_apis", "SELECT 'c.' || p_type AS class, p_name AS method, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS description FROM part WHERE p_partkey % 10 <> 0")
def monitored_apis(spark, sf):
    k = F.col("p_partkey")
    line = F.when(k % 10 == 0, F.col("p_name")).when(k % 2 == 0, F.concat(F.lit(" c."), "p_type", F.lit(", "), "p_name", F.lit("| "), "p_brand")) \
        .otherwise(F.concat(F.lit("c."), "p_type", F.lit(","), "p_name"))
    return readers.monitored_apis(table(spark, sf, "part").select(line.alias("value")))


@query("leak_string_roundtrip", """
SELECT p_partkey, p_name AS privacy_type, p_type AS value, CASE WHEN p_size % 2 = 0 THEN 'md5hex' ELSE 'normal' END AS encode_type,
       CASE WHEN p_size % 3 = 0 THEN 'outbound' ELSE 'inbound' END AS direction, 'h' || p_partkey || '.example.com' AS host,
       CASE WHEN p_size % 5 = 0 THEN 'cookie' ELSE '' END AS meta, p_size % 7 = 0 AS is_crypt FROM part""")
def leak_string_roundtrip(spark, sf):
    p = table(spark, sf, "part")
    meta = F.when(F.col("p_size") % 5 == 0, "cookie")
    enc = F.when(F.col("p_size") % 2 == 0, "md5hex").otherwise("normal")
    s = S.leak_to_string("p_name", "p_type", enc, meta, F.col("p_size") % 3 == 0, F.concat(F.lit("h"), F.col("p_partkey").cast("string"), F.lit(".example.com")), F.col("p_size") % 4 == 0)
    s = F.when(F.col("p_size") % 7 == 0, F.regexp_replace(s, "([<>])", "@json$1")).otherwise(s)
    return p.select("p_partkey", S.parse_leak_string(s).alias("x")).select("p_partkey", "x.privacy_type", "x.value", "x.encode_type", "x.direction", "x.host", "x.meta", "x.is_crypt")


# --- correlation ------------------------------------------------------------------------------------

CORR_SQL = """
WITH c AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'click'),
t AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'),
l AS (SELECT event_id, user_id, ts, value FROM events WHERE event_type = 'purchase'),
jt AS (SELECT c.event_id AS call_id, t.event_id, row_number() OVER (PARTITION BY c.event_id ORDER BY t.ts, t.event_id) AS rn, count(*) OVER (PARTITION BY c.event_id) AS n
       FROM c JOIN t ON c.user_id = t.user_id AND t.ts BETWEEN c.ts - INTERVAL 60 SECOND AND c.ts + INTERVAL 3600 SECOND),
jl AS (SELECT c.event_id AS call_id, l.event_id, l.value, row_number() OVER (PARTITION BY c.event_id ORDER BY l.ts, l.event_id) AS rn, count(*) OVER (PARTITION BY c.event_id) AS n
       FROM c JOIN l ON c.user_id = l.user_id AND l.ts BETWEEN c.ts - INTERVAL 60 SECOND AND c.ts + INTERVAL 3600 SECOND),
gt AS (SELECT call_id, max(n) AS n_traffic, string_agg(event_id, ',' ORDER BY rn) AS traffic, bool_or(event_id % 5 = call_id % 5) AS named FROM jt GROUP BY 1),
gl AS (SELECT call_id, max(n) AS n_leaks, string_agg(event_id, ',' ORDER BY rn) AS leaks, bool_or(event_id % 7 = call_id % 7) AS shown FROM jl GROUP BY 1)
SELECT c.user_id AS package, c.event_id AS call_id, coalesce(n_traffic, 0) AS n_traffic, coalesce(n_leaks, 0) AS n_leaks, coalesce(traffic, '') AS traffic, coalesce(leaks, '') AS leaks,
       (10 * coalesce(n_traffic, 0) + 20 * coalesce(n_leaks, 0) + CASE WHEN coalesce(shown, false) THEN 50 ELSE 0 END + CASE WHEN c.event_id % 2 = 0 AND coalesce(named, false) THEN 30 ELSE 0 END)::INT AS score
FROM c LEFT JOIN gt ON gt.call_id = c.event_id LEFT JOIN gl ON gl.call_id = c.event_id WHERE n_traffic > 0 OR n_leaks > 0"""


@query("api_traffic_correlation", CORR_SQL)
def api_traffic_correlation(spark, sf):
    """Clicks as calls, errors as traffic, purchases as leaks, window widened to −60 s … +3600 s."""
    ev = table(spark, sf, "events")
    c = ev.filter("event_type = 'click'").select(F.col("user_id").alias("package"), F.col("event_id").alias("call_id"), "ts")
    t = ev.filter("event_type = 'error'").select(F.col("user_id").alias("package"), F.col("event_id").alias("seq"), "ts", F.concat(F.lit("h.kit"), (F.col("event_id") % 5).cast("string"), F.lit(".example.com")).alias("host"))
    lk = ev.filter("event_type = 'purchase'").select(F.col("user_id").alias("package"), F.col("event_id").alias("seq"), "ts", F.concat(F.lit("x secret-"), (F.col("event_id") % 7).cast("string"), F.lit(" y")).alias("value_preview"))
    r = correlate.correlate(c, t, lk, before_s=60, after_s=3600)
    i = F.col("call_id")
    score = correlate.correlation_score(F.concat(F.lit("secret-"), (i % 7).cast("string")), F.concat(F.lit("Kit"), (i % 5).cast("string")), i % 2 == 0, F.col("related_traffic"), F.col("related_leaks"))

    def ids(col):
        return F.coalesce(F.array_join(F.transform(col, lambda x: x["seq"].cast("string")), ","), F.lit(""))

    return r.select("package", "call_id", "n_traffic", "n_leaks", ids("related_traffic").alias("traffic"), ids("related_leaks").alias("leaks"), score.alias("score"))


@query("correlation_targets", """
WITH c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'),
t AS (SELECT event_id, user_id, ts, 'h' || (event_id % 3) || CASE event_id % 3 WHEN 0 THEN '.example.net' WHEN 1 THEN '.example.org' ELSE '.other.io' END AS host FROM events WHERE event_type = 'error'),
j AS (SELECT c.event_id AS call_id, c.user_id AS package, t.host, row_number() OVER (PARTITION BY c.event_id ORDER BY t.ts, t.event_id) AS rn
      FROM c JOIN t ON c.user_id = t.user_id AND t.ts BETWEEN c.ts - INTERVAL 60 SECOND AND c.ts + INTERVAL 3600 SECOND),
k AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY rn) AS r2 FROM j WHERE host NOT LIKE '%.io')
SELECT package, call_id, string_agg(host || ':' || CASE WHEN host LIKE '%net' THEN 'NetKit' ELSE 'OrgKit' END, ',' ORDER BY rn) AS targets FROM k WHERE r2 <= 3 GROUP BY 1, 2""")
def correlation_targets(spark, sf):
    from privaudit.plans.leaks import host_dictionary
    ev = table(spark, sf, "events")
    c = ev.filter("event_type = 'click'").select(F.col("user_id").alias("package"), F.col("event_id").alias("call_id"), "ts")
    k = F.col("event_id") % 3
    host = F.concat(F.lit("h"), k.cast("string"), F.when(k == 0, ".example.net").when(k == 1, ".example.org").otherwise(".other.io"))
    t = ev.filter("event_type = 'error'").select(F.col("user_id").alias("package"), F.col("event_id").alias("seq"), "ts", host.alias("host"))
    bought = ev.filter("event_type = 'purchase'").select(F.col("user_id").alias("package"), F.col("event_id").alias("seq"), "ts")
    r = correlate.correlate(c, t, bought, before_s=60, after_s=3600)
    out = correlate.third_party_targets(r, leaks.host_sdk(t, host_dictionary(spark)).select("host", "sdk_name"), first_n=3)
    return out.select("package", "call_id", F.array_join(F.transform("traffic_sdks", lambda x: F.concat_ws(":", x["host"], x["sdk_name"])), ",").alias("targets"))


# --- UI events --------------------------------------------------------------------------------------

@query("ui_event_scan", """
SELECT 'pkg' || user_id AS package, strftime(ts, '%Y%m%d%H%M%S') AS dump_id, date_trunc('second', ts) AS ts, event_type AS op_text, count(*) AS n
FROM events WHERE event_id % 10 <> 0 GROUP BY ALL""")
def ui_event_scan(spark, sf):
    """Dump paths and semantics made of events; folders that are not 14 digits are skipped."""
    stamp = F.date_format("ts", "yyyyMMddHHmmss")
    folder = F.when(F.col("event_id") % 10 == 0, F.concat(stamp, F.lit("_AGREE_0"))).otherwise(stamp)
    d = table(spark, sf, "events").select(
        F.concat(F.lit("file:/d/pkg"), F.col("user_id").cast("string"), F.lit("/"), folder, F.lit("/textual_semantics.json")).alias("file"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise("").alias("op_widget_text"), F.col("event_type").alias("op_text"),
        F.lit("").alias("op_widget_bounds"), F.lit("[0,0][1,1]").alias("op_bounds"), F.array("event_type").alias("api_name_list"), F.lit("tap").alias("action_type"), F.lit("B").alias("widget_class"))
    e = readers.ui_events(d)
    return e.groupBy("package", "dump_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "op_text").agg(F.count("*").alias("n"))


@query("first_api_rule", """
SELECT user_id AS package, event_type AS api, min(event_id) AS first_call FROM events GROUP BY 1, 2""")
def first_api_rule(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("package"), F.col("event_type").alias("api"), "event_id")
    return first_match(e, ["package", "api"], ["event_id"], ["event_id"]).withColumnRenamed("event_id", "first_call")
