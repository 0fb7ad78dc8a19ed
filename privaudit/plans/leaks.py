"""Leak detection, attribution and summaries on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privaudit import dictionaries as D
from privaudit.functions import payload as P
from privaudit.functions import scalars as S
from privaudit.operators import fleet, integrate, joins, leaks, report
from privaudit.plans.registry import query
from privaudit.session import spread, table
from privaudit.sources.readers import host_from_url


def quoted(terms) -> str:
    """SQL list of string literals."""
    return ", ".join("'" + t.replace("'", "''") + "'" for t in terms)


# --- leak records made of line items ----------------------------------------------------------------
# package = supplier nation, host by supplier (SDK, own, local file, other), field = part name

SDK_SQL = """
sdk AS (
  SELECT n_nationkey AS ord, n_name AS name, 'Company' || n_regionkey AS company, 'cat' || n_regionkey AS category,
         'sdk' || n_nationkey || '.example.com' AS domain
  FROM nation
  UNION ALL SELECT 1000, 'Generic', 'GenericCo', 'other', 'example.com')"""

LEAKS_SQL = f"""
WITH {SDK_SQL},
rec AS (
  SELECT 'com.nation' || s_nationkey || '.app' AS package, strftime(l_shipdate, '%Y%m%d%H%M%S') AS ts,
         p_name AS privacy_field, p_type AS category_level1, p_brand AS category_level2,
         CASE WHEN l_linestatus = 'O' THEN 'outbound' ELSE 'inbound' END AS direction,
         CASE s_suppkey % 4 WHEN 0 THEN 's' || s_suppkey || '.sdk' || s_nationkey || '.example.com'
              WHEN 1 THEN 's' || s_suppkey || '.nation' || s_nationkey || '.example.org'
              WHEN 2 THEN '/storage/emulated/0/s' || s_suppkey || '.txt'
              ELSE 's' || s_suppkey || '.example.net' END AS host,
         CASE WHEN s_suppkey % 4 = 2 THEN 'file_buffer' WHEN l_linenumber % 2 = 0 THEN 'http' ELSE 'https' END AS source,
         CASE WHEN l_linenumber > 3 THEN 'H->cookie' ELSE '' END AS meta,
         CASE WHEN l_discount > 0.05 THEN 'md5hex' ELSE 'normal' END AS encode_type,
         l_returnflag = 'A' AS encrypted, l_tax > 0.06 AS has_crypt, l_orderkey, l_linenumber
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
att AS (
  SELECT host, arg_min(name, ord) AS sdk_name, arg_min(company, ord) AS company
  FROM (SELECT DISTINCT host FROM rec) h JOIN sdk ON contains(lower(host), domain) GROUP BY host),
leak AS (
  SELECT rec.*, sdk_name IS NOT NULL AS third,
         (contains(rec.host, split_part(package, '.', 2)) OR contains(rec.host, package)) AS own,
         CASE WHEN sdk_name IS NOT NULL THEN sdk_name
              WHEN contains(rec.host, split_part(package, '.', 2)) THEN package ELSE '' END AS sdk_key_name,
         (source = 'file_buffer' OR contains(rec.host, '/')) AS is_local
  FROM rec LEFT JOIN att ON rec.host = att.host)
"""


def sdk_table(spark: SparkSession, sf: str) -> DataFrame:
    """SDK dictionary from the nations, plus a generic entry that every example.com host would match last."""
    n = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), F.concat(F.lit("Company"), F.col("n_regionkey").cast("string")).alias("company"),
        F.concat(F.lit("cat"), F.col("n_regionkey").cast("string")).alias("category"),
        F.array(F.concat(F.lit("com.example.sdk"), F.col("n_nationkey").cast("string"))).alias("packages"),
        F.array(F.concat(F.lit("sdk"), F.col("n_nationkey").cast("string"), F.lit(".example.com"))).alias("domains"))
    g = spark.createDataFrame([(1000, "Generic", "GenericCo", "other", ["com.example"], ["example.com"])], n.schema)
    return n.unionByName(g)


def supplier_host():
    k, n = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    return (F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("s"), k, F.lit(".sdk"), n, F.lit(".example.com")))
            .when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("s"), k, F.lit(".nation"), n, F.lit(".example.org")))
            .when(F.col("s_suppkey") % 4 == 2, F.concat(F.lit("/storage/emulated/0/s"), k, F.lit(".txt")))
            .otherwise(F.concat(F.lit("s"), k, F.lit(".example.net"))))


def raw_leaks(spark: SparkSession, sf: str) -> DataFrame:
    li = spread(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"), "l_orderkey")
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    j = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    n, host = F.col("s_nationkey").cast("string"), supplier_host()
    return j.select(
        F.concat(F.lit("com.nation"), n, F.lit(".app")).alias("package"), F.date_format("l_shipdate", "yyyyMMddHHmmss").alias("ts"),
        F.col("p_name").alias("privacy_field"), F.col("p_type").alias("category_level1"), F.col("p_brand").alias("category_level2"),
        F.when(F.col("l_linestatus") == "O", "outbound").otherwise("inbound").alias("direction"), host.alias("host"),
        F.when(F.col("s_suppkey") % 4 == 2, "file_buffer").when(F.col("l_linenumber") % 2 == 0, "http").otherwise("https").alias("source"),
        F.when(F.col("l_linenumber") > 3, "H->cookie").otherwise("").alias("meta"),
        F.when(F.col("l_discount") > 0.05, "md5hex").otherwise("normal").alias("encode_type"), (F.col("l_returnflag") == "A").alias("encrypted"),
        F.when(F.col("l_tax") > 0.06, F.struct(F.lit(1).alias("stage"), F.lit("AES").alias("algorithm"), F.lit(False).alias("third_party"), F.lit(True).alias("encrypt"))).alias("crypt"),
        "l_orderkey", "l_linenumber")


def leak_records(spark: SparkSession, sf: str) -> DataFrame:
    hosts = table(spark, sf, "supplier").select(supplier_host().alias("host"))
    return leaks.normalize_leaks(raw_leaks(spark, sf), sdk_table(spark, sf), hosts)


# --- summaries --------------------------------------------------------------------------------------

@query("leak_attribution", LEAKS_SQL + """
SELECT package, CASE WHEN third THEN 'third' WHEN own THEN 'app_self' ELSE 'unknown' END AS owner, sdk_key_name AS sdk_name,
       count(*) AS n, count(DISTINCT host) AS hosts FROM leak GROUP BY ALL""")
def leak_attribution(spark, sf):
    r = leak_records(spark, sf)
    owner = F.when(F.col("sdk.is_third_party"), "third").otherwise(F.col("sdk.category"))
    return r.groupBy("package", owner.alias("owner"), F.col("sdk.name").alias("sdk_name")).agg(F.count("*").alias("n"), F.countDistinct("host").alias("hosts"))


@query("leak_totals", LEAKS_SQL + """
SELECT package, count(*) AS total_leaks, count(*) FILTER (encrypted) AS encrypted_count, count(*) FILTER (NOT encrypted) AS plaintext_count,
       count(*) FILTER (direction = 'outbound') AS outbound_count, count(*) FILTER (direction = 'inbound') AS inbound_count,
       count(*) FILTER (is_local) AS local_file_count, count(*) FILTER (NOT is_local) AS network_leak_count
FROM leak GROUP BY package""")
def leak_totals(spark, sf):
    return leaks.leak_totals(raw_leaks(spark, sf))


@query("leak_summary_by_category", """
SELECT 'com.nation' || s_nationkey || '.app' AS package, p_type AS category_level1, p_name AS privacy_field, count(*) AS n,
       grouping(p_name) = 1 AS is_category
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
GROUP BY GROUPING SETS ((s_nationkey, p_type), (s_nationkey, p_type, p_name))""")
def leak_summary_by_category(spark, sf):
    return leaks.leaks_by_category(raw_leaks(spark, sf))


@query("leak_summary_by_host", LEAKS_SQL + """
SELECT package, host, count(*) AS n, string_agg(DISTINCT privacy_field, ',' ORDER BY privacy_field) AS fields
FROM leak WHERE NOT is_local GROUP BY package, host""")
def leak_summary_by_host(spark, sf):
    return leaks.leaks_by_host(raw_leaks(spark, sf)).withColumn("fields", F.array_join("fields", ","))


@query("leak_summary_by_sdk", LEAKS_SQL + """
SELECT package, CASE WHEN sdk_key_name = '' THEN host ELSE sdk_key_name END AS sdk_key, count(*) AS n,
       string_agg(DISTINCT privacy_field, ',' ORDER BY privacy_field) AS fields, bool_or(third) AS is_third_party
FROM leak WHERE NOT is_local GROUP BY ALL""")
def leak_summary_by_sdk(spark, sf):
    return leaks.leaks_by_sdk(leak_records(spark, sf)).withColumn("fields", F.array_join("fields", ","))


SOURCE_SQL = LEAKS_SQL + """, src AS (
  SELECT package, CASE WHEN is_local THEN 'local_file' WHEN third THEN 'third_party' WHEN own THEN 'app_self' ELSE 'unknown' END AS source_class,
         CASE WHEN NOT is_local AND third THEN sdk_key_name ELSE host END AS source_key, privacy_field, ts, host, direction, encrypted
  FROM leak)
"""


@query("leak_by_source", SOURCE_SQL + """
SELECT package, source_class, source_key, count(*) AS n, count(DISTINCT privacy_field) AS n_fields
FROM src GROUP BY GROUPING SETS ((package), (package, source_class), (package, source_class, source_key))""")
def leak_by_source(spark, sf):
    return leaks.leaks_by_source(leak_records(spark, sf)).drop("level")


@query("leak_source_examples", SOURCE_SQL + """
SELECT package, source_class, source_key, ts, privacy_field AS field, host, direction, encrypted, rn FROM (
  SELECT *, row_number() OVER (PARTITION BY package, source_class, source_key ORDER BY ts, privacy_field, host, direction, encrypted) AS rn FROM src)
WHERE rn <= 3""")
def leak_source_examples(spark, sf):
    return leaks.source_examples(leak_records(spark, sf), 3)


@query("leak_report_totals", SOURCE_SQL + """, api AS (
  SELECT 'com.nation' || (user_id % 40) || '.app' AS package, count(*) AS api_total, count(*) FILTER (event_type <> 'error') AS api_own
  FROM events GROUP BY 1)
SELECT coalesce(l.package, api.package) AS package, coalesce(total_leaks, 0) AS total_leaks, coalesce(n_app_self, 0) AS n_app_self, coalesce(n_third_party, 0) AS n_third_party,
       coalesce(n_unknown, 0) AS n_unknown, coalesce(n_local_file, 0) AS n_local_file, coalesce(network_leaks, 0) AS network_leaks, coalesce(api_total, 0) AS api_total,
       coalesce(api_own, 0) AS api_own, coalesce(api_total, 0) - coalesce(api_own, 0) AS api_third FROM (
  SELECT package, count(*) AS total_leaks, count(*) FILTER (source_class = 'app_self') AS n_app_self,
         count(*) FILTER (source_class = 'third_party') AS n_third_party, count(*) FILTER (source_class = 'unknown') AS n_unknown,
         count(*) FILTER (source_class = 'local_file') AS n_local_file, count(*) FILTER (source_class <> 'local_file') AS network_leaks
  FROM src GROUP BY package) l FULL JOIN api ON l.package = api.package""")
def leak_report_totals(spark, sf):
    ev = table(spark, sf, "events").select(F.concat(F.lit("com.nation"), (F.col("user_id") % 40).cast("string"), F.lit(".app")).alias("package"), "event_type")
    calls = ev.groupBy("package", F.when(F.col("event_type") == "error", "Third-Party").otherwise("App-Owned").alias("entity_type")).agg(F.count("*").alias("total_count"))
    r = report.report_totals(leak_records(spark, sf), calls)
    return r.select("package", "total_leaks", "n_app_self", "n_third_party", "n_unknown", "n_local_file", "network_leaks", "api_total", "api_own", "api_third")


@query("report_top_sources", SOURCE_SQL + """
SELECT package, source_class, source_key, n, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY package, source_class ORDER BY n DESC, source_key) AS rank
  FROM (SELECT package, source_class, source_key, count(*) AS n FROM src GROUP BY 1, 2, 3)) WHERE rank <= 10""")
def report_top_sources(spark, sf):
    return report.top_sources(leak_records(spark, sf)).drop("n_fields")


@query("report_top_fields", """
SELECT package, privacy_field, n, rank FROM (
  SELECT 'com.nation' || s_nationkey || '.app' AS package, p_name AS privacy_field, count(*) AS n,
         row_number() OVER (PARTITION BY s_nationkey ORDER BY count(*) DESC, p_name) AS rank
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey, p_name)
WHERE rank <= 10""")
def report_top_fields(spark, sf):
    return report.top_fields(raw_leaks(spark, sf))


@query("evidence_metrics", LEAKS_SQL + """
SELECT package, count(*) AS total_records, count(DISTINCT category_level1) AS n_categories, count(DISTINCT privacy_field) AS n_fields,
       count(*) FILTER (net) AS network_records, count(DISTINCT host) FILTER (net) AS n_hosts,
       count(*) FILTER (source = 'file_buffer') AS file_records, count(DISTINCT host) FILTER (source = 'file_buffer') AS n_file_paths,
       count(*) FILTER (has_crypt) AS crypt_records, count(*) FILTER (encrypted) AS encrypted_records,
       count(*) FILTER (NOT encrypted) AS plaintext_records, count(*) FILTER (third) AS third_party_records,
       round(count(*) FILTER (net AND meta <> '') / count(*) FILTER (net), 4) AS meta_ratio,
       count(*) FILTER (encode_type <> 'normal') AS decoded_records
FROM (SELECT *, source IN ('http', 'https') OR contains(host, '.') AS net FROM leak) GROUP BY package""")
def evidence_metrics(spark, sf):
    return fleet.evidence_metrics(leak_records(spark, sf))


@query("component_ablation", LEAKS_SQL + """
SELECT package, count(*) AS all_records, count(*) FILTER (NOT has_crypt) AS no_crypt, count(*) FILTER (source <> 'file_buffer') AS no_file,
       count(*) FILTER (NOT encrypted) AS plaintext_only, count(*) FILTER (source IN ('http', 'https') OR contains(host, '.')) AS network_only,
       count(*) FILTER (has_crypt) AS crypt_only, count(*) FILTER (encrypted) AS encrypted_only
FROM leak GROUP BY package""")
def component_ablation(spark, sf):
    return fleet.component_ablation(fleet.evidence_metrics(leak_records(spark, sf)))


@query("category_breadth", """
WITH b AS (SELECT s_nationkey AS app, CASE WHEN l_returnflag = 'A' THEN 'ALL' WHEN l_returnflag = 'N' THEN 'NOAPI' ELSE 'NOESP' END AS config,
                  count(DISTINCT p_type) AS major, count(DISTINCT (p_type, p_name)) AS minor
           FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT n_nationkey AS app, c.config, major, minor
FROM nation CROSS JOIN (VALUES ('ALL'), ('NOAPI'), ('NOWIDGET'), ('NOESP')) c(config) LEFT JOIN b ON b.app = n_nationkey AND b.config = c.config""")
def category_breadth(spark, sf):
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
    p, s = table(spark, sf, "part").select("p_partkey", "p_name", "p_type"), table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    config = F.when(F.col("l_returnflag") == "A", "ALL").when(F.col("l_returnflag") == "N", "NOAPI").otherwise("NOESP")
    rows = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).select(
        F.col("s_nationkey").alias("app"), config.alias("config"), F.col("p_type").alias("category"), F.col("p_name").alias("field"))
    runs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("app"), F.explode(F.array(*[F.lit(c) for c in ("ALL", "NOAPI", "NOWIDGET", "NOESP")])).alias("config"))
    return fleet.category_breadth(rows, runs)


@query("batch_summary", """
WITH l AS (SELECT s_nationkey AS package, count(*) AS leaks FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
e AS (SELECT (user_id % 25)::INTEGER AS package, count(*) AS calls FROM events GROUP BY 1)
SELECT package, sum(leaks)::BIGINT AS leaks, sum(calls)::BIGINT AS calls FROM (
  SELECT package, leaks, 0 AS calls FROM l UNION ALL SELECT package, 0, calls FROM e) GROUP BY ROLLUP (package)""")
def batch_summary(spark, sf):
    li, s = table(spark, sf, "lineitem").select("l_suppkey"), table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("package"))
    ev = table(spark, sf, "events").select((F.col("user_id") % 25).cast("int").alias("package"))
    return fleet.batch_summary(li.join(s, li.l_suppkey == s.s_suppkey), ev)


# --- integrated view --------------------------------------------------------------------------------

FACTS_SQL = """
WITH net AS (
  SELECT s_nationkey AS package, CASE p_partkey % 4 WHEN 0 THEN 'imei' WHEN 1 THEN 'wifi' ELSE p_name END AS privacy_type,
         l_linestatus = 'O' AS outbound, l_returnflag = 'A' AS encrypted, s_name AS host
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
api AS (
  SELECT (user_id % 25)::INTEGER AS package, CASE event_type WHEN 'click' THEN 'imei' WHEN 'view' THEN 'wifi' ELSE event_type END AS privacy_type,
         'sdk' || (event_id % 3) AS sdk_name, event_type AS api FROM events),
info AS (
  SELECT package, privacy_type, sum(a)::BIGINT AS api_access, sum(o)::BIGINT AS outbound, sum(i)::BIGINT AS inbound, sum(e)::BIGINT AS encrypted,
         sum(p)::BIGINT AS plaintext, count(DISTINCT host) AS target_hosts, count(DISTINCT sdk_name) AS sdks
  FROM (SELECT package, privacy_type, 0 AS a, outbound::INT AS o, (NOT outbound)::INT AS i, encrypted::INT AS e, (NOT encrypted)::INT AS p, host, NULL AS sdk_name FROM net
        UNION ALL SELECT package, privacy_type, 1, 0, 0, 0, 0, NULL, sdk_name FROM api) GROUP BY 1, 2)
"""


def fact_rows(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    p, s = table(spark, sf, "part").select("p_partkey", "p_name"), table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_name")
    t = F.when(F.col("p_partkey") % 4 == 0, "imei").when(F.col("p_partkey") % 4 == 1, "wifi").otherwise(F.col("p_name"))
    net = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey).select(
        F.col("s_nationkey").alias("package"), t.alias("privacy_type"), (F.col("l_linestatus") == "O").alias("outbound"),
        (F.col("l_returnflag") == "A").alias("encrypted"), F.col("s_name").alias("host"), F.lit("http").alias("source"))
    e = F.col("event_type")
    api = table(spark, sf, "events").select(
        (F.col("user_id") % 25).cast("int").alias("package"), F.when(e == "click", "imei").when(e == "view", "wifi").otherwise(e).alias("privacy_type"),
        F.concat(F.lit("sdk"), (F.col("event_id") % 3).cast("string")).alias("sdk_name"), e.alias("api"))
    return integrate.facts(net, api)


def _like_any(col, words):
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


@query("integrated_risk", FACTS_SQL + f""", lv AS (
  SELECT *, CASE WHEN {_like_any('privacy_type', D.HIGH_RISK_WORDS)} THEN 0 WHEN {_like_any('privacy_type', D.MEDIUM_RISK_WORDS)} THEN 1 ELSE 2 END AS base FROM info)
SELECT package, privacy_type, api_access, outbound, inbound, encrypted, plaintext, target_hosts, sdks,
       CASE CASE WHEN outbound > 0 AND plaintext > 0 THEN greatest(base - 1, 0) ELSE base END WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS risk_level
FROM lv WHERE outbound > 0 OR api_access > 0""")
def integrated_risk(spark, sf):
    return integrate.ranked_risk(integrate.risk_items(integrate.by_info_type(fact_rows(spark, sf))))


@query("integrated_hosts", FACTS_SQL + """
SELECT package, host, count(*) FILTER (outbound) AS outbound, count(*) FILTER (NOT outbound) AS inbound, count(DISTINCT privacy_type) AS privacy_types,
       count(*) FILTER (encrypted) AS encrypted, count(*) FILTER (NOT encrypted) AS plaintext FROM net GROUP BY 1, 2""")
def integrated_hosts(spark, sf):
    return integrate.by_host(fact_rows(spark, sf))


@query("integrated_sdks", FACTS_SQL + """
SELECT package, sdk_name, count(*) AS api_calls, count(DISTINCT privacy_type) AS privacy_types, count(DISTINCT api) AS apis_used FROM api GROUP BY 1, 2""")
def integrated_sdks(spark, sf):
    return integrate.by_sdk(fact_rows(spark, sf))


@query("integrated_totals", FACTS_SQL + """
SELECT package, count(*) AS total_info_types, sum(api_access)::BIGINT AS api_access_count, sum(outbound + inbound)::BIGINT AS network_leak_count,
       sum(outbound)::BIGINT AS outbound_count, sum(inbound)::BIGINT AS inbound_count, sum(encrypted)::BIGINT AS encrypted_count,
       sum(plaintext)::BIGINT AS plaintext_count FROM info GROUP BY package""")
def integrated_totals(spark, sf):
    return integrate.totals(integrate.by_info_type(fact_rows(spark, sf)))


@query("top_category", """
WITH t AS (SELECT DISTINCT p_name AS privacy_type FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 2) FROM part UNION SELECT DISTINCT p_brand FROM part),
m AS (SELECT row_number() OVER (ORDER BY key) AS ord, key, 'cat' || (row_number() OVER (ORDER BY key) % 5) AS value
      FROM (SELECT DISTINCT upper(split_part(p_name, ' ', 1)) AS key FROM part UNION SELECT 'red widget' UNION SELECT 'BRAND#12'))
SELECT t.privacy_type, coalesce(max(value) FILTER (key = privacy_type),
       arg_min(value, ord) FILTER (contains(lower(privacy_type), lower(key)) OR contains(lower(key), lower(privacy_type))), '其他信息') AS top_category
FROM t CROSS JOIN m GROUP BY t.privacy_type""")
def top_category(spark, sf):
    from pyspark.sql import Window as W
    p = table(spark, sf, "part")
    types = p.select(F.explode(F.array("p_name", F.split_part("p_name", F.lit(" "), F.lit(2)), "p_brand")).alias("privacy_type"))
    keys = p.select(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("key")).unionByName(spark.createDataFrame([("red widget",), ("BRAND#12",)], "key string")).distinct()
    # dictionary order: one row per key, a handful of rows
    m = keys.withColumn("ord", F.row_number().over(W.orderBy("key"))).withColumn("value", F.concat(F.lit("cat"), (F.col("ord") % 5).cast("string")))
    return integrate.top_category(types, m)


# --- hosts, callers, stacks ---------------------------------------------------------------------------

HOST_SQL = """
WITH h AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1) AS host FROM pages),
sdk AS (SELECT * FROM (VALUES (0, 'NetKit', 'NetCo', 'example.net'), (1, 'OrgKit', 'OrgCo', 'example.org'), (2, 'Wide', 'WideCo', 'example'), (3, 'Com', 'ComCo', 'example.com')) v(ord, name, company, domain)),
m AS (SELECT host, arg_min(name, ord) AS sdk_name, arg_min(company, ord) AS company, arg_min(domain, ord) AS domain
      FROM (SELECT DISTINCT host FROM h) JOIN sdk ON contains(lower(host), domain) GROUP BY host)
"""


def page_hosts(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", host_from_url(F.col("url")).alias("host"))


def host_dictionary(spark) -> DataFrame:
    rows = [(0, "NetKit", "NetCo", "a", ["net.example"], ["example.net"]), (1, "OrgKit", "OrgCo", "b", ["org.example", "org.example.th"], ["example.org"]),
            (2, "Wide", "WideCo", "c", ["org", "net.example.an"], ["example"]), (3, "Com", "ComCo", "d", ["com.example", "com.example.the"], ["example.com"])]
    return spark.createDataFrame(rows, "ord int, name string, company string, category string, packages array<string>, domains array<string>")


@query("host_sdk_attribution", HOST_SQL + """
SELECT h.page_id, h.host, sdk_name, company, domain, (contains(h.host, '.') AND NOT contains(h.host, '/')) AS real_host,
       contains(h.host, 'example') AS internal_host
FROM h LEFT JOIN m ON h.host = m.host""")
def host_sdk_attribution(spark, sf):
    h = page_hosts(spark, sf)
    m = leaks.host_sdk(h, host_dictionary(spark)).drop("category")
    return h.join(m, "host", "left").withColumn("real_host", S.is_real_host("host")).withColumn("internal_host", S.is_internal_host("host", F.lit("com.example.app")))


@query("host_owner", HOST_SQL + """
, ph AS (SELECT DISTINCT 'com.' || CASE page_id % 3 WHEN 0 THEN 'ththth' WHEN 1 THEN 'anand' ELSE 'qq' END || '.app' AS package,
                CASE WHEN page_id % 5 = 0 THEN replace(host, 'example.net', 'qq.com') ELSE host END AS host FROM h),
o AS (SELECT package, host, contains(host, split_part(package, '.', 2)) AND length(split_part(package, '.', 2)) > 2 AS own FROM ph),
d AS (SELECT o.package, o.host, own, arg_min(name, ord) AS sdk_name, arg_min(company, ord) AS company
      FROM o LEFT JOIN sdk ON contains(lower(o.host), domain) GROUP BY 1, 2, 3)
SELECT package, host, NOT own AND (sdk_name IS NOT NULL OR host LIKE '%.qq.com') AS is_third_party,
       CASE WHEN own THEN '' ELSE coalesce(sdk_name, CASE WHEN host LIKE '%.qq.com' THEN '腾讯SDK' ELSE '' END) END AS sdk_name,
       CASE WHEN own THEN '' ELSE coalesce(company, CASE WHEN host LIKE '%.qq.com' THEN '腾讯' ELSE '' END) END AS sdk_company FROM d""")
def host_owner(spark, sf):
    h = page_hosts(spark, sf)
    mid = F.when(F.col("page_id") % 3 == 0, "ththth").when(F.col("page_id") % 3 == 1, "anand").otherwise("qq")
    ph = h.select(F.concat(F.lit("com."), mid, F.lit(".app")).alias("package"),
                  F.when(F.col("page_id") % 5 == 0, F.replace("host", F.lit("example.net"), F.lit("qq.com"))).otherwise(F.col("host")).alias("host"))
    return leaks.host_owner(ph, host_dictionary(spark))


REVERSED_SQL = """
, r AS (SELECT page_id, array_to_string(list_reverse(string_split(host, '.')), '.') AS cls FROM h),
pre AS (SELECT * FROM (VALUES (0, 'NetKit', 'net.example'), (1, 'OrgKit', 'org.example'), (1, 'OrgKit', 'org.example.th'), (2, 'Wide', 'org'), (2, 'Wide', 'net.example.an'), (3, 'Com', 'com.example'), (3, 'Com', 'com.example.the')) v(ord, name, prefix))
"""


def reversed_classes(spark, sf) -> DataFrame:
    return page_hosts(spark, sf).select("page_id", F.array_join(F.reverse(F.split("host", r"\.")), ".").alias("cls"))


@query("caller_sdk_longest_prefix", HOST_SQL + REVERSED_SQL + """
, best AS (SELECT cls, arg_max(name, length(prefix)) AS name, arg_max(prefix, length(prefix)) AS prefix FROM (SELECT DISTINCT cls FROM r) JOIN pre ON starts_with(cls, prefix) GROUP BY cls)
SELECT r.page_id, r.cls AS caller, coalesce(name, '应用自身业务') AS sdk_name, prefix AS match_prefix FROM r LEFT JOIN best ON r.cls = best.cls""")
def caller_sdk_longest_prefix(spark, sf):
    calls = reversed_classes(spark, sf).withColumn("called_from", F.concat("cls", F.lit(".m(SourceFile:23)")))
    calls = calls.withColumn("caller", S.caller_class("called_from"))
    own = leaks.caller_sdk(calls, host_dictionary(spark), "caller").select("caller", "sdk_name", "match_prefix")
    return calls.select("page_id", "caller").join(own, "caller", "left")


@query("stack_sdk", HOST_SQL + REVERSED_SQL + """
, f AS (SELECT page_id, 0 AS frame, 'app.main' || page_id AS cls FROM r UNION ALL SELECT page_id, 1, cls FROM r UNION ALL SELECT page_id, 2, 'com.example.then' FROM r),
hit AS (SELECT page_id, frame, name, prefix, row_number() OVER (PARTITION BY page_id ORDER BY frame, ord, prefix) AS rn FROM f JOIN pre ON starts_with(cls, prefix))
SELECT page_id, name, prefix FROM hit WHERE rn = 1""")
def stack_sdk(spark, sf):
    r = reversed_classes(spark, sf)
    stack = F.concat(F.lit("at app.main"), F.col("page_id").cast("string"), F.lit(".run(A.java:1)\n  at "), F.col("cls"), F.lit(".go(B.java:2)\n  at com.example.then.x(C.java:3)"))
    calls = r.select("page_id", S.stack_classes(stack).alias("classes"))
    return leaks.stack_sdk(calls, host_dictionary(spark), "page_id", "classes").select("page_id", "name", "prefix")


# --- categories ---------------------------------------------------------------------------------------

CATEGORY_SQL = """
WITH fc AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS field, min(p_type) AS level1, CASE WHEN min(p_partkey) % 3 = 0 THEN NULL ELSE min(p_brand) END AS level2
            FROM part GROUP BY 1),
f AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || '-word' WHEN 1 THEN p_name || '-token' ELSE p_name END AS field, p_name FROM part)
"""


def field_categories(spark, sf) -> DataFrame:
    # names of odd parts stand in capitals and match nothing
    g = table(spark, sf, "part").groupBy(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("field")).agg(
        F.min("p_type").alias("level1"), F.min("p_brand").alias("_b"), F.min("p_partkey").alias("_k"))
    return g.select("field", "level1", F.when(F.col("_k") % 3 != 0, F.col("_b")).alias("level2"))


@query("field_category_map", CATEGORY_SQL + """
SELECT p_name AS privacy_field, coalesce(level1, '其他信息') AS category_level1,
       CASE WHEN level1 IS NULL THEN '未分类' ELSE coalesce(level2, level1) END AS category_level2, count(*) AS n
FROM f LEFT JOIN fc ON f.p_name = fc.field GROUP BY ALL""")
def field_category_map(spark, sf):
    f = table(spark, sf, "part").select(F.col("p_name").alias("privacy_field"))
    return leaks.with_field_category(f, field_categories(spark, sf)).groupBy("privacy_field", "category_level1", "category_level2").agg(F.count("*").alias("n"))


@query("field_info", CATEGORY_SQL + """
, k AS (SELECT * FROM fc WHERE level2 IS NOT NULL)
SELECT f.p_partkey, f.field, coalesce(a.level1, b.level1, '其他信息') AS category, coalesce(a.level2, b.level2, f.field) AS standard_name
FROM f LEFT JOIN k a ON a.field = f.field LEFT JOIN k b ON b.field = f.p_name""")
def field_info(spark, sf):
    k = F.col("p_partkey") % 3
    suffix = F.when(k == 0, "-word").when(k == 1, "-token").otherwise("")
    f = table(spark, sf, "part").select("p_partkey", F.concat("p_name", suffix).alias("field"))
    return leaks.field_info(f, field_categories(spark, sf), "field")


@query("standard_field", """
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CASE event_type WHEN 'click' THEN 'IMEI' ELSE 'Android ID' END ELSE event_type || '-word' END AS item
FROM events""")
def standard_field(spark, sf):
    e = F.col("event_type")
    raw = F.when(e == "click", " imei-WORD ").when(e == "view", "android_id-token").otherwise(F.concat(e, F.lit("-word")))
    return table(spark, sf, "events").select("event_id", S.standard_field(raw).alias("item"))


# --- detection ----------------------------------------------------------------------------------------

@query("leak_value_detect", """
SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def leak_value_detect(spark, sf):
    docs, values = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"), table(spark, sf, "benchmark")
    return joins.text_contains(docs, "doc_id", "text", values.withColumnRenamed("text", "value"), "item_id", "value")


KEYWORDS = ["token", "license", "email", "secret", "password", "api_key"]


@query("leak_keyword_detect", f"""
SELECT source AS package, doc_id AS leaf_id, k || '-word' AS privacy_field,
       CASE WHEN length(text) > 200 THEN left(text, 197) || '...' ELSE text END AS value_preview
FROM documents CROSS JOIN (SELECT unnest([{quoted(KEYWORDS)}]) AS k) WHERE contains(lower(text), k)""")
def leak_keyword_detect(spark, sf):
    docs = spread(table(spark, sf, "documents"), "doc_id").select(F.col("source").alias("package"), F.col("doc_id").alias("leaf_id"), F.col("text").alias("leaf"))
    values = docs.select("package").distinct().select("package", F.explode(F.array(*[F.lit(k) for k in KEYWORDS])).alias("value")) \
        .select("package", F.concat("value", F.lit("-word")).alias("field"), "value", F.lit(True).alias("is_keyword"))
    return leaks.detect_keywords(docs, values, preview=200).select("package", "leaf_id", "privacy_field", "value_preview")


VARIANTS_SQL = """
v AS (
  SELECT item_id, text AS value, unnest(['normal', 'capitalize', 'upper', 'lower', 'hexCapitalize', 'hexUpper', 'hexLower', 'UpperHexUpper', 'UpperHexLower',
                                         'urlUpper', 'urlLower', 'base64', 'md5hex', 'sha1hex', 'sha256hex']) AS encode_type FROM val),
enc AS (
  SELECT item_id, encode_type, CASE encode_type
    WHEN 'normal' THEN value WHEN 'capitalize' THEN upper(left(value, 1)) || lower(substr(value, 2)) WHEN 'upper' THEN upper(replace(value, 'ß', 'ss')) WHEN 'lower' THEN lower(value)
    WHEN 'hexCapitalize' THEN lower(hex(upper(left(value, 1)) || lower(substr(value, 2)))) WHEN 'hexUpper' THEN lower(hex(upper(replace(value, 'ß', 'ss')))) WHEN 'hexLower' THEN lower(hex(lower(value)))
    WHEN 'UpperHexUpper' THEN upper(hex(upper(replace(value, 'ß', 'ss')))) WHEN 'UpperHexLower' THEN upper(hex(lower(value)))
    WHEN 'urlUpper' THEN replace(url_encode(upper(replace(value, 'ß', 'ss'))), '%20', '+') WHEN 'urlLower' THEN replace(url_encode(lower(value)), '%20', '+')
    WHEN 'base64' THEN left(base64(encode(value)), length(base64(encode(value))) - 4)
    WHEN 'md5hex' THEN md5(value) WHEN 'sha1hex' THEN sha1(value) ELSE sha256(value) END AS coded FROM v)
"""
TEXT_ENCODINGS = ["normal", "capitalize", "upper", "lower", "hexCapitalize", "hexUpper", "hexLower", "UpperHexUpper", "UpperHexLower", "urlUpper", "urlLower", "base64",
                  "md5hex", "sha1hex", "sha256hex"]


@query("encoding_fanout", f"WITH val AS (SELECT * FROM benchmark), {VARIANTS_SQL} SELECT item_id, encode_type, coded FROM enc UNION ALL SELECT item_id, unnest(['md5', 'sha1', 'sha256']), unnest([md5(text), sha1(text), sha256(text)]) FROM benchmark")
def encoding_fanout(spark, sf):
    v = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("value"), F.lit(False).alias("is_keyword"))
    coded = F.when(F.col("encode_type").isin(*TEXT_ENCODINGS), F.decode("encoded", "UTF-8")).otherwise(F.lower(F.hex("encoded")))
    return P.encoding_fanout(v).select("item_id", "encode_type", coded.alias("coded"))


@query("leak_encoded_detect", f"""
WITH val AS (SELECT item_id, text FROM benchmark), {VARIANTS_SQL},
leaf AS (SELECT item_id AS leaf_id, item_id % 5 AS package, 'k=' || coded || '&z' AS leaf FROM enc
         WHERE encode_type = list_extract([{quoted(TEXT_ENCODINGS)}], (item_id % 15)::INT + 1))
SELECT leaf.package, leaf_id, 'item' || enc.item_id AS privacy_field, encode_type FROM leaf JOIN enc ON enc.item_id % 5 = leaf.package AND contains(leaf, coded)""")
def leak_encoded_detect(spark, sf):
    b = table(spark, sf, "benchmark")
    values = b.select((F.col("item_id") % 5).alias("package"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("field"), F.col("text").alias("value"), F.lit(False).alias("is_keyword"))
    kinds = F.array(*[F.lit(k) for k in TEXT_ENCODINGS])
    coded = F.element_at(P.encoded_variants("text"), F.element_at(kinds, (F.col("item_id") % 15).cast("int") + 1))
    leaf = b.select((F.col("item_id") % 5).alias("package"), F.col("item_id").alias("leaf_id"), F.concat(F.lit("k="), F.decode(coded, "UTF-8"), F.lit("&z")).alias("leaf"))
    return leaks.detect_values(leaf, values).filter(F.col("encode_type").isin(*TEXT_ENCODINGS)).select("package", "leaf_id", "privacy_field", "encode_type")


@query("token_propagation", """
WITH w AS (SELECT conv_id, unnest(regexp_extract_all(text, '[a-zA-Z]{8,}')) AS token, turn FROM conversations WHERE role = 'user'),
c AS (SELECT conv_id, token, min(turn) AS captured_seq FROM w GROUP BY 1, 2)
SELECT a.conv_id AS package, a.turn AS seq, token AS value_preview, captured_seq, 'token-token' AS privacy_field
FROM conversations a JOIN c ON a.conv_id = c.conv_id AND a.turn >= captured_seq AND contains(a.text, token) WHERE a.role = 'assistant'""")
def token_propagation(spark, sf):
    t = table(spark, sf, "conversations").select(F.col("conv_id").alias("package"), F.col("turn").alias("seq"), "role", F.col("text").alias("leaf"))
    words = t.filter("role = 'user'").select("package", "seq", F.explode(F.regexp_extract_all("leaf", F.lit("[a-zA-Z]{8,}"), F.lit(0))).alias("leaf"))
    hits = words.withColumn("privacy_field", F.lit("token-word")).withColumn("source", F.lit("chat"))
    out = t.filter("role = 'assistant'").select("package", "seq", "leaf", F.lit(">").alias("direction"), F.lit("chat").alias("source"), F.xxhash64("package", "seq").alias("leaf_id"))
    return leaks.propagate_tokens(hits, out).select("package", "seq", "value_preview", "captured_seq", "privacy_field")


RISK_FIELDS = {"token": "登录凭证", "license": "应用信息", "email": "个人信息", "secret": "登录凭证", "password": "个人信息", "api_key": "登录凭证"}


@query("sensitive_text_risk", f"""
WITH hit AS (
  SELECT source, doc_id, k AS field FROM documents CROSS JOIN (SELECT unnest([{quoted(KEYWORDS)}]) AS k) WHERE contains(lower(text), k)
  UNION ALL SELECT source, doc_id, 'passage' FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
lv AS (SELECT source, doc_id, CASE field {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in RISK_FIELDS.items())} ELSE '其他信息' END AS category,
       CASE WHEN {_like_any('field', D.HIGH_RISK_WORDS)} THEN 'high' WHEN {_like_any('field', D.MEDIUM_RISK_WORDS)} THEN 'high' ELSE 'medium' END AS risk_level FROM hit)
SELECT source, category, risk_level, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM lv GROUP BY ALL""")
def sensitive_text_risk(spark, sf):
    """Keywords and known passages in whole documents, mapped to categories and to a risk level as plain outbound data."""
    docs = spread(table(spark, sf, "documents").select("source", "doc_id", "text"), "doc_id")
    low = F.lower("text")
    # the keyword list is a constant, so it is tested inside one scan
    kw = docs.select("source", "doc_id", F.explode(F.array_compact(F.array(*[F.when(low.contains(k), k) for k in KEYWORDS]))).alias("field"))
    b = table(spark, sf, "benchmark").withColumnRenamed("text", "value")
    passages = joins.text_contains(docs, "doc_id", "text", b, "item_id", "value", keep=["source"]).select("source", "doc_id", F.lit("passage").alias("field"))
    hits = kw.unionByName(passages).withColumn("category", leaks.field_group(RISK_FIELDS, "field"))
    hits = hits.withColumn("risk_level", integrate.risk_level(F.col("field"), F.lit(1), F.lit(1)))
    return hits.groupBy("source", "category", "risk_level").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))
