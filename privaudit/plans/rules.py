"""Compliance rules and violations on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit import dictionaries as D
from privaudit.operators import rules, violations
from privaudit.plans.leaks import quoted
from privaudit.plans.registry import query
from privaudit.session import spread, stored, table

# --- label rules ------------------------------------------------------------------------------------
# package = supplier; part types and brands stand for clause labels by name, code or dotted id

LABEL_NAMES = ["处理者", "身份", "C1 个人信息收集与使用", "处理的个人信息类别", "4.2", "个人信息分享", "E1 数据主体权利", "获取权", "修改权", "6.4", "撤回同意权", "6.1.1",
               "投诉", "I1 数据存储细节", "存储时长", "I3.1 存储地点", "个人信息安全", "其他"]
LABELS_SQL = f"""
WITH l AS (SELECT DISTINCT l_suppkey AS package, list_extract([{quoted(LABEL_NAMES)}], ((l_suppkey * (l_linenumber % 3 + 1) + l_linenumber) % 18)::INT + 1) AS label FROM lineitem),
d AS (SELECT * FROM (VALUES {', '.join(f"('{i}', '{c}')" for c, i in D.CLAUSE_CODES)}) v(id, code)),
p AS (SELECT package, label, coalesce(nullif(regexp_extract(upper(label), '\\b([A-Z][0-9]+(\\.[0-9]+)?)\\b', 1), ''), d.code) AS code FROM l LEFT JOIN d ON l.label = d.id),
s AS (SELECT s_suppkey AS package FROM supplier),
"""


def _has(code, names):
    return f"coalesce(bool_or(code = '{code}' OR starts_with(code, '{code}.') OR label IN ({quoted(names)})), false)"


def _label_rules_sql():
    mods = ", ".join(f"{_has(c, t)} AS m_{c}" for c, t in D.MODULE_PROXIES.items())
    singles = {"C2": "处理的个人信息类别", "C4": "个人信息来源", "E3": "政策更新", **D.STORAGE_PARTS, **D.CORE_RIGHTS}
    tests = ", ".join(f"{_has(c, [t])} AS t_{c}" for c, t in singles.items())
    miss = lambda pre, codes: "concat_ws(', ', " + ", ".join(f"CASE WHEN NOT {pre}{c} THEN '{c}' END" for c in codes) + ")"
    return LABELS_SQL + f"""
t AS (SELECT s.package, {mods}, {tests}, {_has('I1', D.STORAGE_PROXIES)} AS storage, {_has('E1', D.RIGHTS_PROXIES)} AS rights FROM s LEFT JOIN p ON s.package = p.package GROUP BY 1),
r AS (SELECT package, 'R1' AS rule_id, {miss('m_', D.MODULE_PROXIES)} <> '' AS violated, {miss('m_', D.MODULE_PROXIES)} AS why FROM t
  UNION ALL SELECT package, 'R2', t_C2 AND NOT t_C4, 'C4' FROM t
  UNION ALL SELECT package, 'R3', storage AND {miss('t_', D.STORAGE_PARTS)} <> '', {miss('t_', D.STORAGE_PARTS)} FROM t
  UNION ALL SELECT package, 'R4', rights AND {miss('t_', D.CORE_RIGHTS)} <> '', {miss('t_', D.CORE_RIGHTS)} FROM t
  UNION ALL SELECT package, 'R5', NOT t_E3, 'E3' FROM t),
lr AS (SELECT package, rule_id, violated, CASE WHEN violated THEN why ELSE '' END AS reason FROM r)
"""


LABEL_RULES_SQL = _label_rules_sql()


def label_rows(spark, sf) -> DataFrame:
    names = F.array(*[F.lit(n) for n in LABEL_NAMES])
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber")
    at = (F.col("l_suppkey") * (F.col("l_linenumber") % 3 + 1) + F.col("l_linenumber")) % 18
    return rules.policy_labels(li.select(F.col("l_suppkey").alias("package"), F.element_at(names, at.cast("int") + 1).alias("label")))


def packages(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("package"))


@query("rule_labels", LABEL_RULES_SQL + "SELECT * FROM lr")
def rule_labels(spark, sf):
    return rules.label_rules(label_rows(spark, sf), packages(spark, sf))


# --- consent ----------------------------------------------------------------------------------------

@query("consent_gate", """
WITH f AS (SELECT user_id, min(ts) FILTER (event_type = 'signup') AS c FROM events GROUP BY 1),
e AS (SELECT e.user_id, count(*) AS n_early, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS apis FROM events e JOIN f USING (user_id) WHERE e.ts < c AND event_type <> 'signup' GROUP BY 1)
SELECT f.user_id AS package, coalesce(n_early, 0) AS n_early, coalesce(apis, '') AS apis, CASE WHEN c IS NOT NULL THEN n_early IS NOT NULL END AS violated FROM f LEFT JOIN e USING (user_id)""")
def consent_gate(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("package"), "ts", F.col("event_type").alias("api"))
    return rules.events_before_consent(ev, F.col("api") == "signup").withColumn("apis", F.array_join("apis", ","))


GATE_SQL = """
WITH u AS (SELECT user_id AS package, event_id, event_type, value, props FROM events),
g AS (SELECT package, string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (value > 95) AS items FROM u WHERE package % 5 = 0 GROUP BY 1),
x AS (SELECT package, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM u WHERE package % 5 IN (0, 1) AND value > 90 GROUP BY 1),
m AS (SELECT package, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM u WHERE package % 5 = 2 AND value > 92 GROUP BY 1),
a AS (SELECT package, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS items FROM u GROUP BY 1)
SELECT a.package, CASE WHEN g.package IS NOT NULL THEN 'gate' WHEN x.package IS NOT NULL THEN 'explicit' WHEN m.package IS NOT NULL THEN 'record' WHEN a.package % 5 = 3 THEN 'run' END AS evidence,
       CASE WHEN g.package IS NOT NULL THEN coalesce(g.items, '') WHEN x.package IS NOT NULL THEN x.items WHEN m.package IS NOT NULL THEN m.items
            WHEN a.package % 5 = 3 THEN CASE WHEN a.package % 2 = 0 THEN a.items ELSE '' END END AS items
FROM a LEFT JOIN g USING (package) LEFT JOIN x USING (package) LEFT JOIN m USING (package)"""


@query("pre_consent_evidence", GATE_SQL)
def pre_consent_evidence(spark, sf):
    """The four kinds of consent evidence in their order of precedence, by user."""
    u = table(spark, sf, "events").select(F.col("user_id").alias("package"), F.col("event_type").alias("item"), "value")
    p5 = F.col("package") % 5
    gate = u.filter(p5 == 0).select("package", F.when(F.col("value") > 95, F.col("item")).alias("item")).distinct()
    explicit = u.filter(p5.isin(0, 1) & (F.col("value") > 90)).select("package", "item").distinct()
    # records of one kind of package carry a phase, a flag or a refusal; runs of another their phase
    v = F.when(p5 == 2, F.col("value"))
    flagged = rules.record_before_consent(F.when(v > 97, "Startup").when(v > 96, "pre_consent").otherwise("running"), before_consent=(v > 95) & (v <= 96), pre_consent=(v > 94) & (v <= 95),
                                          consent_granted=~((v > 92) & (v <= 94)))
    acc = u.select("package", "item", flagged.alias("flagged")).distinct()
    none = F.lit(None).cast("boolean")
    phase = F.when(p5 == 3, F.when(F.col("package") % 2 == 0, "before_agree").otherwise("startup"))
    run = u.select("package").distinct().withColumn("before_consent", rules.run_before_consent(phase, none, none))
    r = rules.pre_consent(u, gate, explicit, acc, run)
    return r.select("package", "evidence", F.array_join("items", ",").alias("items"))


@query("gate_candidates", """
WITH d AS (SELECT CASE event_id % 3 WHEN 0 THEN 'pkg' || user_id WHEN 1 THEN 'app' || user_id ELSE 'other' END AS name, event_id, event_type, user_id FROM events),
a AS (SELECT DISTINCT user_id AS app_id, CASE user_id % 4 WHEN 0 THEN 'pkg' || user_id WHEN 1 THEN 'unknown' ELSE '' END AS n1, 'app' || user_id AS n2 FROM events),
c AS (SELECT app_id, 0 AS rank, n1 AS name FROM a WHERE n1 NOT IN ('', 'unknown') UNION ALL SELECT app_id, 1, n2 FROM a),
b AS (SELECT app_id, arg_min(c.name, rank) AS name FROM c JOIN (SELECT DISTINCT name FROM d) k ON c.name = k.name GROUP BY 1)
SELECT b.app_id, b.name, count(*) AS n, count(DISTINCT event_type) AS apis FROM b JOIN d ON b.name = d.name GROUP BY 1, 2""")
def gate_candidates(spark, sf):
    ev = table(spark, sf, "events")
    k, u = F.col("event_id") % 3, F.col("user_id").cast("string")
    name = F.when(k == 0, F.concat(F.lit("pkg"), u)).when(k == 1, F.concat(F.lit("app"), u)).otherwise("other")
    dumps = ev.select(name.alias("name"), F.col("event_id").cast("string").alias("file"), F.array("event_type").alias("pre_click_apis"))
    n1 = F.when(F.col("user_id") % 4 == 0, F.concat(F.lit("pkg"), u)).when(F.col("user_id") % 4 == 1, "unknown").otherwise("")
    apps = ev.select(F.col("user_id").alias("app_id"), n1.alias("package_name"), F.concat(F.lit("app"), u).alias("package"), F.lit(None).cast("string").alias("app_name")).distinct()
    return rules.gate_evidence(dumps, apps).groupBy("app_id", "name").agg(F.count("*").alias("n"), F.countDistinct("item").alias("apis"))


# --- disclosure -------------------------------------------------------------------------------------
# package = document source; benchmark items act as the SDKs of a source, named by their first two words

UND_SQL = """
WITH x AS (SELECT DISTINCT 'src' || (item_id % 20) AS package, split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS name, 'Co' || item_id AS company FROM benchmark),
sh AS (SELECT DISTINCT source AS package, length(source) % 2 = 0 AS ok FROM documents),
h AS (SELECT DISTINCT package, name FROM documents JOIN x ON source = package AND (contains(lower(text), lower(name)) OR contains(lower(text), lower(company))))
"""


@query("undisclosed_sdk", UND_SQL + """
SELECT DISTINCT x.package, x.name AS sdk FROM x LEFT JOIN sh ON x.package = sh.package LEFT JOIN h ON h.package = x.package AND h.name = x.name WHERE NOT coalesce(sh.ok, false) OR h.name IS NULL""")
def undisclosed_sdk(spark, sf):
    docs = spread(table(spark, sf, "documents").select("source", "doc_id", "text"), "doc_id").select(F.col("source").alias("package"), F.col("doc_id").alias("piece_id"), F.lower("text").alias("piece"))
    two = F.concat_ws(" ", F.split_part("text", F.lit(" "), F.lit(1)), F.split_part("text", F.lit(" "), F.lit(2)))
    sdks = table(spark, sf, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("package"), two.alias("name"), F.concat(F.lit("Co"), F.col("item_id").cast("string")).alias("company"))
    sharing = table(spark, sf, "documents").select(F.col("source").alias("package")).distinct().withColumn("sharing_declared", F.length("package") % 2 == 0)
    return rules.undisclosed_sdks(sdks, docs, sharing)


BROAD_SQL = """
WITH tx AS (SELECT DISTINCT p_type AS parent, p_name AS child FROM part),
acc AS (SELECT DISTINCT s_nationkey AS package, p_name AS item, p_type AS category FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
dec AS (SELECT DISTINCT (p_partkey % 25)::INT AS package, CASE WHEN p_partkey % 2 = 0 THEN upper(p_type) ELSE 'our ' || p_name || 's' END AS value FROM part),
op AS (SELECT * FROM acc WHERE NOT EXISTS (SELECT 1 FROM dec WHERE dec.package = acc.package AND contains(lower(value), lower(item)))),
ct AS (SELECT package, item, category AS c FROM op UNION SELECT package, item, parent FROM op JOIN tx ON lower(item) = lower(child)),
br AS (SELECT ct.package, item, min(c) AS broad FROM ct JOIN dec ON dec.package = ct.package AND lower(c) = lower(value) GROUP BY 1, 2)
"""


def broad_inputs(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey")
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("package"))
    j = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    acc = j.select("package", F.col("p_name").alias("item"), F.col("p_type").alias("category")).distinct()
    value = F.when(F.col("p_partkey") % 2 == 0, F.upper("p_type")).otherwise(F.concat(F.lit("our "), "p_name", F.lit("s")))
    dec = p.select((F.col("p_partkey") % 25).cast("int").alias("package"), value.alias("value")).distinct()
    tx = p.select(F.col("p_type").alias("parent"), F.col("p_name").alias("child")).distinct()
    return acc, dec, tx


@query("broad_only", BROAD_SQL + "SELECT * FROM br")
def broad_only(spark, sf):
    return rules.broad_only(*broad_inputs(spark, sf))


@query("sdk_company", """
WITH s AS (SELECT n_nationkey AS ord, lower(replace(n_name, '_', ' kit ')) AS name, 'Co' || n_regionkey AS company FROM nation),
n AS (SELECT DISTINCT CASE s_suppkey % 3 WHEN 0 THEN 'Nation Kit ' || s_nationkey WHEN 1 THEN 'kit ' || s_nationkey ELSE s_name END AS name FROM supplier)
SELECT n.name, coalesce(arg_min(company, ord), '') AS company FROM n LEFT JOIN s ON contains(s.name, lower(n.name)) OR contains(lower(n.name), s.name) GROUP BY 1""")
def sdk_company(spark, sf):
    k, n = F.col("s_suppkey") % 3, F.col("s_nationkey").cast("string")
    names = table(spark, sf, "supplier").select(F.when(k == 0, F.concat(F.lit("Nation Kit "), n)).when(k == 1, F.concat(F.lit("kit "), n)).otherwise(F.col("s_name")).alias("name"))
    sdk = table(spark, sf, "nation").select(F.col("n_nationkey").alias("ord"), F.replace("n_name", F.lit("_"), F.lit(" kit ")).alias("name"), F.concat(F.lit("Co"), F.col("n_regionkey").cast("string")).alias("company"))
    return rules.sdk_company(names, sdk)


# --- behaviour --------------------------------------------------------------------------------------

@query("unique_accesses", """
SELECT package, item, category, source, sdk_name, seq FROM (
  SELECT user_id AS package, event_type AS item, 'c' || (event_id % 2) AS category, 'h' || (event_id % 3) AS source, '' AS sdk_name, event_id AS seq,
         row_number() OVER (PARTITION BY user_id, event_type, event_id % 2, event_id % 3 ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1""")
def unique_accesses(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("user_id").alias("package"), F.col("event_type").alias("item"), F.concat(F.lit("c"), (F.col("event_id") % 2).cast("string")).alias("category"),
        F.concat(F.lit("h"), (F.col("event_id") % 3).cast("string")).alias("source"), F.lit("").alias("sdk_name"), F.col("event_id").alias("seq"))
    return rules.unique_accesses(e)


@query("unique_sdks", """
WITH s AS (SELECT user_id AS package, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN '' ELSE 'sdk' || (event_id % 5) END AS name, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'co' || (event_id % 7) END AS company, event_type FROM events),
k AS (SELECT *, coalesce(nullif(name, ''), nullif(company, '')) AS sdk_key FROM s)
SELECT package, sdk_key, coalesce(arg_min(company, seq) FILTER (company <> ''), '') AS company, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS fields FROM k WHERE sdk_key IS NOT NULL GROUP BY 1, 2""")
def unique_sdks(spark, sf):
    k = F.col("event_id")
    s = table(spark, sf, "events").select(
        F.col("user_id").alias("package"), k.alias("seq"), F.when(k % 4 == 0, "").otherwise(F.concat(F.lit("sdk"), (k % 5).cast("string"))).alias("name"),
        F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("co"), (k % 7).cast("string"))).alias("company"), F.array("event_type").alias("fields"))
    return rules.unique_sdks(s).select("package", "sdk_key", "company", F.array_join("fields", ",").alias("fields"))


@query("behaviour_evidence", """
WITH r AS (SELECT user_id AS package, CASE event_type WHEN 'click' THEN 'IMEI' ELSE event_type END AS item, event_id % 3 = 0 AS third FROM events WHERE user_id % 3 <> 0),
a AS (SELECT user_id AS package, 'api_' || event_type AS item, event_id % 2 = 0 AS third FROM events),
f AS (SELECT DISTINCT user_id AS package, event_type AS item, false AS third FROM events WHERE user_id % 3 = 0)
SELECT package, item, count(*) AS n, count(*) FILTER (third) AS n_third FROM (SELECT * FROM r UNION ALL SELECT * FROM a UNION ALL SELECT * FROM f) GROUP BY 1, 2""")
def behaviour_evidence(spark, sf):
    """Records, API entities and the fallback to category summaries for packages without records."""
    ev = table(spark, sf, "events")
    third = F.col("event_id") % 3 == 0
    rec = ev.filter("user_id % 3 <> 0").select(
        F.col("user_id").alias("package"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "imei-word").otherwise(F.col("event_type")).alias("privacy_field"),
        F.lit("c").alias("category_level1"), F.lit("h").alias("host"), F.lit("http").alias("source"),
        F.struct(F.when(third, "s").otherwise("").alias("name"), F.lit("").alias("company"), third.alias("is_third_party")).alias("sdk"))
    api = ev.select(F.col("user_id").alias("package"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 2 == 0, "Third-Party").otherwise("App-Owned").alias("entity_type"),
                    F.lit("e").alias("entity_name"), F.lit("c").alias("category"), F.concat(F.lit("api_"), "event_type").alias("privacy_type"), F.lit("co").alias("company"))
    fields = ev.select(F.col("user_id").alias("package"), F.col("event_type").alias("field"), F.lit("c").alias("category")).distinct()
    acc, _ = rules.behaviour(rec, api, fields)
    return acc.groupBy("package", "item").agg(F.count("*").alias("n"), F.count_if("third_party").alias("n_third"))


@query("policy_evidence", """
WITH w AS (SELECT conv_id AS package, turn, regexp_extract_all(text, '[a-zA-Z]{6,}') AS ws FROM conversations),
e AS (SELECT package, ['controller', 'collection', 'data', 'sharing', 'purpose', 'receiver', 'condition', 'Data'][((i - 1) % 8) + 1] AS label, ws[i] AS word FROM w, range(1, len(ws) + 1) g(i))
SELECT package, lower(label) AS kind, count(DISTINCT word) AS n FROM e WHERE lower(label) IN ('controller', 'data', 'receiver') GROUP BY 1, 2""")
def policy_evidence(spark, sf):
    from privaudit.plans.text import entity_sentences
    s = entity_sentences(spark, sf).withColumnRenamed("doc_id", "package")
    return rules.policy_entities(s).groupBy("package", "kind").agg(F.count("*").alias("n"))


# --- verdicts ---------------------------------------------------------------------------------------

VERDICT_SQL = LABEL_RULES_SQL + """
, bw AS (SELECT s_suppkey, s_nationkey FROM supplier),
cons AS (SELECT s_suppkey AS package, CASE s_suppkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'imei' END AS items FROM supplier),
acc AS (SELECT DISTINCT l_suppkey * 2 AS package, l_returnflag AS item FROM lineitem),
und AS (SELECT DISTINCT l_suppkey * 3 AS package, 'sdk' || l_linenumber AS sdk FROM lineitem WHERE l_suppkey * 3 IN (SELECT s_suppkey FROM supplier)),
br AS (SELECT DISTINCT l_suppkey * 5 AS package, 'b' || l_linestatus || ' -> ' || l_returnflag AS m FROM lineitem WHERE l_suppkey * 5 IN (SELECT s_suppkey FROM supplier)),
dec AS (SELECT s_suppkey AS package FROM supplier WHERE s_suppkey % 4 <> 0),
ru AS (SELECT package, string_agg(sdk, ', ' ORDER BY sdk) AS reason FROM und GROUP BY 1), rb AS (SELECT package, string_agg(m, ', ' ORDER BY m) AS reason FROM br GROUP BY 1),
v AS (SELECT * FROM lr
  UNION ALL SELECT package, 'R6', CASE WHEN items IS NOT NULL THEN items <> '' END, coalesce(items, '') FROM cons
  UNION ALL SELECT s.package, 'R7', CASE WHEN ru.package IS NOT NULL THEN true WHEN s.package IN (SELECT package FROM acc) THEN false END, coalesce(ru.reason, '') FROM s LEFT JOIN ru ON s.package = ru.package
  UNION ALL SELECT s.package, 'R8', CASE WHEN rb.package IS NOT NULL THEN true WHEN s.package IN (SELECT package FROM acc) AND s.package IN (SELECT package FROM dec) THEN false END, coalesce(rb.reason, '')
            FROM s LEFT JOIN rb ON s.package = rb.package)
"""


def verdict_inputs(spark, sf):
    pk = packages(spark, sf)
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber")
    k = F.col("package") % 3
    consent = pk.select("package", F.when(k == 1, F.array().cast("array<string>")).when(k == 2, F.array(F.lit("imei"))).alias("items"))


    def of(times):
        # only every so manieth package is named, so the others lack it
        return li.withColumn("package", F.col("l_suppkey") * times).join(pk, "package", "left_semi")

    acc = of(2).select("package", F.col("l_returnflag").alias("item")).distinct().select(
        "package", "item", F.lit("c").alias("category"), F.lit("h").alias("source"), F.lit("s").alias("sdk_name"), F.lit(1).alias("seq"))
    und = of(3).select("package", F.concat(F.lit("sdk"), F.col("l_linenumber").cast("string")).alias("sdk")).distinct()
    broad = of(5).select("package", F.col("l_returnflag").alias("item"), F.concat(F.lit("b"), "l_linestatus").alias("broad")).distinct()
    dec = pk.filter("package % 4 <> 0")
    return pk, consent, acc, und, broad, dec


def verdict_rows(spark, sf) -> DataFrame:
    pk, consent, acc, und, broad, dec = verdict_inputs(spark, sf)
    none = und.filter("false").select("package")
    return rules.verdicts(pk, label_rows(spark, sf), consent, none, und, acc, dec, broad)


@query("rule_verdicts", VERDICT_SQL + "SELECT package, rule_id, violated, reason, CASE WHEN violated THEN '违规' WHEN NOT violated THEN '合规' ELSE '证据不足' END AS status FROM v")
def rule_verdicts(spark, sf):
    return verdict_rows(spark, sf).drop("rule_name")


@query("overall_status", VERDICT_SQL + """
SELECT v.package, CASE WHEN bool_or(violated) THEN 'non_compliant' WHEN bool_or(violated IS NULL) THEN 'inconclusive' ELSE 'compliant' END AS overall_status,
       count(*) FILTER (violated) AS n_violations, round((v.package % 101) * 0.4 + (v.package % 97) * 0.6, 1)::DOUBLE AS overall_score FROM v GROUP BY v.package""")
def overall_status(spark, sf):
    scores = packages(spark, sf).select("package", (F.col("package") % 101).alias("policy_score"), (F.col("package") % 97).alias("behaviour_score"))
    return rules.overall(verdict_rows(spark, sf), scores)


@query("rule_review", VERDICT_SQL + """
SELECT package, rule_id, CASE WHEN violated THEN '违规' WHEN NOT violated THEN '合规' ELSE '证据不足' END AS status,
       CASE WHEN violated THEN reason WHEN rule_id = 'R6' AND violated IS NULL THEN '未找到同意页面证据' WHEN rule_id = 'R6' THEN '未检测到同意前访问'
            WHEN rule_id = 'R7' THEN '未检测到未披露的第三方 SDK 处理行为' ELSE '未检测到仅声明大类而实际访问细粒度信息的情况' END AS reason FROM v WHERE rule_id IN ('R6', 'R7', 'R8')""")
def rule_review(spark, sf):
    return rules.review_extract(verdict_rows(spark, sf)).drop("rule_name")


@query("rule_evidence", VERDICT_SQL + """
SELECT package, 'R6' AS rule_id, 'imei' AS item, '' AS detail FROM cons WHERE items = 'imei'
UNION ALL SELECT und.package, 'R7', sdk, CASE WHEN sdk LIKE '%1' THEN 'CoA | a, b' ELSE '- | -' END FROM und
UNION ALL SELECT b.package, 'R8', b.item, concat_ws(' | ', b.broad, CASE WHEN acc.item IS NOT NULL THEN 'c | h | s' END)
FROM (SELECT package, split_part(m, ' -> ', 2) AS item, min(split_part(m, ' -> ', 1)) AS broad FROM br GROUP BY 1, 2) b LEFT JOIN acc ON acc.package = b.package AND acc.item = b.item""")
def rule_evidence(spark, sf):
    pk, consent, acc, und, broad, _ = verdict_inputs(spark, sf)
    sdk = pk.select("package", F.lit("sdk1").alias("sdk_key"), F.lit("CoA").alias("company"), F.array(F.lit("a"), F.lit("b")).alias("fields"))
    return rules.evidence_records(consent, und, sdk, broad.groupBy("package", "item").agg(F.min("broad").alias("broad")), acc)


@query("readiness", """
SELECT s_suppkey AS package, s_suppkey % 2 = 0 AND s_suppkey % 3 = 0 AND s_suppkey % 5 <> 0 AS ready,
       concat_ws('、', CASE WHEN s_suppkey % 2 <> 0 THEN '隐私政策分析' END, CASE WHEN s_suppkey % 3 <> 0 THEN '应用静态分析' END, CASE WHEN s_suppkey % 5 = 0 THEN '动态沙箱分析' END) AS missing_steps FROM supplier""")
def readiness(spark, sf):
    pk = packages(spark, sf)
    return rules.readiness(pk, pk.filter("package % 2 = 0"), pk.filter("package % 3 = 0"), pk.filter("package % 5 <> 0"))


# --- violations -------------------------------------------------------------------------------------
# package = customer nation; collected items = order priorities and part names, declared = phrases

UNDECL_SQL = """
WITH col AS (SELECT c_nationkey AS package, o_orderpriority AS standard_name, CASE o_orderstatus WHEN 'F' THEN '个人信息' WHEN 'O' THEN '应用信息' ELSE 'other' END AS category, count(*) AS n, 'f' || o_orderstatus AS behavior_field
             FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3, 5),
dec AS (SELECT DISTINCT c_nationkey AS package, CASE c_nationkey % 4 WHEN 0 THEN 'our ' || lower(c_mktsegment) || ' and urgent' WHEN 1 THEN '2-high' WHEN 2 THEN c_name || '_specified' ELSE '应用信息' END AS raw FROM customer),
d2 AS (SELECT package, raw, raw AS standard_name FROM dec),
open AS (SELECT * FROM col WHERE NOT EXISTS (SELECT 1 FROM d2 WHERE d2.package = col.package AND (
    contains(lower(raw), lower(col.standard_name)) OR contains(lower(col.standard_name), lower(raw)) OR raw = category
    OR list_has_any(string_split(replace(replace(lower(col.standard_name), '-', ' '), '_', ' '), ' '), string_split(replace(replace(lower(raw), '-', ' '), '_', ' '), ' ')))))
, sv AS (SELECT *, CASE WHEN category = '个人信息' THEN '高' WHEN category = '应用信息' THEN '低' ELSE '中' END AS severity FROM open),
src AS (SELECT * FROM (VALUES ('a.example.com', false, ''), ('b.example.com', true, 'KitB'), ('c.example.com', true, ''), ('d.example.com', false, '')) v(source, third, sdk_name))
"""


def undeclared_inputs(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("package"), "c_mktsegment", "c_name")
    st = F.col("o_orderstatus")
    col = (o.join(c.select("c_custkey", "package"), o.o_custkey == c.c_custkey).groupBy(
        "package", F.col("o_orderpriority").alias("standard_name"), F.when(st == "F", "个人信息").when(st == "O", "应用信息").otherwise("other").alias("category"),
        F.concat(F.lit("f"), st).alias("behavior_field")).agg(F.count("*").alias("n")))
    k = F.col("package") % 4
    raw = (F.when(k == 0, F.concat(F.lit("our "), F.lower("c_mktsegment"), F.lit(" and urgent"))).when(k == 1, "2-high").when(k == 2, F.concat("c_name", F.lit("_specified"))).otherwise("应用信息"))
    dec = c.select("package", raw.alias("raw")).distinct().withColumn("standard_name", F.col("raw"))
    return col, dec


def open_items(spark, sf) -> DataFrame:
    """Collected (item, category) pairs are separate items here, so the category travels in the join key."""
    col, dec = undeclared_inputs(spark, sf)
    col, dec = stored(col, "collected"), stored(dec, "declared")
    keyed = col.withColumn("package", F.struct("package", "category"))
    cats = col.select(F.col("package").alias("p"), "category").distinct()
    dk = dec.join(cats, dec.package == cats.p).select(F.struct("package", "category").alias("package"), "raw", "standard_name")
    return stored(violations.undeclared(keyed, dk).withColumn("package", F.col("package.package")), "open-items")


def sources_of(spark, items: DataFrame) -> DataFrame:
    src = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(t).alias("is_third_party"), F.lit(n).alias("sdk_name")) for s, t, n in
                    (("a.example.com", False, ""), ("b.example.com", True, "KitB"), ("c.example.com", True, ""), ("d.example.com", False, ""))])
    return items.select("package", "standard_name", F.explode(src).alias("s")).select("package", "standard_name", "s.*").distinct()


@query("undeclared_items", UNDECL_SQL + "SELECT package, standard_name, category, n FROM open")
def undeclared_items(spark, sf):
    return open_items(spark, sf).select("package", "standard_name", "category", "n")


@query("app_undeclared", UNDECL_SQL + "SELECT package, standard_name AS data_field, behavior_field, category, 'a.example.com' AS source, n, severity FROM sv")
def app_undeclared(spark, sf):
    o = open_items(spark, sf)
    return violations.app_undeclared(o, sources_of(spark, o)).select("package", "data_field", "behavior_field", "category", "source", "n", "severity")


@query("sdk_undeclared", UNDECL_SQL + "SELECT package, standard_name AS data_field, category, source, coalesce(nullif(sdk_name, ''), source) AS sdk_name, n, severity FROM sv CROSS JOIN src WHERE third")
def sdk_undeclared(spark, sf):
    o = open_items(spark, sf)
    return violations.sdk_undeclared(o, sources_of(spark, o)).select("package", "data_field", "category", "source", "sdk_name", "n", "severity")


VIOL_SQL = UNDECL_SQL + """
, allv AS (SELECT package, 'APP自身违规收集未声明数据' AS violation_type, standard_name AS data_field, severity, category, '' AS sdk_name FROM sv
  UNION ALL SELECT package, 'SDK违规收集未声明数据', standard_name, severity, category, coalesce(nullif(sdk_name, ''), source) FROM sv CROSS JOIN src WHERE third)
"""


def all_violations(spark, sf) -> DataFrame:
    o = open_items(spark, sf)
    src = sources_of(spark, o)
    return violations.app_undeclared(o, src).unionByName(violations.sdk_undeclared(o, src))


@query("violation_summary", VIOL_SQL + """
SELECT package, dim, value, count(*) AS n, count(DISTINCT data_field) AS n_fields FROM (
  SELECT package, data_field, unnest(['type', 'severity', 'category', 'sdk']) AS dim, unnest([violation_type, severity, category, sdk_name]) AS value FROM allv) WHERE value <> '' GROUP BY 1, 2, 3""")
def violation_summary(spark, sf):
    return violations.violation_summary(all_violations(spark, sf))


@query("violation_report", VIOL_SQL + "SELECT package, count(*) AS n_violations, true AS is_json FROM allv GROUP BY 1")
def violation_report(spark, sf):
    r = violations.violation_report(all_violations(spark, sf))
    n = F.size(F.from_json("report", "array<struct<violation_type:string>>")) == F.col("n_violations")
    return r.select("package", "n_violations", n.alias("is_json"))


@query("vague_terms", """
WITH v AS (SELECT DISTINCT p_type AS term, p_name AS item FROM part),
d AS (SELECT DISTINCT (p_partkey % 25)::INT AS package, p_type AS term FROM part),
h AS (SELECT DISTINCT s_nationkey AS package, CASE WHEN l_linenumber % 2 = 0 THEN p_name ELSE p_name || ' pro' END AS name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey),
i AS (SELECT d.package, v.term, v.item FROM d JOIN v ON d.term = v.term),
m AS (SELECT i.package, term, item, bool_or(h.name = item) AS exact, min(h.name) AS name FROM i JOIN h ON h.package = i.package AND (h.name = item OR contains(lower(h.name), lower(item)) OR contains(lower(item), lower(h.name))) GROUP BY 1, 2, 3),
s AS (SELECT package, term, item, CASE WHEN exact THEN item ELSE item || '(' || name || ')' END AS shown, row_number() OVER (PARTITION BY package, term ORDER BY item) AS rn FROM m)
SELECT package, term, count(*) AS n, string_agg(shown, ', ' ORDER BY shown) FILTER (rn <= 5) AS details FROM s GROUP BY 1, 2""")
def vague_terms(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_size")
    li = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_linenumber")
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("package"))
    j = li.join(p, li.l_partkey == p.p_partkey).join(s, li.l_suppkey == s.s_suppkey)
    vague = p.select(F.col("p_type").alias("term"), F.col("p_name").alias("item")).distinct()
    dec = p.select((F.col("p_partkey") % 25).cast("int").alias("package"), F.col("p_type").alias("raw")).distinct()
    have = j.select("package", F.when(F.col("l_linenumber") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" pro"))).alias("standard_name")).distinct()
    return violations.vague_declarations(dec, have, vague, shown=5)


@query("collected_rollup", """
WITH fc AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) END AS field, min(p_type) AS l1, min(p_brand) AS l2 FROM part GROUP BY 1),
f AS (SELECT s_nationkey AS package, min(l_orderkey * 10 + l_linenumber) AS seq, p_name || '-word' AS field, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 3),
i AS (SELECT package, seq, f.field, n, coalesce(l1, '其他信息') AS category, coalesce(l2, f.field) AS standard_name FROM f LEFT JOIN fc ON fc.field || '-word' = f.field)
SELECT package, standard_name, sum(n)::BIGINT AS n, arg_min(category, seq) AS category FROM i GROUP BY 1, 2""")
def collected_rollup(spark, sf):
    from privaudit.plans.leaks import raw_leaks
    p = table(spark, sf, "part").groupBy(F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.upper("p_name")).alias("field")).agg(F.min("p_type").alias("level1"), F.min("p_brand").alias("level2"))
    lk = raw_leaks(spark, sf).select(F.regexp_extract("package", "nation([0-9]+)", 1).cast("int").alias("package"), F.concat("privacy_field", F.lit("-word")).alias("field"), "host", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))
    counts = lk.groupBy("package", "field").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))
    src = lk.select("package", F.col("host").alias("source"), "field").distinct().withColumn("is_third_party", F.lit(False)).withColumn("sdk_name", F.lit(""))
    items, _ = violations.collected_items(counts, src, p)
    return items.select("package", "standard_name", "n", "category")


@query("declared_rollup", """
WITH w AS (SELECT conv_id AS package, turn, regexp_extract_all(text, '[a-zA-Z]{6,}') AS ws FROM conversations),
e AS (SELECT package, turn, i, ['controller', 'collection', 'data', 'sharing', 'purpose', 'receiver', 'condition', 'Data'][((i - 1) % 8) + 1] AS label, ws[i] AS word FROM w, range(1, len(ws) + 1) g(i)),
a AS (SELECT package, turn, coalesce(arg_max(word, i) FILTER (label = 'controller'), '我们') AS controller, arg_max(label, i) FILTER (label IN ('collection', 'sharing', 'other')) AS act, count(*) FILTER (lower(label) = 'data') AS n FROM e GROUP BY 1, 2)
SELECT package, controller, count(*) FILTER (act = 'collection') AS n_collection, count(*) FILTER (act = 'sharing') AS n_sharing, count(*) FILTER (act = 'other') AS n_other FROM a WHERE act IS NOT NULL AND n > 0 GROUP BY 1, 2""")
def declared_rollup(spark, sf):
    from privaudit.plans.text import entity_sentences
    s = entity_sentences(spark, sf).withColumn("package", F.col("doc_id"))
    return violations.acts_by_controller(violations.processing_acts(s))
