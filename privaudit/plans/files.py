"""Readers, writers and report documents, through files that Spark writes from the driver tables and reads back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privaudit import schemas
from privaudit.functions.scalars import flatten_declared
from privaudit.operators import fleet, leaks, policy, report, rules, violations
from privaudit.plans.leaks import SOURCE_SQL, leak_records
from privaudit.plans.registry import query
from privaudit.plans.rules import UNDECL_SQL, all_violations, undeclared_inputs
from privaudit.session import scratch_path, stored, table
from privaudit.sources import readers, sinks

APPS = ("com.a0", "com.a1", "com.a2")


def text(c) -> F.Column:
    return F.col(c).cast("string")


def lines_of(*cols) -> F.Column:
    """A row as one JSON line."""
    return F.to_json(F.struct(*cols)).alias("value")


# --- reports ----------------------------------------------------------------------------------------

REPORT_SQL = """
WITH r AS (SELECT 'com.s' || l_suppkey AS package, l_suppkey, l_returnflag AS privacy_field, 'h' || l_linenumber AS host, l_linestatus = 'F' AS encrypted FROM lineitem)
"""


def report_files(spark: SparkSession, sf: str) -> str:
    """One report file per supplier with all its records; every seventh is cut short."""
    rec = F.struct(F.col("l_returnflag").alias("privacy_field"), F.concat(F.lit("h"), text("l_linenumber")).alias("host"), (F.col("l_linestatus") == "F").alias("encrypted"))
    doc = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.collect_list(rec).alias("records"))
    whole = F.to_json(F.struct(F.lit("20240101").alias("analysis_time"), "records"))
    value = F.when(F.col("l_suppkey") % 7 == 0, F.substring(whole, 1, 40)).otherwise(whole)
    root = scratch_path(spark, "reports")
    sinks.write_documents(doc.select(F.concat(F.lit("com.s"), text("l_suppkey")).alias("package"), value.alias("value")), root)
    return root


@query("report_scan", REPORT_SQL + """
SELECT package, privacy_field, host, count(*) AS n, count(*) FILTER (encrypted) AS n_encrypted FROM r WHERE l_suppkey % 7 <> 0 GROUP BY 1, 2, 3""")
def report_scan(spark, sf):
    """Records of all report files that parse."""
    rec = readers.report_records(readers.read_reports(spark, report_files(spark, sf), "*.txt"))
    return rec.groupBy("package", "privacy_field", "host").agg(F.count("*").alias("n"), F.count_if("encrypted").alias("n_encrypted"))


@query("behaviour_result", REPORT_SQL + """
, a AS (SELECT 'com.s' || s_suppkey * 2 AS package, s_nationkey::BIGINT AS n_calls FROM supplier)
SELECT r.package, count(*) AS n_records, max(n_calls) AS n_calls FROM r LEFT JOIN a ON a.package = r.package WHERE l_suppkey % 7 <> 0 GROUP BY 1""")
def behaviour_result(spark, sf):
    """Report files with the API summaries that exist for some of them."""
    api = table(spark, sf, "supplier").select(F.concat(F.lit("com.s"), (F.col("s_suppkey") * 2).cast("string")).alias("package"), F.struct(F.col("s_nationkey").cast("long").alias("n_calls")).alias("api_summary"))
    b = readers.behaviour_result(readers.read_reports(spark, report_files(spark, sf), "*.txt"), api)
    return b.select("package", F.size("records").cast("long").alias("n_records"), F.col("api_summary.n_calls").alias("n_calls"))


@query("runtime_evidence", """
WITH r AS (SELECT DISTINCT CASE WHEN o_custkey % 3 = 0 THEN 'pkg' ELSE 'app' END || o_custkey AS name, o_custkey AS report_id FROM orders),
f AS (SELECT c_custkey, r.name, r.report_id FROM customer JOIN r ON r.name = CASE WHEN c_custkey % 3 = 0 THEN 'pkg' ELSE 'app' END || c_custkey),
s AS (SELECT o_custkey, count(*) AS n_calls FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
t AS (SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS apis FROM events WHERE value > 0 GROUP BY 1)
SELECT c_custkey AS app_id, f.name, f.report_id, n_calls, coalesce(apis, '') AS triggered FROM customer LEFT JOIN f USING (c_custkey) LEFT JOIN s ON s.o_custkey = f.report_id LEFT JOIN t ON t.user_id = c_custkey""")
def runtime_evidence(spark, sf):
    k, c = F.col("o_custkey"), text("c_custkey")
    o = table(spark, sf, "orders").select("o_custkey", "o_orderstatus")
    reports = o.select(F.concat(F.when(k % 3 == 0, "pkg").otherwise("app"), k.cast("string")).alias("name"), k.alias("report_id")).distinct()
    apps = table(spark, sf, "customer").select(F.col("c_custkey").alias("app_id"), F.concat(F.lit("pkg"), c).alias("package"), F.concat(F.lit("app"), c).alias("app_name"))
    summaries = o.filter("o_orderstatus = 'F'").groupBy(k.alias("report_id")).agg(F.count("*").alias("n_calls"))
    calls = table(spark, sf, "events").select(F.col("user_id").alias("app_id"), F.when(F.col("value") > 0, F.col("event_type")).otherwise(" ").alias("api"))
    r = fleet.runtime_evidence(apps, reports, summaries, calls)
    return r.select("app_id", "name", "report_id", "n_calls", F.array_join("triggered_apis", ",").alias("triggered"))


# --- lines ------------------------------------------------------------------------------------------

def order_lines(broken: bool) -> F.Column:
    """An order as a JSON line; with ``broken`` every fifth is cut short."""
    whole = lines_of(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"))
    return F.when((F.col("o_orderkey") % 5 == 0) & F.lit(broken), F.substring(whole, 1, 12)).otherwise(whole).alias("value")


@query("lenient_lines", """
SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'rejected' ELSE o_orderpriority END AS kind, count(*) AS n, sum(CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE o_orderkey END)::BIGINT AS ids FROM orders GROUP BY 1""")
def lenient_lines(spark, sf):
    """Good lines, rejected lines and a missing path, which adds nothing."""
    schema = f"id BIGINT, kind STRING, {readers.BAD} STRING"
    root = scratch_path(spark, "lines")
    table(spark, sf, "orders").select(order_lines(True)).write.text(root)
    read = stored(readers.read_lenient(spark, root, schema).unionByName(readers.read_lenient(spark, f"{root}-missing", schema)), "lenient")
    good, bad = readers.split_rejects(read)
    both = good.unionByName(bad.select(F.lit(0).cast("long").alias("id"), F.lit("rejected").alias("kind")))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("strict_lines", "SELECT o_orderpriority AS kind, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM orders GROUP BY 1")
def strict_lines(spark, sf):
    """A reader that fails on the first bad line, on files without one."""
    root = scratch_path(spark, "lines")
    table(spark, sf, "orders").select(order_lines(False)).write.text(root)
    return readers.read_strict(spark, root, "id BIGINT, kind STRING").groupBy("kind").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("bad_lines", """
SELECT o_orderpriority AS kind, line_no, o_orderkey FROM (
  SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS line_no FROM orders) WHERE o_orderkey % 5 = 0""")
def bad_lines(spark, sf):
    """File and number of every bad line, the order key taken back out of its text; a file per priority, in the order of keys."""
    root = scratch_path(spark, "lines")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", order_lines(True))
    # an order key of several digits survives the cut only in part, so the line is followed by its key
    whole = F.when(F.col("o_orderkey") % 5 == 0, F.concat("value", F.lit(" #"), text("o_orderkey"))).otherwise(F.col("value"))
    (o.select(F.col("o_orderpriority").alias("kind"), "o_orderkey", whole.alias("value")).repartition("kind").sortWithinPartitions("kind", "o_orderkey")
     .drop("o_orderkey").write.partitionBy("kind").text(root))
    bad = readers.bad_lines(spark, f"{root}/kind=*", "id BIGINT, kind STRING")
    return bad.select(F.url_decode(F.regexp_extract("file", r"kind=([^/]*)/", 1)).alias("kind"), "line_no", F.regexp_extract("value", r"#([0-9]+)$", 1).cast("long").alias("o_orderkey"))


@query("hook_file_logs", """
WITH e AS (SELECT 'com.a' || (user_id % 3) AS package, (event_id % 2 + 1)::INT AS stage, * FROM events)
SELECT package, stage, 'fs' AS log, event_type AS name, count(*) AS n FROM e WHERE event_id % 7 <> 0 GROUP BY ALL
UNION ALL SELECT package, stage, 'crypt', event_type || '.init', count(*) FROM e WHERE event_id % 7 <> 0 GROUP BY ALL
UNION ALL SELECT package, stage, 'permission', event_type || '.get', count(*) FROM e WHERE event_id % 7 <> 0 GROUP BY ALL""")
def hook_file_logs(spark, sf):
    """File, crypto and API logs of three apps in two stages; every seventh line is cut short and dropped by the readers."""
    root = scratch_path(spark, "logs")
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    kinds = {"fs": lines_of(F.col("event_type").alias("function"), F.lit(1).alias("fd")),
             "crypt": lines_of(F.col("event_type").alias("class"), F.lit("init").alias("method")),
             "permission": lines_of(F.col("event_type").alias("class"), F.lit("get").alias("method"))}
    for i, app in enumerate(APPS):
        for stage in (1, 2):
            mine = e.filter((F.col("user_id") % 3 == i) & (F.col("event_id") % 2 + 1 == stage))
            for kind, line in kinds.items():
                mine.select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(f"{root}/{app}/{kind}-{stage}.txt")
    name = F.concat("class", F.lit("."), "method")
    logs = [(readers.read_fs_events(spark, root), "fs", F.col("function")), (readers.read_crypto_lines(spark, root), "crypt", name), (readers.read_api_calls(spark, root), "permission", F.col("api"))]
    rows = leaks.union_all([r.select("package", "stage", F.lit(log).alias("log"), n.alias("name")) for r, log, n in logs])
    return rows.groupBy("package", "stage", "log", "name").agg(F.count("*").alias("n"))


@query("dumped_files", """
SELECT 'com.a' || (page_id % 3) AS package, 'files-' || (page_id // 3 % 2 + 1) AS folder, sum(octet_length(encode(coalesce(html, ''))) + 1)::BIGINT AS n_bytes FROM pages GROUP BY 1, 2""")
def dumped_files(spark, sf):
    """Bytes of the files an app left behind, per folder."""
    root = scratch_path(spark, "dumps")
    pages = table(spark, sf, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("value"))
    for i, app in enumerate(APPS):
        for stage in (1, 2):
            mine = pages.filter((F.col("page_id") % 3 == i) & (F.floor(F.col("page_id") / 3) % 2 + 1 == stage))
            mine.select("value").write.option("maxRecordsPerFile", 100).text(f"{root}/{app}/files-{stage}")
    f = readers.read_whole_files(spark, root)
    return f.groupBy("package", F.regexp_extract("path", r"/(files-[12])/", 1).alias("folder")).agg(F.sum(F.octet_length("content")).cast("long").alias("n_bytes"))


# --- policy results and dictionaries ----------------------------------------------------------------

@query("policy_result_shapes", """
SELECT 'lines' || s_nationkey AS package, unnest(['b' || s_suppkey % 9, 'all']) AS label FROM supplier
UNION SELECT 'array' || s_nationkey, unnest(['b' || s_suppkey % 9, 'all']) FROM supplier
UNION SELECT 'object' || s_nationkey, unnest(['b' || s_suppkey % 9, 'k' || s_nationkey]) FROM supplier""")
def policy_result_shapes(spark, sf):
    """Distinct labels of results written as JSON lines, as one array and as one object per package."""
    s = table(spark, sf, "supplier").select(text("s_nationkey").alias("p"), F.concat(F.lit("b"), (F.col("s_suppkey") % 9).cast("string")).alias("b"))
    some = s.distinct()  # at most nine per package
    item = F.struct(F.col("b").alias("text"), F.array(F.lit(1)).alias("id"), F.array("b", F.lit("all")).alias("label"))
    one = F.struct(F.col("b").alias("text"), F.array("b").alias("label"))
    lines, docs = scratch_path(spark, "results"), scratch_path(spark, "results")
    s.select(F.concat(F.lit("lines"), "p").alias("package"), F.to_json(item).alias("value")).write.partitionBy("package").text(lines)
    arrays = some.groupBy(F.concat(F.lit("array"), "p").alias("package")).agg(F.to_json(F.collect_list(item)).alias("value"))
    objects = some.groupBy(F.concat(F.lit("object"), "p").alias("package")).agg(
        F.to_json(F.struct(F.array(F.concat(F.lit("k"), F.first("p"))).alias("keywords_found"), F.collect_list(one).alias("llm_entities"))).alias("value"))
    sinks.write_documents(arrays.unionByName(objects), docs)
    items = leaks.union_all([readers.read_policy_results(spark, lines, True), readers.read_policy_results(spark, docs, False)])
    return readers.policy_result_labels(items.select("package", "label"))


@query("field_levels", "SELECT DISTINCT p_type AS field, split_part(p_type, ' ', 1) AS level1, CASE WHEN p_type LIKE '% %' THEN split_part(p_type, ' ', 2) END AS level2 FROM part WHERE p_type NOT LIKE '\\_%' ESCAPE '\\'")
def field_levels(spark, sf):
    """Levels of every field from a device description on disk."""
    root = scratch_path(spark, "device")
    levels = table(spark, sf, "part").select("p_type", F.slice(F.split("p_type", " "), 1, 2).alias("v")).distinct()  # a dictionary: one document
    doc = levels.agg(F.map_from_entries(F.collect_list(F.struct("p_type", "v"))).alias("_categories"))
    doc.select(lines_of("_categories")).write.text(root)
    return readers.field_categories(spark.read.text(f"{root}/part-*", wholetext=True).filter("value <> ''"))


@query("sdk_prefix_list", """
WITH d AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ord, n_name AS name, 'com.' || lower(n_name) AS a, 'org.' || lower(n_name) || '.kit' AS b FROM nation)
SELECT prefix, name, length(prefix)::INT AS prefix_len, row_number() OVER (ORDER BY length(prefix) DESC, ord, prefix)::INT AS rank FROM (SELECT ord, name, unnest([a, b]) AS prefix FROM d)""")
def sdk_prefix_list(spark, sf):
    """SDK dictionary from its file: a row per package prefix, the longest first."""
    from pyspark.sql import Window as W
    root = scratch_path(spark, "sdk")
    n = F.lower("n_name")
    e = table(spark, sf, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), F.array(F.concat(F.lit("com."), n), F.concat(F.lit("org."), n, F.lit(".kit"))).alias("packages")).alias("e"))
    e.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "e"))), lambda x: x["e"])).alias("value")).write.text(root)
    p = leaks.sdk_prefixes(readers.read_sdk_dictionary(spark, f"{root}/part-*"))
    return p.select("prefix", "name", "prefix_len", F.row_number().over(W.orderBy(F.desc("prefix_len"), "ord", "prefix")).alias("rank"))  # a dictionary of fixed size


@query("corpus_files", """
WITH t AS (SELECT conv_id, turn, text, role FROM conversations)
SELECT 'lines' AS split, count(*) AS n, count(DISTINCT conv_id) AS docs, sum(length(text))::BIGINT AS chars, count(*) AS n_entities FROM t WHERE conv_id % 2 = 0
UNION ALL SELECT 'flat', count(*), count(DISTINCT conv_id), sum(length(text))::BIGINT, count(*) * 2 FROM t WHERE conv_id % 2 <> 0
UNION ALL SELECT 'array', count(*), count(DISTINCT n_regionkey), sum(length(n_name))::BIGINT, 0 FROM nation""")
def corpus_files(spark, sf):
    """Labelled sentences from nested JSON lines, flat JSON lines and JSON arrays."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), "role")
    ent = F.struct(F.col("role").alias("text"), F.lit("data").alias("label"))
    roots = {k: scratch_path(spark, f"corpus-{k}") for k in ("lines", "flat", "array")}
    sent = F.struct(F.col("text").alias("sentence_text"), F.array(ent).alias("entities"))
    sinks.write_jsonl(c.filter("conv_id % 2 = 0").groupBy(text("conv_id").alias("doc_id")).agg(F.collect_list(sent).alias("sentences")), roots["lines"])
    sinks.write_jsonl(c.filter("conv_id % 2 <> 0").select(text("conv_id").alias("doc_id"), F.col("text").alias("sentence_text"), F.array(ent, ent).alias("ground_truth_entities")), roots["flat"])
    doc = F.array(F.struct(F.first(text("n_regionkey")).alias("doc_id"), F.collect_list(F.struct(F.col("n_name").alias("sentence_text"))).alias("sentences")))
    sinks.write_documents(table(spark, sf, "nation").groupBy(text("n_regionkey").alias("package")).agg(F.to_json(doc).alias("value")), roots["array"])
    rows = leaks.union_all([readers.read_corpus(spark, f"{r}/package=*" if k == "array" else r, k) for k, r in roots.items()])
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.sum(F.length("sentence_text")).alias("chars"),
                                     F.sum(F.coalesce(F.size("entities"), F.lit(0)).cast("long")).alias("n_entities"))


# --- writers ----------------------------------------------------------------------------------------

@query("leak_report_files", SOURCE_SQL + """
SELECT package, 'header' AS part, count(*) AS n, count(*) FILTER (encrypted) AS n_encrypted FROM src GROUP BY 1
UNION ALL SELECT package, 'records', count(*), count(*) FILTER (encrypted) FROM src GROUP BY 1
UNION ALL SELECT package, 'table', count(*), count(*) FILTER (encrypted) FROM src GROUP BY 1
UNION ALL SELECT package, 'csv', count(*), count(*) FILTER (encrypted) FROM src GROUP BY 1""")
def leak_report_files(spark, sf):
    """Leak reports as header and records, as a table and as CSV with a byte-order mark, read back."""
    r = stored(leak_records(spark, sf), "leaks")
    root = scratch_path(spark, "leak-files")
    head = r.groupBy("package").agg(F.count("*").alias("n"), F.count_if("encrypted").alias("n_encrypted"))
    sinks.write_leak_reports(head, r, f"{root}/reports")
    sinks.write_table(r.select("package", "privacy_field", "encrypted"), f"{root}/table")
    sinks.write_csv(r.select("package", "privacy_field", "encrypted"), f"{root}/csv")

    def counts(df, part):
        return df.groupBy("package").agg(F.count("*").alias("n"), F.count_if("encrypted").alias("n_encrypted")).select("package", F.lit(part).alias("part"), "n", "n_encrypted")

    csv = spark.read.csv(f"{root}/csv", header=True)
    csv = csv.withColumnRenamed(csv.columns[0], "package").withColumn("encrypted", F.col("encrypted").cast("boolean"))
    header = spark.read.schema("n BIGINT, n_encrypted BIGINT, package STRING").json(f"{root}/reports/summary").select("package", F.lit("header").alias("part"), "n", "n_encrypted")
    return leaks.union_all([header, counts(spark.read.schema("encrypted BOOLEAN, package STRING").json(f"{root}/reports/records"), "records"),
                            counts(spark.read.parquet(f"{root}/table"), "table"), counts(csv, "csv")])


@query("index_append", "SELECT event_id, user_id, event_type FROM events")
def index_append(spark, sf):
    """An index that grows by four batches, of which two arrive twice: every row is there once."""
    root = scratch_path(spark, "index")
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    for batch in (0, 1, 1, 2, 3, 0):
        sinks.append_index(e.filter(F.col("event_id") % 4 == batch), root, batch)
    return spark.read.schema("event_id BIGINT, user_id BIGINT, event_type STRING").json(root).select("event_id", "user_id", "event_type")


# --- declarations and prompts -----------------------------------------------------------------------

@query("declared_values", """
SELECT value, count(*) AS n FROM (SELECT unnest([c_mktsegment, CASE WHEN c_custkey % 3 = 0 THEN c_name END, CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '' END]) AS value FROM customer) WHERE trim(value) <> '' GROUP BY 1""")
def declared_values(spark, sf):
    k = F.col("c_custkey")
    v = F.array("c_mktsegment", F.when(k % 3 == 0, F.col("c_name")), F.when(k % 2 == 0, " ").otherwise(""))
    return table(spark, sf, "customer").select(F.explode(flatten_declared(v)).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


DECLARED_SQL = """
WITH w AS (SELECT conv_id AS package, turn, regexp_extract_all(text, '[a-zA-Z]{6,}') AS ws FROM conversations),
e AS (SELECT package, turn, i, ['controller', 'collection', 'data', 'sharing', 'purpose', 'receiver', 'condition', 'Data'][((i - 1) % 8) + 1] AS label, ws[i] AS word FROM w, range(1, len(ws) + 1) g(i))
"""


@query("declared_standard_items", DECLARED_SQL + """
, raw AS (SELECT DISTINCT package, word AS raw FROM e WHERE lower(label) = 'data'), u AS (SELECT DISTINCT raw, lower(raw) AS low FROM raw),
k AS (SELECT DISTINCT lower(substr(word, 2, 4)) AS key FROM e WHERE label = 'purpose'),
m AS (SELECT raw, min(key) AS key FROM u JOIN k ON contains(low, key) OR contains(key, low) GROUP BY 1)
SELECT package, raw.raw, coalesce('std ' || m.key, raw.raw) AS standard_name FROM raw LEFT JOIN m ON m.raw = raw.raw""")
def declared_standard_items(spark, sf):
    """Every declared phrase of a policy with its standard item; the terms are pieces of the stated purposes."""
    from privaudit.plans.text import entity_sentences
    s = entity_sentences(spark, sf).withColumn("package", F.col("doc_id"))
    said = F.transform(F.filter("entities", lambda x: x["label"] == "purpose"), lambda x: F.lower(F.substring(x["text"], 2, 4)))
    terms = s.select(F.explode(said).alias("key")).distinct().select(F.col("key").alias("ord"), "key", F.concat(F.lit("std "), "key").alias("standard"))
    return violations.declared_items(violations.processing_acts(s), stored(terms, "terms"))


@query("policy_text_pieces", DECLARED_SQL + """
SELECT DISTINCT conv_id AS package, lower(trim(text)) AS piece FROM conversations WHERE trim(text) <> ''
UNION SELECT package, lower(word) FROM e WHERE label IN ('controller', 'receiver')""")
def policy_text_pieces(spark, sf):
    """Policy text in pieces: sentences, receivers and controllers."""
    from privaudit.plans.text import entity_sentences
    s = entity_sentences(spark, sf).withColumnRenamed("doc_id", "package")
    return rules.policy_pieces(s, rules.policy_entities(s)).select("package", "piece")


@query("example_prompts", """
WITH c AS (SELECT conv_id, turn, text, '{"controller":"' || role || '","data_collected_or_shared":["' || regexp_extract(text, '[a-zA-Z]{6,}') || '"]}' AS act FROM conversations)
SELECT c.conv_id AS doc_id, c.turn::INT AS sent_no, concat_ws(chr(10), 'Extract.', 'label: ' || CASE WHEN c.turn % 2 = 0 THEN 'share' ELSE '未标注' END,
  coalesce(CASE WHEN a.conv_id IS NOT NULL THEN '# 1' || chr(10) || a.text || chr(10) || a.act || CASE WHEN b.conv_id IS NOT NULL THEN chr(10) || '# 2' || chr(10) || b.text || chr(10) || b.act ELSE '' END END, ''), c.text) AS prompt
FROM c LEFT JOIN c a ON a.conv_id = c.conv_id AND a.turn = c.turn - 1 LEFT JOIN c b ON b.conv_id = c.conv_id AND b.turn = c.turn - 2""")
def example_prompts(spark, sf):
    """Prompts that show the one or two turns before a sentence as solved examples, the nearest first."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("sent_no"), "text", "role")
    ents = F.array(F.struct(F.col("role").alias("text"), F.lit("controller").alias("label")), F.struct(F.regexp_extract("text", "[a-zA-Z]{6,}", 0).alias("text"), F.lit("data").alias("label")))
    solved = c.select("doc_id", F.explode(F.array(*[F.struct((F.col("sent_no") + d).alias("sent_no"), F.lit(d).alias("d")) for d in (1, 2)])).alias("to"), F.struct("text", ents.alias("entities")).alias("x"))
    shown = (solved.groupBy("doc_id", F.col("to.sent_no").alias("sent_no")).agg(F.array_sort(F.collect_list(F.struct("to.d", "x"))).alias("l"))
             .select("doc_id", "sent_no", F.transform("l", lambda v: v["x"]).alias("examples")))
    none = F.array().cast("array<string>")
    sents = c.select("doc_id", "sent_no", "text", F.array().cast("array<int>").alias("label_ids"), F.when(F.col("sent_no") % 2 == 0, F.array(F.lit("share"))).otherwise(none).alias("labels"))
    return policy.extraction_requests(sents, "Extract.", shown).select("doc_id", "sent_no", "prompt")


# --- report documents -------------------------------------------------------------------------------

@query("text_reports", SOURCE_SQL + """
, api AS (SELECT 'com.nation' || (user_id % 40) || '.app' AS package, count(*) AS api_total, count(*) FILTER (event_type <> 'error') AS api_own FROM events GROUP BY 1),
l AS (SELECT package, count(*) FILTER (source_class = 'local_file') AS n_local, count(*) FILTER (source_class <> 'local_file') AS n_net, count(*) FILTER (coalesce(encrypted, false)) AS enc, count(*) AS n FROM src GROUP BY 1),
t AS (SELECT package, string_agg('  ' || source_class || ' ' || source_key || ': ' || n, chr(10) ORDER BY source_class, rank) AS body FROM (
  SELECT *, row_number() OVER (PARTITION BY package, source_class ORDER BY n DESC, source_key) AS rank FROM (SELECT package, source_class, source_key, count(*) AS n FROM src GROUP BY 1, 2, 3)) WHERE rank <= 10 GROUP BY 1)
SELECT package, concat_ws(chr(10), 'package: ' || package, 'api calls: ' || coalesce(api_total, 0) || ' (own ' || coalesce(api_own, 0) || ', third party ' || coalesce(api_total, 0) - coalesce(api_own, 0) || ')',
  'network leaks: ' || coalesce(n_net, 0) || ', local leaks: ' || coalesce(n_local, 0), 'encrypted: ' || coalesce(enc, 0) || ', plaintext: ' || coalesce(n - enc, 0), 'sources:', body) AS report
FROM (SELECT * FROM l FULL JOIN api USING (package)) LEFT JOIN t USING (package)""")
def text_reports(spark, sf):
    """Text report of every package, written as a file each and read back whole."""
    ev = table(spark, sf, "events").select(F.concat(F.lit("com.nation"), (F.col("user_id") % 40).cast("string"), F.lit(".app")).alias("package"), "event_type")
    calls = ev.groupBy("package", F.when(F.col("event_type") == "error", "Third-Party").otherwise("App-Owned").alias("entity_type")).agg(F.count("*").alias("total_count"))
    r = stored(leak_records(spark, sf), "leaks")
    root = scratch_path(spark, "text-reports")
    sinks.write_reports(report.text_report(report.report_totals(r, calls), report.top_sources(r)), root)
    whole = spark.read.text(f"{root}/package=*", wholetext=True).select(F.regexp_extract("_metadata.file_path", r"/package=([^/]*)/", 1).alias("package"), F.rtrim(F.col("value"), F.lit("\n")).alias("report"))
    return whole


THREE_SQL = UNDECL_SQL + """
, vag AS (SELECT col.package, count(DISTINCT standard_name) AS n, string_agg(DISTINCT standard_name, ', ' ORDER BY standard_name) AS details FROM col JOIN dec ON dec.package = col.package AND dec.raw = '应用信息' GROUP BY 1),
allv AS (SELECT package, 'APP自身违规收集未声明数据' AS violation_type, standard_name AS data_field, behavior_field, category, 'a.example.com' AS source, '' AS sdk_name, n, severity, '' AS details FROM sv
  UNION ALL SELECT package, 'SDK违规收集未声明数据', standard_name, behavior_field, category, source, coalesce(nullif(sdk_name, ''), source), n, severity, '' FROM sv CROSS JOIN src WHERE third
  UNION ALL SELECT package, '模糊声明', '应用信息', '', '模糊声明', '隐私政策', '', n, '中', details FROM vag)
"""
FIELDS = ("violation_type", "data_field", "behavior_field", "category", "source", "sdk_name", "n", "severity", "details")


def three_types(spark, sf) -> DataFrame:
    """Violations by the app, by SDKs and by vague declarations; one broad term hides every order priority."""
    col, dec = undeclared_inputs(spark, sf)
    vague = table(spark, sf, "orders").select(F.lit("应用信息").alias("term"), F.col("o_orderpriority").alias("item")).distinct()
    found = violations.vague_declarations(dec, col, vague)
    return stored(all_violations(spark, sf).unionByName(violations.vague_violations(found)), "violations")


@query("violation_documents", THREE_SQL + "SELECT package, count(*) AS n_violations, to_json(list_sort(list({" + ", ".join(f"'{f}': {f}" for f in FIELDS) + "})))::VARCHAR AS report FROM allv GROUP BY 1")
def violation_documents(spark, sf):
    """JSON document of every package with violations of all three types."""
    return violations.violation_report(three_types(spark, sf)).select(F.col("package"), "n_violations", "report")


@query("violation_overview", THREE_SQL + """
SELECT package, dim, value, count(*) AS n, count(DISTINCT data_field) AS n_fields FROM (
  SELECT package, data_field, unnest(['type', 'severity', 'category', 'sdk']) AS dim, unnest([violation_type, severity, category, sdk_name]) AS value FROM allv) WHERE value <> '' GROUP BY 1, 2, 3""")
def violation_overview(spark, sf):
    """Counts per type, severity, category and SDK over violations of all three types."""
    return violations.violation_summary(three_types(spark, sf))


@query("violation_csv", THREE_SQL + "SELECT package, " + ", ".join(FIELDS) + " FROM allv")
def violation_csv(spark, sf):
    """All columns of all violations, through CSV."""
    root = scratch_path(spark, "violations")
    sinks.write_csv(three_types(spark, sf).select("package", *FIELDS), root)
    schema = "package INT, " + ", ".join(f"{f} {'BIGINT' if f == 'n' else 'STRING'}" for f in FIELDS)
    return spark.read.csv(root, header=True, schema=schema, enforceSchema=True, nullValue="\x00").fillna("", [f for f in FIELDS if f != "n"])


@query("violation_text", THREE_SQL + """
, t AS (SELECT package, violation_type, count(*) AS n, count(DISTINCT data_field) AS k FROM allv GROUP BY 1, 2),
l AS (SELECT package, 0 AS section, '' AS ord, 'violations: ' || sum(n)::BIGINT AS line FROM t GROUP BY 1
  UNION ALL SELECT package, 1, violation_type, '  ' || violation_type || ': ' || n || ' in ' || k || ' fields' FROM t
  UNION ALL SELECT package, 2, concat_ws(chr(1), violation_type, data_field, category, source), concat_ws(' | ', '[' || severity || '] ' || violation_type, data_field, category, source, nullif(sdk_name, ''), nullif(details, '')) FROM allv)
SELECT package, row_number() OVER (PARTITION BY package ORDER BY section, ord, line) AS line_no, line FROM l""")
def violation_text(spark, sf):
    """Text reports written line by line and read back with the number of every line."""
    root = scratch_path(spark, "violation-text")
    sinks.write_lines(violations.report_lines(three_types(spark, sf)), root, "section", "ord")
    lines = readers.numbered_lines(spark, f"{root}/package=*").withColumn("package", F.regexp_extract("file", r"/package=([^/]*)/", 1).cast("int"))
    # a report may fill several part files, whose names give their order
    from pyspark.sql import Window as W
    parts = lines.groupBy("package", "file").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("package").orderBy(F.regexp_extract("file", r"part-[0-9]+", 0)).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return lines.join(parts.select("file", before.alias("b")), "file").select("package", (F.col("line_no") + F.col("b")).alias("line_no"), F.col("value").alias("line"))
