"""Policy text, extraction and data items on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit import dictionaries as D
from privaudit.functions import scalars as S
from privaudit.operators import evaluate, policy
from privaudit.plans.registry import query
from privaudit.session import spread, table

# --- HTML -------------------------------------------------------------------------------------------

STRIP = r"'^\s+|\s+$', '', 'g'"


def _html_sql(col: str) -> str:
    s = f"CASE WHEN regexp_extract({col}, '(?is)<body[^>]*>(.*)</body>', 1) <> '' THEN regexp_extract({col}, '(?is)<body[^>]*>(.*)</body>', 1) ELSE {col} END"
    s = f"regexp_replace({s}, '(?s)<!--.*?-->', '', 'g')"
    for tag in ("script", "style", "title", "head"):
        s = f"regexp_replace({s}, '(?is)<{tag}(\\s[^>]*)?>.*?</{tag}\\s*>', '', 'g')"
    s = f"replace({s}, chr(9), ' ')"
    s = f"regexp_replace({s}, '(?i)</t[dh]\\s*>', chr(9), 'g')"
    s = f"regexp_replace({s}, '(?i)</(p|h[1-6]|li|tr)\\s*>', chr(10), 'g')"
    s = f"regexp_replace({s}, '<[^>]+>', '', 'g')"
    for raw, new in (("&nbsp;", "' '"), ("&amp;", "'&'"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&#39;", "chr(39)")):
        s = f"replace({s}, '{raw}', {new})"
    s = f"replace(replace({s}, chr(160), ' '), chr(12288), ' ')"
    s = f"regexp_replace({s}, '[ \\t]*\\n\\s*', chr(10), 'g')"
    return f"regexp_replace({s}, {STRIP})"


@query("html_text", f"SELECT page_id, {_html_sql('html')} AS text FROM pages")
def html_text(spark, sf):
    return spread(table(spark, sf, "pages").select("page_id", "html"), "page_id").select("page_id", policy.page_text("html").alias("text"))


@query("html_emphasis", """
WITH p AS (SELECT page_id, replace(replace(html, '<h1>', '<strong>'), '</h1>', '</strong>') AS html FROM pages),
e AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(?:b|strong)(?:\\s[^>]*)?>(.*?)</(?:b|strong)\\s*>', 1)) AS x FROM p)
SELECT page_id, regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM e WHERE regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g') <> ''""")
def html_emphasis(spark, sf):
    html = F.replace(F.replace("html", F.lit("<h1>"), F.lit("<strong>")), F.lit("</h1>"), F.lit("</strong>"))
    return table(spark, sf, "pages").select("page_id", F.explode(policy.html_emphasis(html)).alias("text"))


@query("html_tables", """
WITH p AS (SELECT page_id, replace(replace(replace(replace(html, '<ul>', '<table>'), '</ul>', '</table>'), '<li>', '<tr><td>'), '</li>', '</td><td>z</td></tr>') AS html FROM pages),
t AS (SELECT page_id, regexp_extract_all(html, '(?is)<table(?:\\s[^>]*)?>(.*?)</table\\s*>', 1) AS ts FROM p),
r AS (SELECT page_id, i AS table_no, regexp_extract_all(ts[i], '(?is)<tr(?:\\s[^>]*)?>(.*?)</tr\\s*>', 1) AS rs FROM t, range(1, len(ts) + 1) g(i)),
c AS (SELECT page_id, table_no, j AS row_no, list_transform(regexp_extract_all(rs[j], '(?is)<t[dh](?:\\s[^>]*)?>(.*?)</t[dh]\\s*>', 1), lambda x: regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS cs
      FROM r, range(1, len(rs) + 1) g(j))
SELECT page_id, table_no::INT AS table_no, row_no::INT AS row_no, array_to_string(cs, '|') AS cells FROM c""")
def html_tables(spark, sf):
    html = F.col("html")
    for a, b in (("<ul>", "<table>"), ("</ul>", "</table>"), ("<li>", "<tr><td>"), ("</li>", "</td><td>z</td></tr>")):
        html = F.replace(html, F.lit(a), F.lit(b))
    t = table(spark, sf, "pages").select("page_id", F.posexplode(policy.html_tables(html)).alias("t", "rows"))
    r = t.select("page_id", (F.col("t") + 1).alias("table_no"), F.posexplode("rows").alias("r", "cells"))
    return r.select("page_id", "table_no", (F.col("r") + 1).alias("row_no"), F.array_join("cells", "|").alias("cells"))


@query("html_fallback", """
WITH q AS (SELECT page_id, unnest(regexp_extract_all('<script>a="' || '隐私政策' || page_id || '号&amp;说明文字内容更多\\n完";b="' || url || '"</script>', '["'']([^"'']{12,})["'']', 1)) AS x FROM pages)
SELECT page_id, replace(replace(x, '&amp;', '&'), '\\n', chr(10)) AS text FROM q WHERE contains(x, '隐私')""")
def html_fallback(spark, sf):
    """Pages that only hold script text."""
    html = F.concat(F.lit('<script>a="隐私政策'), F.col("page_id").cast("string"), F.lit('号&amp;说明文字内容更多\\n完";b="'), "url", F.lit('"</script>'))
    return table(spark, sf, "pages").select("page_id", policy.page_text(html).alias("text"))


# --- sentences --------------------------------------------------------------------------------------

MARKER_SQL = "'" + D.MARKER_LINE.replace("'", "''") + "'"
CLEAN_SQL = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '【[^】]+】', '', 'g'), ' +', ' ', 'g'), '^\s+|\s+$', '', 'g')"

# pages as text lines: marker lines come from '#' bullets that are turned into numbers
LINES_SQL = f"""
WITH src AS (SELECT doc_id, regexp_replace(text, '\\n([A-Z])', chr(10) || '1.2' || chr(10) || '\\1', 'g') AS text FROM documents),
l0 AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM src),
l1 AS (SELECT doc_id, i, {CLEAN_SQL.replace('(x,', '(ls[i],')} AS line FROM l0, range(1, len(ls) + 1) g(i)),
l2 AS (SELECT *, regexp_matches(line, {MARKER_SQL}) AS mark, lead(line) OVER w AS nxt, lag(line) OVER w AS prv FROM l1 WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
l3 AS (SELECT *, nxt <> '' AND NOT regexp_matches(nxt, {MARKER_SQL}) AS next_plain, regexp_matches(prv, {MARKER_SQL}) AS prev_mark FROM l2),
l4 AS (SELECT doc_id, i, CASE WHEN mark AND coalesce(next_plain, false) THEN line || ' ' || nxt ELSE line END AS line FROM l3
       WHERE NOT (line <> '' AND NOT mark AND coalesce(prev_mark, false)))
"""


def numbered_docs(spark, sf) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("doc_id", F.regexp_replace("text", r"\n([A-Z])", "\n1.2\n$1").alias("text"))


@query("line_merge", LINES_SQL + "SELECT doc_id, line, count(*) AS n FROM l4 GROUP BY 1, 2")
def line_merge(spark, sf):
    lines = F.transform(F.split("text", "\n"), policy.clean_line)
    d = numbered_docs(spark, sf).select("doc_id", lines.alias("ls"))
    return d.select("doc_id", F.explode(policy.merge_marker_lines(F.col("ls"))).alias("line")).groupBy("doc_id", "line").agg(F.count("*").alias("n"))


SENT_SQL = LINES_SQL + r"""
, l5 AS (SELECT doc_id, i, line FROM l4 WHERE line <> ''),
u0 AS (SELECT doc_id, i, unnest(string_split(regexp_replace(line, '([。；！？])', '\1' || chr(1), 'g'), chr(1))) AS u, generate_subscripts(string_split(regexp_replace(line, '([。；！？])', '\1' || chr(1), 'g'), chr(1)), 1) AS k
       FROM l5 WHERE length(line) > 450),
u1 AS (SELECT doc_id, i, k, regexp_replace(regexp_replace(u, '[。；！？]$', ''), '^\s+|\s+$', '', 'g') AS c, regexp_extract(u, '([。；！？])$', 1) AS m FROM u0),
s AS (SELECT doc_id, i, 0 AS k, line AS text FROM l5 WHERE length(line) <= 450
      UNION ALL SELECT doc_id, i, k * 100000 + j, p FROM (
        SELECT doc_id, i, k, unnest(l) AS p, generate_subscripts(l, 1) AS j FROM (
          SELECT doc_id, i, k, list_transform(regexp_extract_all(c || m, '(?s).{1,450}'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')) AS l FROM u1 WHERE c <> '')) WHERE p <> '')
"""


@query("sentence_split", SENT_SQL + "SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, k) - 1)::INT AS sent_no, text FROM s")
def sentence_split(spark, sf):
    return policy.sentences(numbered_docs(spark, sf), "doc_id", "text")


@query("sentence_filter", SENT_SQL + r"""
SELECT doc_id, count(*) AS n_all, count(*) FILTER (NOT (regexp_matches(text, '^([0-9]+(\.[0-9]+)*\.?|\([0-9]+\)|[a-zA-Z]\))$') AND length(text) <= 5) AND NOT contains(text, chr(9))) AS n_kept FROM s GROUP BY 1""")
def sentence_filter(spark, sf):
    return policy.sentences(numbered_docs(spark, sf), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_all"), F.count_if(policy.keeps_sentence("text")).alias("n_kept"))


# --- entities ---------------------------------------------------------------------------------------
# a conversation turn is a sentence; its words are entities, labels by position

LABELS = ["controller", "collection", "data", "sharing", "purpose", "receiver", "condition", "Data"]
ENT_SQL = """
WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[a-zA-Z]{6,}') AS ws FROM conversations),
e AS (SELECT conv_id, turn, i AS pos, ws[i] AS word, ['controller', 'collection', 'data', 'sharing', 'purpose', 'receiver', 'condition', 'Data'][((i - 1) % 8) + 1] AS label
      FROM w, range(1, len(ws) + 1) g(i))
"""


def entity_sentences(spark, sf) -> DataFrame:
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("sent_no"), "text")
    words = F.regexp_extract_all("text", F.lit("[a-zA-Z]{6,}"), F.lit(0))
    labels = F.array(*[F.lit(x) for x in LABELS])
    return c.withColumn("entities", F.transform(words, lambda w, i: F.struct(w.alias("text"), F.element_at(labels, i % 8 + 1).alias("label"))))


@query("response_entities", ENT_SQL + """
, a AS (SELECT conv_id, turn, max(word) FILTER (pos = 1) AS controller, max(word) FILTER (pos = 2) AS verb, max(word) FILTER (pos = 3) AS d1, max(word) FILTER (pos = 5) AS purpose FROM e GROUP BY 1, 2)
SELECT conv_id AS doc_id, turn::INT AS sent_no, concat_ws(',', 'controller=' || controller, CASE WHEN turn % 3 <> 2 THEN CASE turn % 3 WHEN 0 THEN 'collection=' ELSE 'sharing=' END || verb END,
       'purpose=' || purpose, 'data=' || d1, 'data=fixed') AS entities FROM a WHERE turn % 5 <> 4""")
def response_entities(spark, sf):
    """Turns rendered as model responses (some broken), parsed to entities."""
    s = entity_sentences(spark, sf).filter(F.size("entities") > 0)

    def word(i):
        return F.get("entities", F.lit(i - 1))["text"]

    kind = F.element_at(F.array(F.lit("Collection"), F.lit("Sharing"), F.lit("Teleport")), F.col("sent_no") % 3 + 1)
    act = F.struct(word(1).alias("controller"), word(2).alias("action_verb"), kind.alias("action_type"), word(5).alias("purpose"),
                   F.array_compact(F.array(word(3), F.lit("fixed"))).alias("data_collected_or_shared"))
    js = F.to_json(F.struct(F.array(act).alias("processing_acts")))
    resp = F.when(F.col("sent_no") % 5 == 4, F.concat(F.lit("no json {"), js)).otherwise(F.concat(F.lit("Sure:\n"), js, F.lit("\nDone")))
    r = s.select("doc_id", "sent_no", policy.response_entities(resp).alias("e")).filter(F.size("e") > 0)
    return r.select("doc_id", "sent_no", F.array_join(F.transform("e", lambda x: F.concat_ws("=", x["label"], x["text"])), ",").alias("entities"))


@query("act_struct", ENT_SQL + """
SELECT conv_id AS doc_id, turn::INT AS sent_no, arg_min(word, pos) FILTER (label IN ('collection', 'sharing')) AS action_verb, arg_min(word, pos) FILTER (label = 'controller') AS controller,
       string_agg(word, ',' ORDER BY pos) FILTER (lower(label) = 'data') AS data, arg_min(word, pos) FILTER (label = 'purpose') AS purpose FROM e GROUP BY 1, 2""")
def act_struct(spark, sf):
    s = entity_sentences(spark, sf).filter(F.size("entities") > 0).withColumn("a", policy.entities_to_act("entities"))
    data = F.when(F.size("a.data_collected_or_shared") > 0, F.array_join("a.data_collected_or_shared", ","))
    return s.select("doc_id", "sent_no", "a.action_verb", "a.controller", data.alias("data"), "a.purpose")


@query("extraction_requests", """
WITH s AS (SELECT conv_id, turn, text, CASE turn % 4 WHEN 0 THEN [87, 1] WHEN 1 THEN [2] ELSE [] END AS ids, CASE turn % 3 WHEN 0 THEN ['处理者', '身份'] WHEN 1 THEN ['其他'] ELSE [] END AS labels FROM conversations)
SELECT conv_id AS doc_id, turn::INT AS sent_no, CASE WHEN len(labels) > 0 THEN array_to_string(labels, ',') ELSE '未标注' END AS label_context,
       'Extract.' || chr(10) || 'label: ' || CASE WHEN len(labels) > 0 THEN array_to_string(labels, ',') ELSE '未标注' END || chr(10) || chr(10) || text AS prompt
FROM s WHERE NOT list_contains(ids, 87) AND NOT list_contains(labels, '其他')""")
def extraction_requests(spark, sf):
    k = F.col("turn")
    s = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("doc_id"), k.cast("int").alias("sent_no"), "text",
        F.when(k % 4 == 0, F.array(F.lit(87), F.lit(1))).when(k % 4 == 1, F.array(F.lit(2))).otherwise(F.array().cast("array<int>")).alias("label_ids"),
        F.when(k % 3 == 0, F.array(F.lit("处理者"), F.lit("身份"))).when(k % 3 == 1, F.array(F.lit("其他"))).otherwise(F.array().cast("array<string>")).alias("labels"))
    return policy.extraction_requests(s, "Extract.").drop("text")


@query("response_attach", """
SELECT conv_id AS doc_id, turn::INT AS sent_no, CASE WHEN role = 'assistant' AND turn % 3 <> 0 THEN 1 ELSE 0 END AS n_entities FROM conversations""")
def response_attach(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("sent_no"), "role", "text")
    one = F.array(F.struct(F.col("text"), F.lit("data").alias("label")))
    resp = c.filter("role = 'assistant' and sent_no % 3 <> 0").select("doc_id", "sent_no", one.alias("predicted_entities"))
    return policy.attach_responses(c, resp).select("doc_id", "sent_no", F.size("predicted_entities").alias("n_entities"))


@query("response_mismatches", """
SELECT conv_id AS doc_id, count(*) FILTER (turn % 2 = 0 AND turn % 3 <> 0) AS missing, count(*) FILTER (turn % 2 <> 0 AND turn % 3 = 0) AS unexpected
FROM conversations WHERE turn % 2 = 0 OR turn % 3 = 0 GROUP BY 1""")
def response_mismatches(spark, sf):
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("sent_no"))
    return policy.response_mismatches(c.filter("sent_no % 2 = 0"), c.filter("sent_no % 3 = 0"))


@query("knowledge_base", """
SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS sent_no, turn % 2 = 1 AS is_positive, n FROM (
  SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n, role FROM conversations) WHERE true""")
def knowledge_base(spark, sf):
    p = paragraphs(spark, sf)
    kb = policy.knowledge_base(p)
    return kb.join(p.select("doc_id", F.size("sentences").cast("long").alias("n")), "doc_id").select("doc_id", "sent_no", "is_positive", "n")


def paragraphs(spark, sf) -> DataFrame:
    """Conversations as documents of sentences; odd turns carry output. A document is the unit of the corpus."""
    none = F.array().cast("array<struct<text:string,label:string>>")
    rows = entity_sentences(spark, sf).select(
        "doc_id", "sent_no", F.col("text").alias("sentence_text"), F.array(F.lit("x")).alias("classification_labels"), "entities",
        F.when(F.col("sent_no") % 2 == 0, F.col("entities")).otherwise(none).alias("predicted_entities"))
    p = policy.regroup_sentences(rows)
    out = F.transform("sentences", lambda s: F.struct(s["sentence_text"].alias("sentence_text"), s["classification_labels"].alias("classification_labels"),
                                                      s["entities"].alias("entities"), s["predicted_entities"].alias("predicted_entities"),
                                                      F.when(s["sent_no"] % 2 == 1, s["sentence_text"]).otherwise("").alias("output")))
    return p.withColumn("sentences", out)


@query("corpus_roundtrip", """
SELECT conv_id AS doc_id, count(*) AS n_sentences, sum(len(regexp_extract_all(text, '[a-zA-Z]{6,}')))::BIGINT AS n_entities,
       sum(CASE WHEN turn % 2 = 0 THEN len(regexp_extract_all(text, '[a-zA-Z]{6,}')) ELSE 0 END)::BIGINT AS n_predicted, count(*) FILTER (turn % 2 = 1) AS n_output
FROM conversations GROUP BY 1""")
def corpus_roundtrip(spark, sf):
    p = paragraphs(spark, sf)
    kept = policy.sentences_with_output(p).select("doc_id", F.size("sentences").cast("long").alias("n_output"))
    flat = policy.flatten_paragraphs(p).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.size("entities")).alias("n_entities"), F.sum(F.size("predicted_entities")).alias("n_predicted"))
    return flat.join(kept, "doc_id")


@query("entity_display", ENT_SQL + """
SELECT conv_id AS doc_id, turn::INT AS sent_no, string_agg('【' || word || '|' || lower(label) || '】', ', ' ORDER BY pos) AS shown FROM e GROUP BY 1, 2""")
def entity_display(spark, sf):
    return entity_sentences(spark, sf).filter(F.size("entities") > 0).select("doc_id", "sent_no", policy.entity_display("entities").alias("shown"))


@query("perfect_matches", """
WITH w AS (SELECT conv_id, turn, regexp_extract_all(text, '[a-zA-Z]{6,}') AS ws FROM conversations),
p AS (SELECT *, CASE turn % 3 WHEN 0 THEN ws WHEN 1 THEN list_reverse(ws) ELSE ws[2:] END AS ps FROM w)
SELECT conv_id, turn, ws = ps AS same_list, list_sort(list_distinct(ws)) = list_sort(list_distinct(ps)) AS same_set, len(ws)::INT AS n_entities FROM p WHERE ws = ps OR list_sort(list_distinct(ws)) = list_sort(list_distinct(ps))""")
def perfect_matches(spark, sf):
    words = F.regexp_extract_all("text", F.lit("[a-zA-Z]{6,}"), F.lit(0))
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.transform(words, lambda w: F.struct(w.alias("text"), F.lit("Data").alias("label"))).alias("entities"))
    k = F.col("turn") % 3
    pred = F.when(k == 0, F.col("entities")).when(k == 1, F.reverse("entities")).otherwise(F.slice("entities", F.lit(2), F.greatest(F.size("entities") - 1, F.lit(0))))
    c = c.withColumn("predicted_entities", F.transform(pred, lambda e: F.struct(e["text"].alias("text"), F.lower(e["label"]).alias("label"))))
    lists = evaluate.perfect_matches(c).select("conv_id", "turn", F.lit(True).alias("same_list"))
    return evaluate.perfect_matches(c, as_sets=True).join(lists, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.coalesce("same_list", F.lit(False)).alias("same_list"), F.lit(True).alias("same_set"), "n_entities")


# --- data items -------------------------------------------------------------------------------------

ITEM_SQL = """
WITH tx AS (SELECT row_number() OVER (ORDER BY std) AS ord, std, 'cat' || (row_number() OVER (ORDER BY std) % 4) AS category FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS std FROM part)),
it AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN 'zzz/' || p_brand WHEN 2 THEN '昵称;' || p_type ELSE 'cat2' END AS item FROM part)
"""


def item_rows(spark, sf) -> DataFrame:
    k = F.col("p_partkey") % 4
    item = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("zzz/"), "p_brand")).when(k == 2, F.concat(F.lit("昵称;"), "p_type")).otherwise("cat2")
    return table(spark, sf, "part").select(item.alias("item"))


def item_taxonomy(spark, sf) -> DataFrame:
    from pyspark.sql import Window as W
    s = table(spark, sf, "part").select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("standard")).distinct()
    # the taxonomy is a small dimension
    return s.withColumn("ord", F.row_number().over(W.orderBy("standard"))).withColumn("category", F.concat(F.lit("cat"), (F.col("ord") % 4).cast("string")))


@query("item_classify", ITEM_SQL + """
SELECT item, coalesce(CASE WHEN item = 'cat2' THEN 'cat2' END, (SELECT arg_min(category, ord) FROM tx WHERE contains(replace(lower(item), ' ', ''), std)), '未分类数据') AS category FROM it""")
def item_classify(spark, sf):
    return policy.classify_items(item_rows(spark, sf), "item", item_taxonomy(spark, sf))


@query("act_table", ENT_SQL + """
, k AS (SELECT conv_id, turn, word AS item, 'c' || (length(word) % 3) AS category FROM e WHERE label = 'data' AND length(word) % 5 <> 0),
c AS (SELECT conv_id, turn, string_agg(DISTINCT category, '，' ORDER BY category) AS cats FROM k GROUP BY 1, 2)
SELECT e.conv_id AS doc_id, e.turn::INT AS sent_no, CASE WHEN count(*) FILTER (label = 'collection') > 0 THEN '收集' ELSE '其他' END AS action,
       coalesce(max(cats), '未分类数据') AS categories, coalesce(string_agg(word, '，' ORDER BY pos) FILTER (label = 'data'), '-') AS items,
       coalesce(arg_min(word, pos) FILTER (label IN ('purpose', 'condition')), '-') AS purpose
FROM e LEFT JOIN c ON e.conv_id = c.conv_id AND e.turn = c.turn GROUP BY 1, 2""")
def act_table(spark, sf):
    s = entity_sentences(spark, sf)
    words = s.select(F.explode("entities").alias("x")).filter("x.label = 'data'").select(F.col("x.text").alias("item")).distinct()
    cat = F.when(F.length("item") % 5 == 0, D.UNCLASSIFIED_ITEM).otherwise(F.concat(F.lit("c"), (F.length("item") % 3).cast("string")))
    return policy.act_table(s, words.withColumn("category", cat))


@query("declaration_normalize", """
WITH t AS (SELECT DISTINCT CASE p_partkey % 6 WHEN 0 THEN '手机号' WHEN 1 THEN 'imei' WHEN 2 THEN p_name WHEN 3 THEN '您的' || p_brand || '人脸照片' WHEN 4 THEN ' WiFi名称 ' ELSE upper(p_name) END AS raw FROM part)
SELECT raw, CASE WHEN raw = '手机号' THEN '手机号' WHEN raw = 'imei' THEN 'IMEI' WHEN raw LIKE '%人脸%' THEN '面部特征' WHEN trim(raw) = 'WiFi名称' THEN 'SSID'
       WHEN contains(lower(raw), 'ip') THEN 'IP' WHEN contains(lower(raw), 'red widget') THEN 'Red Widget' ELSE raw END AS standard_name FROM t""")
def declaration_normalize(spark, sf):
    k = F.col("p_partkey") % 6
    raw = (F.when(k == 0, "手机号").when(k == 1, "imei").when(k == 2, F.col("p_name")).when(k == 3, F.concat(F.lit("您的"), "p_brand", F.lit("人脸照片"))).when(k == 4, " WiFi名称 ").otherwise(F.upper("p_name")))
    tx = spark.createDataFrame([(0, "个人信息", "Red Widget")], "ord int, parent string, child string")
    return policy.normalize_declarations(table(spark, sf, "part").select(raw.alias("raw")), "raw", policy.declaration_terms(spark, tx))


@query("entity_postprocess", """
WITH e AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '您的' || replace(p_name, ' ', '、') WHEN 1 THEN '必要的 ' || p_name ELSE p_name || '和' || p_brand END AS text FROM part)
SELECT DISTINCT p_partkey, unnest(list_filter(regexp_split_to_array(trim(regexp_replace(text, '^(您的|你的|您|的|部分|必要的|相关的|一些|某种)\\s*', '')), '[、，,;和\\s]+'), lambda x: x <> '')) AS text FROM e""")
def entity_postprocess(spark, sf):
    k = F.col("p_partkey") % 3
    t = F.when(k == 0, F.concat(F.lit("您的"), F.replace("p_name", F.lit(" "), F.lit("、")))).when(k == 1, F.concat(F.lit("必要的 "), "p_name")).otherwise(F.concat("p_name", F.lit("和"), "p_brand"))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("sent_id"), F.lit("data").alias("label"), t.alias("text"))
    return evaluate.postprocess(rows).select(F.col("sent_id").alias("p_partkey"), "text")


@query("camel_words", r"""
SELECT p_partkey, array_to_string(string_split(regexp_replace(regexp_replace(a, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), ' '), '|') AS words
FROM (SELECT p_partkey, 'get' || p_type || 'Name' || upper(left(p_name, 1)) || substr(split_part(p_name, ' ', 1), 2) AS a FROM part)""")
def camel_words(spark, sf):
    a = F.concat(F.lit("get"), "p_type", F.lit("Name"), F.upper(F.left("p_name", F.lit(1))), F.substr(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(2)))
    return table(spark, sf, "part").select("p_partkey", F.array_join(S.split_camel(a), "|").alias("words"))


@query("safe_filenames", r"""SELECT page_id, trim(regexp_replace(url, '[\\/:*?"<>|]', '_', 'g')) AS name FROM pages""")
def safe_filenames(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.safe_filename("url").alias("name"))


# --- retrieval --------------------------------------------------------------------------------------

NEAR_SQL = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, label FROM embeddings),
s AS (SELECT q.vec_id AS query_id, b.vec_id AS match_id, b.label % 2 = 0 AS is_positive, round(list_cosine_similarity(q.v, b.v), 6) AS sim FROM e q JOIN e b ON q.vec_id <> b.vec_id)
"""


def vectors(spark, sf, id_col) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias(id_col), F.col("embedding").alias("vec"), "label")


@query("vector_topk", NEAR_SQL + """
SELECT query_id, match_id, sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, match_id) AS rank FROM s) WHERE rank <= 2""")
def vector_topk(spark, sf):
    """The two nearest other vectors of every vector."""
    q, b = vectors(spark, sf, "query_id").drop("label"), vectors(spark, sf, "match_id").drop("label")
    return policy.nearest(q, b, 2, same_id_excluded=True)


@query("adaptive_examples", NEAR_SQL + """
, r AS (SELECT *, row_number() OVER (PARTITION BY query_id, is_positive ORDER BY sim DESC, match_id) AS rank FROM s),
b AS (SELECT query_id, sim AS best FROM r WHERE is_positive AND rank = 1)
SELECT query_id, match_id, sim, rank, is_positive FROM r JOIN b USING (query_id)
WHERE (is_positive AND rank <= CASE WHEN best > 0.40 THEN 3 WHEN best > 0.34 THEN 2 ELSE 1 END) OR (NOT is_positive AND rank <= CASE WHEN best > 0.40 THEN 0 ELSE 1 END)""")
def adaptive_examples(spark, sf):
    """Even labels as positive examples, odd ones as negative; thresholds fitted to this vector space."""
    q, b = vectors(spark, sf, "query_id").drop("label"), vectors(spark, sf, "match_id")
    return policy.adaptive_examples(q, b.filter("label % 2 = 0").drop("label"), b.filter("label % 2 <> 0").drop("label"), 0.40, 0.34, same_id_excluded=True)
