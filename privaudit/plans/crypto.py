"""Crypto calls, file writes, payload decoding and flows on the driver tables."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import functions as F

from privaudit.functions import payload as P
from privaudit.functions import scalars as S
from privaudit.operators import crypto, detection
from privaudit.plans.registry import query
from privaudit.session import spread, stored, table
from privaudit.sources import readers


@query("cipher_asof", """
SELECT p.user_id AS package, p.event_id AS line_no, s.event_id AS key_line, s.value AS key FROM
  (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s
  ON p.user_id = s.user_id AND p.ts >= s.ts""")
def cipher_asof(spark, sf):
    """Purchases as cipher calls, sign-ups as key initialisations of the same user."""
    from privaudit.operators.scans import asof_join
    ev = table(spark, sf, "events")
    p = ev.filter("event_type = 'purchase'").select(F.col("user_id").alias("package"), "ts", F.col("event_id").alias("line_no"))
    s = ev.filter("event_type = 'signup'").select(F.col("user_id").alias("package"), "ts", F.col("event_id").alias("line_no"), F.col("event_id").alias("key_line"), F.col("value").alias("key"))
    return asof_join(p, s, ["package"], "ts", "line_no", ["key_line", "key"]).select("package", "line_no", "key_line", "key")


@query("fragment_stitch", """
WITH e AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ends FROM events),
g AS (SELECT *, ends - (event_type = 'purchase')::INT AS part FROM e)
SELECT user_id AS package, part::BIGINT AS part, count(*) AS n_pieces, string_agg(event_type, ',' ORDER BY ts, event_id) AS whole
FROM g GROUP BY user_id, part HAVING bool_or(event_type = 'purchase')""")
def fragment_stitch(spark, sf):
    ev = table(spark, sf, "events").select(F.col("user_id").alias("package"), "ts", "event_id", "event_type")
    r = crypto.stitch_fragments(ev, ["package"], ["ts", "event_id"], F.col("event_type") == "purchase", "event_type")
    return r.select("package", "part", "n_pieces", F.array_join("pieces", ",").alias("whole"))


@query("write_buffers", """
SELECT user_id AS package, (event_id % 2 + 1)::INT AS stage, (event_id % 3)::INT AS fd, '/d/' || event_type AS path, count(*) AS n_writes,
       string_agg(props, '' ORDER BY event_id) FILTER (event_id % 11 <> 0) AS buffer
FROM events GROUP BY ALL HAVING buffer IS NOT NULL""")
def write_buffers(spark, sf):
    """Events as interleaved base64 writes, some of them undecodable."""
    data = F.when(F.col("event_id") % 11 == 0, "%%%").otherwise(S.to_base64(F.encode("props", "UTF-8")))
    fs = table(spark, sf, "events").select(
        F.col("user_id").alias("package"), (F.col("event_id") % 2 + 1).cast("int").alias("stage"), F.col("event_id").alias("line_no"), F.lit("write").alias("function"),
        (F.col("event_id") % 3).cast("int").alias("fd"), F.concat(F.lit("/d/"), "event_type").alias("path"), data.alias("data"))
    return crypto.file_buffers(fs).withColumn("buffer", F.decode("buffer", "UTF-8"))


CRYPTO_SQL = """
WITH c AS (SELECT user_id AS package, (event_id % 2 + 1)::INT AS stage, event_id AS line_no, event_type AS plain, props AS cipher, event_id,
                  CASE event_id % 3 WHEN 0 THEN 'aesEncrypt' WHEN 1 THEN 'aesDecrypt' ELSE 'doFinal' END AS method FROM events WHERE event_id % 7 <> 0 AND event_id % 5 <> 0)
"""


def crypto_lines(spark, sf):
    k = F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("package"), (k % 2 + 1).cast("int").alias("stage"), k.alias("line_no"), F.lit("20240101000000").alias("ts"),
        F.when(k % 5 == 0, "Network").when(k % 5 == 1, "").otherwise("CryptoAPI").alias("category"), F.lit("javax.crypto.Cipher").alias("class"), F.lit(None).cast("string").alias("class_name"),
        F.when(k % 3 == 0, "aesEncrypt").when(k % 3 == 1, "aesDecrypt").otherwise("doFinal").alias("method"), F.lit(None).cast("string").alias("method_name"),
        F.when(k % 7 == 0, F.array(F.lit(""))).otherwise(F.array("event_type")).alias("args"), F.col("props").alias("returnValue"), F.lit(None).cast("string").alias("ret"),
        F.lit("h1").alias("hashcode"), F.lit("AES").alias("algorithm"), F.lit("").alias("stack"))


@query("crypto_dedupe", CRYPTO_SQL + """
SELECT package, call_md5, stage, line_no, encrypt FROM (
  SELECT package, md5(plain || cipher) AS call_md5, stage, line_no, method <> 'aesDecrypt' AS encrypt,
         row_number() OVER (PARTITION BY package, md5(plain || cipher) ORDER BY stage, line_no) AS rn FROM c) WHERE rn = 1""")
def crypto_dedupe(spark, sf):
    return crypto.crypto_calls(crypto_lines(spark, sf)).select("package", "call_md5", "stage", "line_no", "encrypt")


@query("crypto_leaks", CRYPTO_SQL + """
SELECT package, line_no, field || '-word' AS privacy_field, value_preview FROM (
  SELECT package, line_no, plain AS value_preview, row_number() OVER (PARTITION BY package, md5(plain || cipher) ORDER BY stage, line_no) AS rn FROM c)
JOIN (VALUES ('sign'), ('view')) v(field) ON contains(value_preview, field) WHERE rn = 1""")
def crypto_leaks(spark, sf):
    from privaudit.operators.leaks import detect_crypto
    calls = crypto.crypto_calls(crypto_lines(spark, sf))
    values = calls.select("package").distinct().select("package", F.explode(F.array(F.lit("sign"), F.lit("view"))).alias("value")) \
        .select("package", F.concat("value", F.lit("-word")).alias("field"), "value", F.lit(True).alias("is_keyword"))
    # leak records carry the call time; it holds the line number here so that rows can be told apart
    leaves = calls.withColumn("ts", F.col("line_no").cast("string"))
    return detect_crypto(leaves, values).select("package", F.col("ts").cast("long").alias("line_no"), "privacy_field", "value_preview")


@query("argument_roles", """
WITH c AS (SELECT event_id AS line_no, event_type AS class, CASE event_id % 2 WHEN 0 THEN 'enc' ELSE 'desEnc' END AS method, props AS a1,
                  CASE WHEN event_type = 'view' THEN 'k' || event_id ELSE '0123456789abcdef' END AS a2 FROM events),
d AS (SELECT class, method, count(DISTINCT a1) AS d1, count(DISTINCT a2) AS d2 FROM c GROUP BY 1, 2)
SELECT line_no, CASE WHEN d1 > d2 THEN 1 WHEN d1 < d2 THEN 2 WHEN length(a2) IN (16, 24, 32) THEN 1 ELSE 1 END AS data_arg FROM c JOIN d USING (class, method)""")
def argument_roles(spark, sf):
    k = F.col("event_id")
    a2 = F.when(F.col("event_type") == "view", F.concat(F.lit("k"), k.cast("string"))).otherwise("0123456789abcdef")
    c = table(spark, sf, "events").select(k.alias("line_no"), F.col("event_type").alias("class"), F.when(k % 2 == 0, "enc").otherwise("desEnc").alias("method"), F.array("props", a2).alias("args"))
    return crypto.argument_roles(c).select("line_no", "data_arg")


@query("argument_roles_three", """
SELECT event_id AS line_no, CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 1 END AS data_arg, CASE event_id % 4 WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 2 END AS key_arg,
       CASE event_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 1 END AS iv_arg FROM events""")
def argument_roles_three(spark, sf):
    k, key = F.col("event_id") % 4, F.lit("0123456789abcdef")
    long = F.concat(F.lit("payload payload payload payload "), "props")
    args = (F.when(k == 0, F.array(key, key, "props")).when(k == 1, F.array(F.col("props"), key, key)).when(k == 2, F.array(key, F.col("props"), key)).otherwise(F.array(long, key, "props")))
    c = table(spark, sf, "events").select(F.col("event_id").alias("line_no"), F.lit("T").alias("class"), F.lit("enc").alias("method"), args.alias("args"))
    return crypto.argument_roles3(c).select("line_no", "data_arg", "key_arg", "iv_arg")


@query("signed_bytes", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type ELSE props END AS decoded FROM events")
def signed_bytes(spark, sf):
    """Text as signed-byte lists, decoded back; plain words pass through."""
    def signed(c):
        codes = F.transform(F.split(c, ""), lambda ch: F.ascii(ch))
        return F.array_join(F.transform(F.filter(codes, lambda x: x > 0), lambda x: F.when(x > 127, x - 256).otherwise(x).cast("string")), ",")
    ev = table(spark, sf, "events")
    return ev.select("event_id", F.decode(S.signed_bytes_to_binary(F.when(F.col("event_id") % 4 == 0, F.col("event_type")).otherwise(signed("props"))), "UTF-8").alias("decoded"))


@query("crypto_inspect", """
SELECT user_id AS package, event_id AS line_no, 'arg1' AS part, length(props)::INT AS n_bytes, props AS text, left(lower(hex(props)), 100) AS hex_preview FROM events
UNION ALL SELECT user_id, event_id, 'ret', length(event_type)::INT, event_type, left(lower(hex(event_type)), 100) FROM events WHERE event_id % 2 = 0""")
def crypto_inspect(spark, sf):
    c = table(spark, sf, "events").select(F.col("user_id").alias("package"), F.col("event_id").alias("line_no"), F.array(S.to_base64(F.encode("props", "UTF-8"))).alias("args"),
                                          F.when(F.col("event_id") % 2 == 0, S.to_base64(F.encode("event_type", "UTF-8"))).alias("returnValue"))
    return crypto.inspect_calls(c, text_limit=500, hex_limit=100).select("package", "line_no", "part", "n_bytes", "text", "hex_preview")


@query("part_of", """
SELECT a.turn, a.conv_id, (length(a.text) >= 16 AND (contains(a.text, b.text) OR len(list_filter(range(0, length(b.text), 66),
         lambda i: length(substr(b.text, i + 1, 66)) > 32 AND contains(a.text, substr(b.text, i + 1, 66)) AND regexp_matches(substr(b.text, i + 1, 66), '[^A=]'))) > 0)) AS found
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1""")
def part_of(spark, sf):
    """Whether a chunk of the next message of a conversation occurs in the current one."""
    c = table(spark, sf, "conversations")
    a = c.select("conv_id", "turn", "text")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("nxt"))
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", crypto.is_part_of(F.col("nxt"), F.col("text")).alias("found"))


# --- scalars on payloads ------------------------------------------------------------------------------

@query("entropy", """
SELECT doc_id, round(entropy(c), 6) AS bits FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s).')) AS c FROM documents) GROUP BY doc_id""")
def entropy(spark, sf):
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").filter("text <> ''").select("doc_id", F.round(S.char_entropy("text"), 6).alias("bits"))


@query("base64_detect", """
WITH e AS (SELECT event_id, base64(encode(props || event_type || event_id)) AS b FROM events),
n AS (SELECT event_id, b, entropy(c) AS h FROM (SELECT event_id, b, unnest(regexp_extract_all(b, '.')) AS c FROM e) GROUP BY 1, 2)
SELECT event_id, length(b) > 6 AND (NOT b LIKE '%=' OR length(rtrim(b, '=')) % 4 <> 0) AND h > 4.1 AND h < 6.0 AS looks_base64, false AS plain_looks_base64 FROM n""")
def base64_detect(spark, sf):
    ev = table(spark, sf, "events")
    b = S.to_base64(F.encode(F.concat("props", "event_type", F.col("event_id").cast("string")), "UTF-8"))
    return ev.select("event_id", S.may_be_base64(b).alias("looks_base64"), S.may_be_base64("props").alias("plain_looks_base64"))


@query("base64url_decode", "SELECT event_id, props AS decoded FROM events")
def base64url_decode(spark, sf):
    b = F.rtrim(F.translate(S.to_base64(F.encode("props", "UTF-8")), "+/", "-_"), F.lit("="))
    return table(spark, sf, "events").select("event_id", F.decode(S.b64url_to_bytes(b), "UTF-8").alias("decoded"))


@query("payload_unwrap", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN props || event_type || '/longer plain text 0123' ELSE '{\"a\": \"' || event_type || '\"}' END AS plain FROM events")
def payload_unwrap(spark, sf):
    """Base64, percent-encoded and plain payloads, unwrapped."""
    k = F.col("event_id") % 3
    text = F.concat("props", "event_type", F.lit("/longer plain text 0123"))
    js = F.concat(F.lit('{"a": "'), "event_type", F.lit('"}'))
    raw = F.when(k == 0, S.to_base64(F.encode(text, "UTF-8"))).when(k == 1, F.replace(F.url_encode(js), F.lit("+"), F.lit("%20"))).otherwise(js)
    ev = table(spark, sf, "events").select("event_id", F.encode(raw, "UTF-8").alias("payload"))
    return P.unwrap_payload(ev).select("event_id", F.decode("payload", "UTF-8").alias("plain"))


@query("payload_flatten", """
SELECT l_orderkey, l_linenumber, 'body@j>' || unnest(['flag', 'qty[0]', 'qty[1]', 'ship>date', 'ship>inner>mode']) AS leaf_path,
       unnest([l_returnflag || '-flag', l_quantity::VARCHAR, l_extendedprice::VARCHAR, strftime(l_shipdate, '%Y-%m-%d'), l_linestatus]) AS leaf FROM lineitem""")
def payload_flatten(spark, sf):
    """Nested JSON payloads, one inner document as a string, flattened to leaves."""
    inner = F.to_json(F.struct(F.col("l_linestatus").alias("mode")))
    js = F.to_json(F.struct(F.concat("l_returnflag", F.lit("-flag")).alias("flag"), F.array(F.col("l_quantity").cast("string"), F.col("l_extendedprice").cast("string")).alias("qty"),
                            F.struct(F.date_format("l_shipdate", "yyyy-MM-dd").alias("date"), inner.alias("inner")).alias("ship")))
    li = spread(table(spark, sf, "lineitem"), "l_orderkey").select("l_orderkey", "l_linenumber", js.alias("payload"), F.lit("body").alias("meta"))
    return P.flatten_payload(li, "payload", "meta").select("l_orderkey", "l_linenumber", "leaf_path", "leaf")


@query("payload_query_string", """
SELECT o_orderkey, unnest(['u>p[0]', 'u>c[0]', 'u>p[1]', NULL]) AS leaf_path,
       unnest([o_orderpriority, o_custkey::VARCHAR, o_orderstatus, 'p=' || replace(o_orderpriority, ' ', '%20') || '&c=' || o_custkey || '&p=' || o_orderstatus || '&e=']) AS leaf FROM orders""")
def payload_query_string(spark, sf):
    q = F.concat(F.lit("p="), F.replace("o_orderpriority", F.lit(" "), F.lit("%20")), F.lit("&c="), F.col("o_custkey").cast("string"), F.lit("&p="), "o_orderstatus", F.lit("&e="))
    o = table(spark, sf, "orders").select("o_orderkey", q.alias("payload"), F.lit(None).cast("string").alias("meta"))
    return P.flatten_payload(o).select("o_orderkey", "leaf_path", "leaf")


@query("leaf_plausible", """
SELECT l_orderkey, l_linenumber, length(v) > 3 AND NOT regexp_full_match(v, '0*[0-9]{1,4}') AND NOT regexp_full_match(v, '-*0*\\.[0-9]*') AND v NOT IN ('true', 'false', 'null', 'none') AS plausible
FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN l_partkey::VARCHAR WHEN 2 THEN l_discount::VARCHAR WHEN 3 THEN l_returnflag WHEN 4 THEN 'true' WHEN 5 THEN strftime(l_shipdate, '%Y%m%d')
             ELSE l_extendedprice::VARCHAR END AS v FROM lineitem)""")
def leaf_plausible(spark, sf):
    n = F.col("l_linenumber")
    v = (F.when(n == 1, F.col("l_partkey").cast("string")).when(n == 2, F.col("l_discount").cast("string")).when(n == 3, F.col("l_returnflag")).when(n == 4, "true")
         .when(n == 5, F.date_format("l_shipdate", "yyyyMMdd")).otherwise(F.col("l_extendedprice").cast("string")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", S.leaf_is_plausible(v).alias("plausible"))


@query("printable_runs", "SELECT doc_id, regexp_matches(hex(text), '^(?:[0-9A-F]{66})*(?:(?:P){33}|(?:P){1,32}$)'.replace('P', '[2-6][0-9A-F]|7[0-9A-E]|0[9A-D]')) AS some_printable, true AS padded FROM documents WHERE text <> ''")
def printable_runs(spark, sf):
    t = F.col("text")
    return table(spark, sf, "documents").filter("text <> ''").select(
        "doc_id", S.has_printable_run(F.encode(t, "UTF-8")).alias("some_printable"), S.has_printable_run(F.concat(F.encode(t, "UTF-8"), F.lit(b"\x00\x00\x00\x00"))).alias("padded"))


# --- flows ------------------------------------------------------------------------------------------

FLOW_SQL = """
WITH f AS (SELECT page_id AS flow_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
  CASE page_id % 10 WHEN 0 THEN 'www.google.com' ELSE regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1) END AS host,
  CASE page_id % 7 WHEN 0 THEN '/app.js' ELSE '/p' END AS path, CASE page_id % 7 WHEN 0 THEN 'text/javascript' WHEN 1 THEN 'image/png' ELSE 'text/html' END AS ctype, html FROM pages),
k AS (SELECT * FROM f WHERE host <> 'www.google.com' AND NOT (path = '/app.js' AND ctype = 'text/javascript'))
"""


def flow_table(spark, sf):
    k = F.col("page_id")
    ctype = F.when(k % 7 == 0, "text/javascript").when(k % 7 == 1, "image/png").otherwise("text/html")
    host = F.when(k % 10 == 0, "www.google.com").otherwise(readers.host_from_url(F.col("url")))
    return table(spark, sf, "pages").select(
        F.lit("app").alias("package"), k.alias("flow_id"), F.regexp_extract("url", "^([a-z]+)://", 1).alias("scheme"), host.alias("host"),
        F.when(k % 7 == 0, "/app.js").otherwise("/p").alias("path"), (k + 1_700_000_000).alias("req_ts"), (k + 1_700_000_001).alias("res_ts"),
        F.create_map(F.lit("User-Agent"), F.lit("x")).alias("req_headers"), F.create_map(F.lit("content-type"), ctype).alias("res_headers"),
        F.encode("url", "UTF-8").alias("req_body"), F.encode("html", "UTF-8").alias("res_body"),
        F.when(k % 3 == 0, F.array(*[F.struct(F.encode(F.lit(t), "UTF-8").alias("data"), F.lit(d).alias("dir")) for t, d in (("hi", ">"), ("", "<"), ("yo", "<"))])).alias("ws"),
        F.lit(443).alias("port"), F.lit("GET").alias("method"), F.when(k % 4 != 0, F.lit(200)).alias("status_code"))


@query("flow_rows", FLOW_SQL + """
SELECT flow_id, 'req' AS side, host, path, strftime(make_timestamp((flow_id + 1700000000) * 1000000), '%Y%m%d%H%M%S') AS ts, true AS has_body FROM k
UNION ALL SELECT flow_id, 'res', host, path, strftime(make_timestamp((flow_id + 1700000001) * 1000000), '%Y%m%d%H%M%S'), NOT (ctype = 'image/png' AND octet_length(encode(html)) > 4096) FROM k""")
def flow_rows(spark, sf):
    r = readers.flow_rows(flow_table(spark, sf))
    return r.select("flow_id", "side", "host", "path", "ts", F.col("body").isNotNull().alias("has_body"))


@query("probe_rows", FLOW_SQL + """
, bodies AS (SELECT flow_id, 'req' AS side FROM k UNION ALL SELECT flow_id, 'res' FROM k WHERE NOT (ctype = 'image/png' AND octet_length(encode(html)) > 4096))
SELECT side, direction, target, meta, count(*) AS n FROM (
  SELECT 'req' AS side, '>' AS direction, 'headers' AS target, 'H->user-agent' AS meta FROM k UNION ALL SELECT 'res', '<', 'headers', 'H->content-type' FROM k
  UNION ALL SELECT 'req', '>', 'ws', 'W->' FROM k WHERE flow_id % 3 = 0 UNION ALL SELECT 'req', '<', 'ws', 'W->' FROM k WHERE flow_id % 3 = 0
  UNION ALL SELECT side, CASE side WHEN 'req' THEN '>' ELSE '<' END, 'body', NULL FROM bodies) GROUP BY ALL""")
def probe_rows(spark, sf):
    return P.probe_rows(readers.flow_rows(flow_table(spark, sf))).groupBy("side", "direction", "target", "meta").agg(F.count("*").alias("n"))


@query("flow_index", "SELECT count(*) AS requests, count(*) FILTER (page_id % 4 <> 0) AS responses, count(DISTINCT page_id + 1700000000) AS times FROM pages")
def flow_index(spark, sf):
    req, res = readers.flow_index(flow_table(spark, sf))
    return req.agg(F.count("*").alias("requests"), F.countDistinct("timestamp").alias("times")).withColumn("responses", res.agg(F.count("*")).scalar())


@query("media_strip", """
SELECT page_id, CASE WHEN page_id % 5 IN (1, 3) THEN 'Content Stripped by Script' ELSE url END AS body FROM pages""")
def media_strip(spark, sf):
    k = F.col("page_id") % 5
    path, ctype = F.when(k == 3, "/a.JPG").otherwise("/a"), F.when(k == 1, "Video/mp4").otherwise("text/html")
    return table(spark, sf, "pages").select("page_id", F.decode(S.strip_media_body(F.encode("url", "UTF-8"), path, ctype), "UTF-8").alias("body"))


# --- detection over all sources ---------------------------------------------------------------------

def _wrapped(doc_id: int, text: str) -> bytes:
    """A document as a payload, by its id: compressed and nested JSON, XML, an archive, escaped, or as it is."""
    import bz2
    import gzip
    import io
    import json
    import zipfile
    import zlib
    from xml.sax.saxutils import escape
    k, js = doc_id % 8, lambda x: json.dumps(x, ensure_ascii=False).encode()
    if k == 0:
        return gzip.compress(js({"data": {"n": doc_id, "body": text}}))
    if k == 1:
        return bz2.compress(js({"outer": base64.b64encode(gzip.compress(js({"in": text}))).decode()}))
    if k == 2:
        return zlib.compress(f"<doc><p>{escape(text)}</p><q>other</q></doc>".encode())
    if k == 3:
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a.json", js({"t": text}))
            z.writestr("b.txt", "nothing here")
        return held.getvalue()
    if k == 4:
        return "".join(f"%{b:02X}" for b in text.encode()).encode()
    if k == 5:
        return base64.b64encode(text.encode())
    return gzip.compress(js({"f": text})) if k == 6 else text.encode()


# XML has no place for most control characters, so documents with them travel as they are
@query("detect_pipeline", r"""
WITH d AS (SELECT *, CASE WHEN doc_id % 8 = 2 AND regexp_matches(text, '[\x00-\x08\x0B\x0C\x0D\x0E-\x1F]') THEN 7 ELSE doc_id % 8 END AS k FROM documents)
SELECT d.source AS package, d.doc_id, b.item_id, CASE k WHEN 6 THEN 'file_buffer' WHEN 7 THEN 'whole_file' ELSE 'https' END AS source,
 CASE k WHEN 0 THEN 'j>data>body' WHEN 1 THEN 'j>outer@j>in' WHEN 2 THEN 'x>doc>p' WHEN 3 THEN 'zip>a.json@j>t' WHEN 5 THEN 'H->x-data' WHEN 6 THEN 'j>f' ELSE '' END AS leaf_path
FROM d JOIN benchmark b ON contains(d.text, b.text)""")
def detect_pipeline(spark, sf):
    """Documents inside flows, written buffers and files, nested up to four deep, searched for the items of the benchmark."""
    docs = table(spark, sf, "documents").where("text is not null")
    odd = (F.col("doc_id") % 8 == 2) & F.col("text").rlike(r"[\x00-\x08\x0B\x0C\x0D\x0E-\x1F]")

    def run(batches):
        for b in batches:
            ids, texts, whole = (b.column(i).to_pylist() for i in range(3))
            body = [t.encode() if w else _wrapped(i, t) for i, t, w in zip(ids, texts, whole)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), b.column(2), pa.array(body, type=pa.binary())], names=["doc_id", "package", "whole", "body"])

    held = docs.select("doc_id", "text", odd.alias("whole"), F.col("source").alias("package")).mapInArrow(run, "doc_id long, package string, whole boolean, body binary")
    held = stored(held, "wrapped")
    k, name = F.when(F.col("whole"), 7).otherwise(F.col("doc_id") % 8), F.concat(F.lit("/d"), F.col("doc_id").cast("string"))
    none = F.lit(None)
    flows = held.where(k <= 5).select(
        "package", F.col("doc_id").alias("flow_id"), F.lit("https").alias("scheme"), F.lit("api.example.org").alias("host"), name.alias("path"), F.lit(1_700_000_000).alias("req_ts"), F.lit(1_700_000_001).alias("res_ts"),
        F.when(k == 5, F.create_map(F.lit("X-Data"), F.decode("body", "UTF-8"))).alias("req_headers"), none.cast("map<string,string>").alias("res_headers"), F.when(k != 5, F.col("body")).alias("req_body"),
        none.cast("binary").alias("res_body"), none.cast("array<struct<data:binary,dir:string>>").alias("ws"))
    size = F.greatest(F.floor(F.length("body") / 3) + 1, F.lit(1)).cast("int")
    writes = held.where(k == 6).select("package", F.lit(1).alias("stage"), F.posexplode(F.sequence(F.lit(0), F.lit(2))).alias("line_no", "i"), F.lit(3).alias("fd"), name.alias("path"), "body").withColumn(
        "data", S.to_base64(F.substring("body", F.col("i") * size + 1, size))).withColumn("function", F.lit("write"))
    files = held.where(k == 7).select("package", name.alias("path"), F.col("body").alias("content"))
    rows = detection.probes(readers.flow_rows(flows), crypto.file_buffers(writes), files)
    items = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("field"), F.col("text").alias("value"), F.lit(False).alias("is_keyword"))
    sources = held.agg(F.collect_set("package")).scalar()  # a handful of names
    values = items.select(F.explode(sources).alias("package"), "field", "value", "is_keyword")
    found = detection.detect(rows, values).where("encode_type = 'normal'")
    doc = F.regexp_extract(F.when(F.col("source").isin("file_buffer", "whole_file"), F.col("host")).otherwise(F.col("path")), "([0-9]+)$", 1).cast("long")
    path = F.coalesce("leaf_path", F.lit(""))
    return (found.groupBy("package", doc.alias("doc_id"), F.col("privacy_field").cast("long").alias("item_id"), "source")
            .agg(F.min_by(path, F.struct(F.length(path), path)).alias("leaf_path")))
