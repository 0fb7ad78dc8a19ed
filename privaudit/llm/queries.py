"""The operators on the driver's tables, whole, with the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from privaudit.llm import bpe, centroids, decontaminate, fmindex, hilbert, kneser, lengths, quality, simhash, suffixes, urls, warc, whitening
from privaudit.plans.registry import Query
from privaudit.session import scratch_path, table

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_quality_rules")
def quality_rules(spark, sf):
    return quality.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "votes", F.round("posterior", 6).alias("posterior"))


@query("op2_byte_bpe")
def byte_bpe(spark, sf):
    return bpe.decode(bpe.encode(table(spark, sf, "documents"))).select(
        "doc_id", bpe.n_tokens().alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def digit(c: str, k: int) -> F.Column:
    return F.conv(F.substring(F.md5(c), k, 1), 16, 10).cast("int")


DIGIT = "('0x' || substr(md5({c}), {k}, 1))::INT"


@query("op3_url_filters", """
WITH p AS (SELECT page_id, url, DATE '2024-01-01' + (('0x' || substr(md5(url), 1, 4))::INT % 366) AS day, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
  list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS steps FROM pages),
h AS (SELECT DISTINCT host AS k FROM p WHERE host <> ''), s AS (SELECT DISTINCT host || '/' || steps[1] AS k FROM p WHERE host <> '' AND len(steps) > 0),
d AS (SELECT DISTINCT array_to_string(list_slice(string_split(k, '.'), -2, -1), '.') AS k FROM h),
e AS (SELECT 'hosts' AS list, 'block' AS verdict, 'add' AS action, k, DATE '2024-01-01' + 9 * {d2} AS day FROM h WHERE {d1} < 8 UNION ALL
  SELECT 'hosts', 'block', 'remove', k, DATE '2024-01-01' + 9 * {d2} + 20 + 9 * {d3} FROM h WHERE {d1} < 4 UNION ALL
  SELECT 'hosts', 'block', 'add', k, DATE '2024-01-01' + 9 * {d2} + 70 + 18 * {d3} FROM h WHERE {d1} < 2 UNION ALL
  SELECT 'hosts', 'allow', 'add', k, DATE '2024-01-01' + 9 * {d2} + 45 + 9 * {d3} FROM h WHERE {d1} BETWEEN 4 AND 5 UNION ALL
  SELECT 'domains', 'block', 'add', k, DATE '2024-01-01' + 15 * {d2} FROM d WHERE {d1} < 4 UNION ALL
  SELECT 'sections', 'allow', 'add', k, DATE '2024-01-01' + 12 * {d2} FROM s WHERE {d1} < 6 UNION ALL
  SELECT 'sections', 'allow', 'remove', k, DATE '2024-01-01' + 12 * {d2} + 60 FROM s WHERE {d1} < 3),
t AS (SELECT list, k, day, max(verdict) AS verdict, bool_and(action = 'add') AS active FROM e GROUP BY 1, 2, 3),
n AS (SELECT *, CASE WHEN active THEN '+' || coalesce(verdict, '') ELSE '-' END AS now FROM t), u AS (SELECT *, lag(now) OVER w AS was FROM n WINDOW w AS (PARTITION BY list, k ORDER BY day)),
v AS (SELECT *, lead(day) OVER (PARTITION BY list, k ORDER BY day) AS until FROM u WHERE was IS NULL OR was <> now),
i AS (SELECT list, verdict, k, day AS since, until FROM v WHERE active),
a AS (SELECT DISTINCT url, day, host, steps FROM p WHERE host <> ''),
x AS (SELECT url, day, unnest(list_distinct(list_concat(list_transform(range(1, len(string_split(host, '.')) + 1), lambda n: array_to_string(list_slice(string_split(host, '.'), n, 1000), '.')),
  list_transform(range(1, len(steps) + 1), lambda n: host || '/' || array_to_string(list_slice(steps, 1, n), '/'))))) AS k FROM a),
b AS (SELECT x.url, x.day, i.*, row_number() OVER (PARTITION BY x.url, x.day ORDER BY length(i.k) DESC, (verdict = 'allow') DESC, list DESC, since DESC) AS r FROM x JOIN i ON x.k = i.k AND since <= x.day AND (until IS NULL OR x.day < until))
SELECT p.page_id, p.url, p.day, coalesce(b.verdict, 'none') AS decision, b.list AS matched_list, b.k AS matched_key, b.since AS matched_since FROM p LEFT JOIN b ON b.url = p.url AND b.day = p.day AND b.r = 1
""".format(**{f"d{k}": DIGIT.format(c="k", k=k) for k in (1, 2, 3)}))
def url_filters(spark, sf):
    pages = table(spark, sf, "pages")
    epoch = F.lit("2024-01-01").cast("date")
    captures = pages.select("page_id", "url", F.date_add(epoch, (F.conv(F.substring(F.md5("url"), 1, 4), 16, 10).cast("int") % 366)).alias("day"))
    # dated list entries drawn from the hosts, their domains and first path sections
    keys = urls.keys_of("url")
    host = pages.select(urls.host_of("url").alias("key")).where("key <> ''").distinct()
    domain = host.select(F.array_join(F.slice(F.split("key", r"\."), F.greatest(F.size(F.split("key", r"\.")) - 1, F.lit(1)), 2), ".").alias("key")).distinct()
    section = pages.select(F.filter(keys, lambda k: F.size(F.split(k, "/")) == 2)[0].alias("key")).where("key is not null").distinct()

    def entries(frame, name, verdict, action, below, day):
        return frame.where(digit("key", 1) < below).select(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), F.lit(action).alias("action"), "key", F.date_add(epoch, day).alias("day"))

    two, three = digit("key", 2), digit("key", 3)
    dated = (entries(host, "hosts", "block", "add", 8, 9 * two).unionAll(entries(host, "hosts", "block", "remove", 4, 9 * two + 20 + 9 * three))
             .unionAll(entries(host, "hosts", "block", "add", 2, 9 * two + 70 + 18 * three))
             .unionAll(entries(host.where(digit("key", 1) >= 4), "hosts", "allow", "add", 6, 9 * two + 45 + 9 * three))  # the verdict of a listed host changes
             .unionAll(entries(domain, "domains", "block", "add", 4, 15 * two))
             .unionAll(entries(section, "sections", "allow", "add", 6, 12 * two)).unionAll(entries(section, "sections", "allow", "remove", 3, 12 * two + 60)))
    return urls.decide(captures, dated)


@query("op4_warc", """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages), d AS (SELECT page_id, strlen(body)::BIGINT AS n, sha1(body) AS s, max(page_id) OVER (PARTITION BY body) AS k FROM p)
SELECT page_id, n AS payload_bytes, translate(array_to_string(list_transform(range(0, 8), lambda i: to_base(('0x' || substr(s, 5 * i + 1, 5))::BIGINT, 32, 4)), ''), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = k THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> k THEN k END AS refers_to FROM d""")
def warc_archive(spark, sf):
    folder = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf, "pages"), folder)
    return warc.read_archive(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op5_kneser_ney")
def kneser_ney(spark, sf):
    return kneser.classify(table(spark, sf, "documents"), table(spark, sf, "labels"), (F.col("quality") == 1) & (F.col("toxic") == 0)).select(
        "doc_id", "lang", "n_chars", F.round("perplexity", 4).alias("perplexity"), F.round("threshold", 4).alias("threshold"), "kept")


@query("op6_suffix_array")
def suffix_array(spark, sf):
    return suffixes.deduplicate(table(spark, sf, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_qgram_decontamination")
def qgram_decontamination(spark, sf):
    return decontaminate.matches(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query("op8_token_counts")
def token_counts(spark, sf):
    return lengths.limits(lengths.histogram(lengths.lengths(table(spark, sf, "documents"))))


@query("op9_simhash_trie")
def simhash_trie(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents")).select("doc_id", "fingerprint", "component_id")


@query("op10_hilbert_sharding")
def hilbert_sharding(spark, sf):
    return hilbert.assign(table(spark, sf, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "h")


# a round of the twin: every vector against every centroid, then floor(sum / count) per component; empty centroids stay
ROUND = """
d{i} AS MATERIALIZED (SELECT vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{i}),
a{i} AS MATERIALIZED (SELECT vec_id, any_value(v) AS v, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{i} GROUP BY 1),
m{i} AS (SELECT k, i, floor(sum(x)::DOUBLE / count(*))::BIGINT AS x FROM (SELECT k, unnest(range(1, 65)) AS i, unnest(v) AS x FROM a{i}) GROUP BY 1, 2),
c{j} AS MATERIALIZED (SELECT c.k, coalesce(n.c, c.c) AS c FROM c{i} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS c FROM m{i} GROUP BY 1) n ON n.k = c.k)"""


@query("op11_centroid_clustering", """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS k, v AS c FROM (SELECT v, sha256('1:' || vec_id) AS h FROM v ORDER BY h LIMIT 16)),""" + ",".join(ROUND.format(i=i, j=i + 1) for i in range(4)) + """
SELECT a.vec_id, a.k::INT AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
FROM a3 a JOIN c3 c ON c.k = a.k""")
def centroid_clustering(spark, sf):
    found = centroids.cluster(table(spark, sf, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


@query("op12_embedding_whitening")
def embedding_whitening(spark, sf):
    return whitening.whiten(table(spark, sf, "embeddings"))


@query("op13_fm_index")
def fm_index(spark, sf):
    return fmindex.deduplicate(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
