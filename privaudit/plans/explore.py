"""Exploration metrics on the events table: user = run, event = step, event type = state and API."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.functions import scalars as S
from privaudit.operators import explore, joins
from privaudit.plans.registry import query
from privaudit.session import table

KEYS, ORDER = ["run_id"], ["ts", "event_id"]


def steps(spark, sf) -> DataFrame:
    e = F.col("event_type")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), "ts", "event_id", F.col("value").alias("reward"),
        F.when(F.col("event_id") % 3 == 0, F.array(e, F.concat(F.lit("x"), (F.col("event_id") % 4).cast("string")))).otherwise(F.array(e)).alias("api_list"),
        F.when(e == "error", "unknown").otherwise(e).alias("activity"), F.concat(e, (F.col("event_id") % 2).cast("string")).alias("state_id"),
        (F.col("value") / 100).alias("xml_score"), (F.col("event_id") % 4 != 0).alias("img_same"), (F.col("event_id") % 50 == 0).alias("recovered"))


STEPS_SQL = """
WITH s AS (SELECT user_id AS run_id, ts, event_id, value AS reward, CASE WHEN event_id % 3 = 0 THEN [event_type, 'x' || (event_id % 4)] ELSE [event_type] END AS api_list,
  CASE WHEN event_type = 'error' THEN 'unknown' ELSE event_type END AS activity, event_type || (event_id % 2) AS state_id, value / 100 AS xml_score, event_id % 4 <> 0 AS img_same, event_id % 50 = 0 AS recovered FROM events)
"""


@query("running_metrics", STEPS_SQL + """
, a AS (SELECT run_id, ts, event_id, unnest(api_list) AS api FROM s), fa AS (SELECT *, row_number() OVER (PARTITION BY run_id, api ORDER BY ts, event_id) = 1 AS first FROM a),
na AS (SELECT run_id, event_id, count(*) FILTER (first) AS n FROM fa GROUP BY 1, 2),
nt AS (SELECT run_id, event_id, (row_number() OVER (PARTITION BY run_id, activity ORDER BY ts, event_id) = 1 AND activity <> 'unknown')::INT AS n FROM s)
SELECT s.run_id, s.event_id, round(sum(reward) OVER w, 2) AS cum_reward, (sum(na.n) OVER w)::BIGINT AS unique_apis, (sum(nt.n) OVER w)::BIGINT AS unique_activities, len(api_list)::INT AS api_count
FROM s JOIN na ON na.event_id = s.event_id JOIN nt ON nt.event_id = s.event_id WINDOW w AS (PARTITION BY s.run_id ORDER BY s.ts, s.event_id ROWS UNBOUNDED PRECEDING)""")
def running_metrics(spark, sf):
    r = explore.running_metrics(steps(spark, sf), KEYS, ORDER)
    return r.select("run_id", "event_id", F.round("cum_reward", 2).alias("cum_reward"), "unique_apis", "unique_activities", "api_count")


@query("novelty_decay", STEPS_SQL + """
, a AS (SELECT run_id, ts, event_id, state_id, unnest(api_list) AS api, generate_subscripts(api_list, 1) AS pos FROM s),
n AS (SELECT *, row_number() OVER (PARTITION BY run_id, api ORDER BY ts, event_id, pos) AS nth, row_number() OVER (PARTITION BY run_id, state_id, api ORDER BY ts, event_id) = 1 AS fresh FROM a)
SELECT run_id, event_id, count(*) FILTER (fresh) AS new_pairs, round(CASE WHEN count(*) FILTER (fresh) > 0 THEN sum(10.0 * power(0.5, nth - 1)) ELSE 0 END, 6)::DOUBLE AS api_score FROM n GROUP BY 1, 2""")
def novelty_decay(spark, sf):
    r = explore.novelty_scores(steps(spark, sf), KEYS, ORDER)
    return r.select("run_id", "event_id", "new_pairs", F.round("api_score", 6).alias("api_score"))


@query("novelty_modes", STEPS_SQL + """
, a AS (SELECT run_id, ts, event_id, state_id, unnest(api_list) AS api FROM s),
n AS (SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id, state_id, api ORDER BY ts, event_id) = 1 AS fresh FROM a),
g AS (SELECT run_id, event_id, count(*) FILTER (fresh) AS new_pairs FROM n GROUP BY 1, 2)
SELECT s.run_id, s.event_id, 0.0::DOUBLE AS off, CASE WHEN coalesce(new_pairs, 0) > 0 THEN 10.0 ELSE 0.0 END::DOUBLE AS once, CASE WHEN len(api_list) > 0 THEN 10.0 ELSE 0.0 END::DOUBLE AS any_api
FROM s LEFT JOIN g ON g.run_id = s.run_id AND g.event_id = s.event_id""")
def novelty_modes(spark, sf):
    """Score of every step when novelty is off, paid once per new pair, and paid for any API."""
    s = steps(spark, sf)
    off, once, any_api = (explore.novelty_scores(s, KEYS, ORDER, mode).select(*KEYS, "event_id", F.col("api_score").alias(name)) for mode, name in ((0, "off"), (1, "once"), (3, "any_api")))
    return off.join(once, [*KEYS, "event_id"]).join(any_api, [*KEYS, "event_id"]).select("run_id", "event_id", "off", "once", "any_api")


STUCK_SQL = STEPS_SQL + """
, v AS (SELECT *, ((coalesce(state_id = lag(state_id) OVER w, false))::INT + (xml_score > 0.97)::INT + img_same::INT) >= 2 AND NOT recovered AS is_stuck FROM s WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)),
l AS (SELECT *, lag(is_stuck) OVER w AS was FROM v WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)),
g AS (SELECT *, sum((was IS NULL OR was <> is_stuck)::INT) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM l),
k AS (SELECT *, CASE WHEN is_stuck THEN row_number() OVER (PARTITION BY run_id, grp ORDER BY ts, event_id) ELSE 0 END AS stuck_run FROM g)
"""


@query("stuck_runs", STUCK_SQL + "SELECT run_id, event_id, is_stuck, coalesce(was, false) AS was_stuck, stuck_run, stuck_run >= 3 AS trapped FROM k")
def stuck_runs(spark, sf):
    r = explore.stuck_runs(steps(spark, sf), KEYS, ORDER, trapped_at=3)
    return r.select("run_id", "event_id", "is_stuck", "was_stuck", "stuck_run", "trapped")


@query("step_scores", STUCK_SQL + """
, f AS (SELECT *, row_number() OVER (PARTITION BY run_id, state_id, is_stuck ORDER BY ts, event_id) = 1 AND NOT is_stuck AS fresh FROM k)
SELECT run_id, event_id, CASE WHEN fresh THEN 10.0 WHEN is_stuck THEN 0.0 WHEN coalesce(was, false) OR recovered THEN 12.0 ELSE -2.0 END::DOUBLE AS state_score,
       CASE WHEN is_stuck THEN 0.0 ELSE 0.5 END::DOUBLE AS widget_score, CASE WHEN is_stuck AND stuck_run > 5 THEN -30.0 WHEN is_stuck THEN -15.0 ELSE 0.0 END::DOUBLE AS penalty FROM f""")
def step_scores(spark, sf):
    r = explore.step_scores(explore.stuck_runs(steps(spark, sf), KEYS, ORDER, trapped_at=3), KEYS, ORDER)
    return r.select("run_id", "event_id", "state_score", "widget_score", "penalty")


@query("repeat_runs", STEPS_SQL + """
, l AS (SELECT *, coalesce(activity <> lag(activity) OVER w, true) AS st FROM s WINDOW w AS (PARTITION BY run_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(st::INT) OVER (PARTITION BY run_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM l)
SELECT run_id, event_id, row_number() OVER (PARTITION BY run_id, grp ORDER BY ts, event_id) - 1 AS repeat_count FROM g""")
def repeat_runs(spark, sf):
    return explore.repeat_runs(steps(spark, sf), KEYS, ORDER, "activity").select("run_id", "event_id", "repeat_count")


@query("sample_every_n", """
SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn % 10 = 1""")
def sample_every_n(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "event_type", "ts", "event_id")
    return explore.sample_every(ev, ["user_id", "event_type"], ["ts", "event_id"], 10).select("user_id", "event_type", "event_id")


@query("rate_limit", """
WITH RECURSIVE e AS (SELECT event_type, epoch_ms(ts) AS ms, min((ts, event_id)).event_id AS event_id FROM (SELECT event_type, event_id, ts FROM events) GROUP BY 1, 2),
k AS (SELECT event_type, min(ms) AS ms FROM e GROUP BY 1 UNION ALL SELECT k.event_type, (SELECT min(ms) FROM e WHERE e.event_type = k.event_type AND e.ms >= k.ms + 1800000) FROM k WHERE k.ms IS NOT NULL)
SELECT k.event_type, e.event_id FROM k JOIN e ON e.event_type = k.event_type AND e.ms = k.ms""".replace("min((ts, event_id)).event_id", "arg_min(event_id, (ts, event_id))"))
def rate_limit(spark, sf):
    """At most one event per type in half an hour, counted from the last one kept."""
    ev = table(spark, sf, "events").select("event_type", "ts", "event_id")
    return explore.rate_limited(ev, "event_type", "ts", 1_800_000, chunk_ms=6 * 3_600_000).select("event_type", "event_id")


@query("screen_signature", """
WITH t AS (SELECT user_id AS dump_id, 'c:android.' || event_type AS token, count(*) AS n FROM events GROUP BY 1, 2
           UNION ALL SELECT user_id, 'r:' || regexp_replace(regexp_replace('id/' || event_type || '_' || (event_id % 5) || '__x', '[0-9]+', '', 'g'), '_+', '_', 'g'), count(*) FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY dump_id ORDER BY n DESC, token) AS rn FROM t),
s AS (SELECT dump_id, string_agg(token || '#' || n, '|' ORDER BY rn) AS signature FROM r WHERE rn <= 120 GROUP BY 1)
SELECT dump_id, signature, md5('Main_' || signature) AS state_id FROM s""")
def screen_signature(spark, sf):
    n = table(spark, sf, "events").select(F.col("user_id").alias("dump_id"), F.concat(F.lit("android."), "event_type").alias("class"),
                                          F.concat(F.lit("id/"), "event_type", F.lit("_"), (F.col("event_id") % 5).cast("string"), F.lit("__x")).alias("resource_id"))
    s = explore.screen_signature(explore.structure_tokens(n, ["dump_id"]), ["dump_id"])
    return s.withColumn("state_id", explore.state_id(F.lit("Main"), "signature"))


@query("screen_rollup", "SELECT user_id, event_type AS state_id, count(DISTINCT event_id % 17) AS n_apis, count(DISTINCT props) AS n_widgets FROM events GROUP BY 1, 2")
def screen_rollup(spark, sf):
    v = table(spark, sf, "events").select("user_id", F.col("event_type").alias("state_id"), (F.col("event_id") % 17).alias("api"), F.col("props").alias("widget_id"))
    return explore.screen_rollup(v, ["user_id", "state_id"])


@query("near_duplicate_hash", """
WITH w AS (SELECT doc_id, unnest(list_filter(string_split(lower(text), ' '), lambda x: x <> '')) AS w FROM documents),
b AS (SELECT doc_id, ('0x' || left(md5(w), 2))::BIGINT % 63 AS bit, count(*) AS n FROM w GROUP BY 1, 2), m AS (SELECT doc_id, sum(n) AS total FROM b GROUP BY 1),
h AS (SELECT h, count(*) AS n FROM (SELECT doc_id, sum(CASE WHEN 63 * n > total THEN 1::BIGINT << bit ELSE 0 END)::BIGINT AS h FROM b JOIN m USING (doc_id) GROUP BY 1) GROUP BY 1)
SELECT a.h AS hash_a, a.n AS n_a, b.h AS hash_b, b.n AS n_b, bit_count(xor(a.h, b.h))::INT AS distance FROM h a JOIN h b ON a.h < b.h AND bit_count(xor(a.h, b.h)) <= 3""")
def near_duplicate_hash(spark, sf):
    """Hashes of whole texts at most three bits apart; copies are counted, not paired.

    Bit k of a hash says whether the words of class k are more frequent in the text than an average class of 63, so texts
    with nearly the same words have nearly the same hash.
    """
    words = table(spark, sf, "documents").select("doc_id", F.explode(F.filter(F.split(F.lower("text"), " "), lambda x: x != "")).alias("w"))
    n = words.groupBy("doc_id", (F.conv(F.left(F.md5("w"), F.lit(2)), 16, 10).cast("long") % 63).cast("int").alias("bit")).agg(F.count("*").alias("n"))
    per = n.groupBy("doc_id").agg(F.sum("n").alias("total"), F.collect_list(F.struct("bit", "n")).alias("classes"))  # 63 classes at most
    bits = F.transform("classes", lambda c: F.when(63 * c["n"] > F.col("total"), F.expr("1L")).otherwise(F.expr("0L")))
    h = per.select(F.aggregate(F.arrays_zip(F.col("classes").alias("c"), bits.alias("b")), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(F.call_function("shiftleft", x["b"], x["c"]["bit"]))).alias("h"))
    return joins.hamming_pairs(h, "h", 3)


@query("combined_score", """
WITH s AS (SELECT doc_id, list_reverse_sort([CASE WHEN x < 0.6 THEN 0.0 ELSE x END FOR x IN [(n_chars % 100) / 100.0, (n_chars % 83) / 83.0, (n_chars % 71) / 71.0, (doc_id % 61) / 61.0]]) AS v FROM documents)
SELECT doc_id, round(v[1] * 0.7 + v[2] * 0.7 ** 2 + v[3] * 0.7 ** 3 + v[4] * 0.7 ** 4, 6)::DOUBLE AS score FROM s""")
def combined_score(spark, sf):
    n = F.col("n_chars")
    c = S.combined_score((n % 100) / 100.0, (n % 83) / 83.0, (n % 71) / 71.0, (F.col("doc_id") % 61) / 61.0)
    return table(spark, sf, "documents").select("doc_id", F.round(c, 6).alias("score"))


@query("histogram_distance", """
WITH p AS (SELECT a.vec_id, list_sort(a.embedding::DOUBLE[]) AS x, list_sort(b.embedding::DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(list_sum([abs(x[i] - y[i]) FOR i IN range(1, 65)]) / 64, 6) AS distance FROM p""")
def histogram_distance(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(nxt, "vec_id").select("vec_id", F.round(S.histogram_distance("x", "y"), 6).alias("distance"))


@query("noise_packages", """
SELECT page_id, package, contains(package, 'launcher') OR contains(package, 'ime') AS is_noise FROM (
  SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'com.android.launcher3' WHEN 1 THEN 'com.x.ime' ELSE 'com.shop.k' || page_id END AS package FROM pages)""")
def noise_packages(spark, sf):
    k = F.col("page_id")
    p = table(spark, sf, "pages").select("page_id", F.when(k % 4 == 0, "com.android.launcher3").when(k % 4 == 1, "com.x.ime").otherwise(F.concat(F.lit("com.shop.k"), k.cast("string"))).alias("package"))
    return p.withColumn("is_noise", S.is_noise_package("package", F.lit("com.target.app")))


@query("activity_candidates", "SELECT page_id, 'com.app' || page_id || CASE WHEN page_id % 2 = 0 THEN '.Main' ELSE 'x.Other' END AS activity FROM pages")
def activity_candidates(spark, sf):
    k = F.col("page_id").cast("string")
    dump = F.concat(F.lit("Stack #1\n  ACTIVITY com.app"), k, F.lit("/"), F.when(F.col("page_id") % 2 == 0, ".Main").otherwise(F.concat(F.lit("com.app"), k, F.lit("x.Other"))), F.lit(" pid=1\nnone here"))
    return table(spark, sf, "pages").select("page_id", F.explode(S.activity_candidates(dump)).alias("activity"))
