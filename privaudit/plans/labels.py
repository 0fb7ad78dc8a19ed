"""Clause labels, thresholds, similarity and extraction metrics on the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.operators import evaluate, labels, policy
from privaudit.plans.registry import query
from privaudit.session import table

# --- clause presence --------------------------------------------------------------------------------

@query("clause_completeness", """
WITH f AS (SELECT DISTINCT (p_partkey * 7 + p_size) % 25 AS package, p_type AS label FROM part),
a AS (SELECT DISTINCT p_type AS label FROM part), p AS (SELECT n_nationkey AS package FROM nation)
SELECT p.package, coalesce(string_agg(a.label, ',' ORDER BY a.label) FILTER (f.label IS NOT NULL), '') AS included,
       coalesce(string_agg(a.label, ',' ORDER BY a.label) FILTER (f.label IS NULL), '') AS missing, round(count(f.label) * 100.0 / count(*), 1)::DOUBLE AS score
FROM p CROSS JOIN a LEFT JOIN f ON f.package = p.package AND f.label = a.label GROUP BY 1""")
def clause_completeness(spark, sf):
    """Part types found per nation against all part types."""
    found = table(spark, sf, "part").select(((F.col("p_partkey") * 7 + F.col("p_size")) % 25).alias("package"), F.col("p_type").alias("label"))
    names = table(spark, sf, "part").select(F.col("p_type").alias("name"))
    packages = table(spark, sf, "nation").select(F.col("n_nationkey").alias("package"))
    c = labels.completeness(labels.clause_presence(found, names, packages))
    return c.withColumn("included", F.array_join("included", ",")).withColumn("missing", F.array_join("missing", ","))


TREE_NODES = [("1", None, 1), ("1.1", "1", 2), ("1.2", "1", 2), ("1.2.1", "1.2", 3), ("1.2.2", "1.2", 3), ("2", None, 1)]


@query("clause_tree_status", """
WITH t AS (SELECT * FROM (VALUES ('1', NULL, 1), ('1.1', '1', 2), ('1.2', '1', 2), ('1.2.1', '1.2', 3), ('1.2.2', '1.2', 3), ('2', NULL, 1)) v(id, parent, depth)),
s AS (SELECT l_suppkey AS package, id, depth, parent, bool_or(l_quantity = 1 AND l_linenumber = length(id) + depth) AS included, bool_or(l_quantity = 1 AND l_partkey % 997 = depth) AS missing
      FROM lineitem CROSS JOIN t GROUP BY ALL),
d3 AS (SELECT package, id, depth, parent, included AND NOT missing AS present FROM s WHERE depth = 3),
d2 AS (SELECT s.package, s.id, s.depth, s.parent, (included OR coalesce((SELECT bool_or(present) FROM d3 WHERE d3.package = s.package AND d3.parent = s.id), false)) AND NOT missing AS present FROM s WHERE depth = 2),
d1 AS (SELECT s.package, s.id, s.depth, s.parent, (included OR coalesce((SELECT bool_or(present) FROM d2 WHERE d2.package = s.package AND d2.parent = s.id), false)) AND NOT missing AS present FROM s WHERE depth = 1)
SELECT package, id, depth, present FROM d1 UNION ALL SELECT package, id, depth, present FROM d2 UNION ALL SELECT package, id, depth, present FROM d3""")
def clause_tree_status(spark, sf):
    tree = spark.createDataFrame(TREE_NODES, "id string, parent_id string, depth int")
    one = F.col("l_quantity") == 1
    tests = [x for i, (n, _, d) in enumerate(TREE_NODES) for x in (
        F.bool_or(one & (F.col("l_linenumber") == len(n) + d)).alias(f"in{i}"), F.bool_or(one & (F.col("l_partkey") % 997 == d)).alias(f"out{i}"))]
    wide = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("package")).agg(*tests)
    rows = F.array(*[F.struct(F.lit(n).alias("id"), F.col(f"in{i}").alias("included"), F.col(f"out{i}").alias("missing")) for i, (n, _, _) in enumerate(TREE_NODES)])
    st = wide.select("package", F.explode(rows).alias("r")).select("package", "r.*")
    return labels.clause_tree_status(st, tree)


# --- counts -----------------------------------------------------------------------------------------

TRUTH_SQL = """
WITH t AS (SELECT doc_id AS row_id, 'quality' AS label, quality AS truth FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)
"""


def truth_rows(spark, sf) -> DataFrame:
    both = F.array(F.struct(F.lit("quality").alias("label"), F.col("quality").alias("truth")), F.struct(F.lit("toxic").alias("label"), F.col("toxic").alias("truth")))
    return table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.explode(both).alias("x")).select("row_id", "x.*")


@query("label_counts_ic", TRUTH_SQL + """
SELECT label, sum(truth)::BIGINT AS n_pos, count(*) AS n_rows, round((sum(truth) + 1) / (count(*) + 2), 9)::DOUBLE AS p, round(-ln((sum(truth) + 1) / (count(*) + 2)), 9) AS ic FROM t GROUP BY label""")
def label_counts_ic(spark, sf):
    r = labels.label_ic(truth_rows(spark, sf))
    return r.withColumn("p", F.round("p", 9)).withColumn("ic", F.round("ic", 9))


@query("class_weight", TRUTH_SQL + """
SELECT label, count(*) FILTER (truth = 1) AS n_pos, count(*) FILTER (truth = 0) AS n_neg, round(count(*) FILTER (truth = 0) / (count(*) FILTER (truth = 1) + 1e-8), 6) AS weight FROM t GROUP BY label""")
def class_weight(spark, sf):
    return labels.class_weights(truth_rows(spark, sf)).withColumn("weight", F.round("weight", 6))


SCORE_SQL = TRUTH_SQL + """
, s AS (SELECT label, row_id, truth, ((n_chars * CASE label WHEN 'toxic' THEN 7 ELSE 1 END) % 100)::INT AS score_pct FROM t JOIN documents ON row_id = doc_id),
g AS (SELECT unnest(range(10, 90, 5)) AS t),
c AS (SELECT label, g.t, sum((score_pct >= g.t AND truth = 1)::INT) AS tp, sum((score_pct >= g.t AND truth = 0)::INT) AS fp, sum(truth) AS pos FROM s CROSS JOIN g GROUP BY 1, 2),
f AS (SELECT *, round(2 * tp / (2 * tp + fp + pos - tp + 1e-8), 9) AS f1 FROM c),
b AS (SELECT label, t, f1, pos, row_number() OVER (PARTITION BY label ORDER BY f1 DESC, t) AS rn FROM f),
th AS (SELECT label, CASE WHEN pos = 0 THEN 0.5 ELSE t / 100.0 END::DOUBLE AS threshold, CASE WHEN pos = 0 THEN 0.0 ELSE f1 END::DOUBLE AS f1 FROM b WHERE rn = 1)
"""


def score_rows(spark, sf) -> DataFrame:
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "n_chars")
    pct = ((F.col("n_chars") * F.when(F.col("label") == "toxic", 7).otherwise(1)) % 100).cast("int")
    return truth_rows(spark, sf).join(d, "row_id").select("row_id", "label", "truth", pct.alias("score_pct"))


@query("threshold_search", SCORE_SQL + "SELECT label, threshold, f1 FROM th")
def threshold_search(spark, sf):
    return labels.best_thresholds(score_rows(spark, sf))


@query("label_metrics", SCORE_SQL + """
, p AS (SELECT row_id, s.label, (score_pct >= threshold * 100)::INT AS pred, truth FROM s JOIN th USING (label)),
r AS (SELECT avg(ok::INT) AS accuracy FROM (SELECT row_id, bool_and(pred = truth) AS ok FROM p GROUP BY 1)),
l AS (SELECT label, sum((pred = 1 AND truth = 1)::INT) AS tp, sum((pred = 1 AND truth = 0)::INT) AS fp, sum((pred = 0 AND truth = 1)::INT) AS fn FROM p GROUP BY 1),
m AS (SELECT 2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)) AS f1_micro, avg(2 * tp / (2 * tp + fp + fn)) AS f1_macro, sum(2 * tp / (2 * tp + fp + fn) * (tp + fn)) / sum(tp + fn) AS f1_weighted FROM l)
SELECT round(f1_micro, 6) AS f1_micro, round(f1_macro, 6) AS f1_macro, round(f1_weighted, 6) AS f1_weighted, round(accuracy, 6) AS accuracy,
       (SELECT round(avg(threshold), 6) FROM th) AS threshold_mean, (SELECT round(stddev_pop(threshold), 6) FROM th) AS threshold_std FROM m, r""")
def label_metrics(spark, sf):
    s = score_rows(spark, sf)
    th = labels.best_thresholds(s)
    pred = s.join(th.select("label", "threshold"), "label").withColumn("pred", (F.col("score_pct") >= F.round(F.col("threshold") * 100)).cast("int"))
    m = labels.multilabel_metrics(pred, th)
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("score_labels", """
SELECT d.doc_id, l.label_idx, 'n' || l.label_idx AS name FROM documents d CROSS JOIN (VALUES (0, 0), (1, 2), (2, 3)) l(new_idx, label_idx)
WHERE ((d.n_chars + l.new_idx * 37) % 100) / 100.0 >= 0.5""")
def score_labels(spark, sf):
    """A score vector per document, per-label thresholds and the dense label index with one label removed."""
    dim = spark.createDataFrame([(i, f"n{i}") for i in range(4)], "label_idx int, name string")
    idx = policy.label_index(dim, [1])
    scores = F.array(*[((F.col("n_chars") + i * 37) % 100) / 100.0 for i in range(3)])
    d = table(spark, sf, "documents").select("doc_id", scores.alias("scores"))
    return policy.labels_from_scores(d, idx).select("doc_id", "label_idx", "name")


@query("model_scoring", """
SELECT conv_id, turn, round(CASE WHEN length(text) % 2 = 0 THEN 1.0 ELSE 0.0 END, 6)::DOUBLE AS s0, round((length(text) % 10) / 10.0, 6)::DOUBLE AS s1 FROM conversations""")
def model_scoring(spark, sf):
    """A stand-in model plugged into the batch scorer."""
    def model(texts):
        return [[1.0 if len(t) % 2 == 0 else 0.0, (len(t) % 10) / 10.0] for t in texts]
    s = policy.score_sentences(table(spark, sf, "conversations").select("conv_id", "turn", "text"), model)
    return s.select("conv_id", "turn", F.round(F.get("scores", F.lit(0)), 6).alias("s0"), F.round(F.get("scores", F.lit(1)), 6).alias("s1"))


@query("label_one_hot", """
SELECT DISTINCT doc_id AS row_id, CASE l WHEN 0 THEN 0 WHEN 2 THEN 1 ELSE 2 END::INT AS new_idx FROM (SELECT doc_id, unnest([quality * 2, toxic + 1, 3]) AS l FROM labels) WHERE l <> 1""")
def label_one_hot(spark, sf):
    dim = spark.createDataFrame([(i, f"n{i}") for i in range(4)], "label_idx int, name string")
    rows = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.array(F.col("quality") * 2, F.col("toxic") + 1, F.lit(3)).alias("ids"))
    return labels.one_hot(rows, policy.label_index(dim, [1]), "ids")


# --- trees ------------------------------------------------------------------------------------------
# regions, nations and the market segments of their customers form the label forest

TREE_SQL = """
WITH t AS (
  SELECT DISTINCT r_name AS node, NULL::VARCHAR AS parent FROM region UNION SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT DISTINCT n_name || '/' || c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
a AS (SELECT node, node AS anc, 0 AS up FROM t UNION ALL SELECT node, parent, 1 FROM t WHERE parent IS NOT NULL
      UNION ALL SELECT t.node, p.parent, 2 FROM t JOIN t p ON t.parent = p.node WHERE p.parent IS NOT NULL)
"""


def label_forest(spark, sf) -> DataFrame:
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    c = table(spark, sf, "customer").select("c_nationkey", "c_mktsegment").distinct()
    roots = r.select(F.col("r_name").alias("node"), F.lit(None).cast("string").alias("parent"))
    mid = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("node"), F.col("r_name").alias("parent"))
    leaf = c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat_ws("/", "n_name", "c_mktsegment").alias("node"), F.col("n_name").alias("parent"))
    return roots.unionByName(mid).unionByName(leaf)


@query("label_tree_similarity", TREE_SQL + """
SELECT i.node AS node_i, j.node AS node_j, min(i.up + j.up) AS distance, round(1.0 / (1.0 + min(i.up + j.up)), 6)::DOUBLE AS sim FROM a i JOIN a j ON i.anc = j.anc AND i.node <= j.node GROUP BY 1, 2""")
def label_tree_similarity(spark, sf):
    return labels.tree_similarity(label_forest(spark, sf), 3).withColumn("sim", F.round("sim", 6))


@query("lin_similarity", TREE_SQL + """
, k AS (SELECT n_name || '/' || c_mktsegment AS node, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1),
ic AS (SELECT a.anc AS node, -ln((coalesce(sum(n), 0) + 1) / ((SELECT count(*) FROM customer) + 2)) AS ic FROM a LEFT JOIN k ON a.node = k.node GROUP BY 1),
l AS (SELECT i.node AS node_i, j.node AS node_j, max(ic) AS lca FROM a i JOIN a j ON i.anc = j.anc AND i.node <= j.node JOIN ic ON ic.node = i.anc GROUP BY 1, 2)
SELECT node_i, node_j, round(CASE WHEN node_i = node_j THEN 1.0 ELSE 2 * lca / (x.ic + y.ic + 1e-8) END, 6) AS sim FROM l JOIN ic x ON x.node = node_i JOIN ic y ON y.node = node_j""")
def lin_similarity(spark, sf):
    tree = label_forest(spark, sf)
    n = table(spark, sf, "nation")
    cust = table(spark, sf, "customer")
    per = cust.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    k = per.join(n, per.c_nationkey == n.n_nationkey).select(F.concat_ws("/", "n_name", "c_mktsegment").alias("node"), "n")
    up = labels.ancestors(tree, 3).join(k, "node", "left").groupBy(F.col("ancestor").alias("label")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pos"))
    rows = up.withColumn("n_rows", cust.agg(F.count("*")).scalar())
    ic = rows.select(F.col("label").alias("node"), (-F.log((F.col("n_pos") + 1) / (F.col("n_rows") + 2))).alias("ic"))
    return labels.lin_similarity(tree, ic, 3).withColumn("sim", F.round("sim", 6))


# --- extraction metrics -------------------------------------------------------------------------------
# gold: words of a turn, labelled by length; predicted: words of the next turn of the same conversation

WORDS_SQL = """
WITH w AS (SELECT conv_id * 1000 + turn AS sent_id, conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM conversations),
gold AS (SELECT DISTINCT sent_id, 'l' || (length(word) % 4) AS label, '您的' || word || '和' || left(word, 2) AS text FROM w),
pred AS (SELECT DISTINCT sent_id - 1 AS sent_id, 'l' || (length(word) % 5) AS label, word AS text FROM w)
"""


def gold_and_pred(spark, sf):
    w = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("sent_id"), "turn", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), F.lit(0))).alias("word"))
    lab = lambda m: F.concat(F.lit("l"), (F.length("word") % m).cast("string")).alias("label")
    gold = w.select("sent_id", lab(4), F.concat(F.lit("您的"), "word", F.lit("和"), F.left("word", F.lit(2))).alias("text")).distinct()
    pred = w.select((F.col("sent_id") - 1).alias("sent_id"), lab(5), F.col("word").alias("text")).distinct()
    return gold, pred


METRIC_SQL = """
, c AS (SELECT coalesce(g.label, p.label) AS label, count(*) FILTER (g.text IS NOT NULL AND p.text IS NOT NULL) AS tp, count(*) FILTER (g.text IS NULL) AS fp, count(*) FILTER (p.text IS NULL) AS fn
  FROM g2 g FULL JOIN p2 p ON g.sent_id = p.sent_id AND g.label = p.label AND g.text = p.text GROUP BY 1),
k AS (SELECT c.*, {keep} AS keep FROM c),
r AS (SELECT label, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM k WHERE keep),
f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1, tp + fn AS support FROM r),
m AS (SELECT 'micro' AS label, sum(CASE WHEN keep THEN tp ELSE 0 END) AS tp, sum(fp) AS fp, sum(CASE WHEN keep THEN fn ELSE 0 END) AS fn FROM k)
SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(p, 6) AS p, round(r, 6) AS r, round(f1, 6) AS f1, support::BIGINT AS support FROM (
  SELECT * FROM f UNION ALL SELECT 'macro', sum(tp), sum(fp), sum(fn), avg(p), avg(r), avg(f1), sum(support) FROM f
  UNION ALL SELECT label, tp, fp, fn, tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM m)"""
SPLIT_SQL = "SELECT DISTINCT sent_id, label, unnest(list_filter(regexp_split_to_array(regexp_replace(text, '^(您的|你的|您|的|部分|必要的|相关的|一些|某种)\\s*', ''), '[、，,;和\\s]+'), lambda x: x <> '')) AS text FROM "


def _rounded(df):
    return df.select("label", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("p", "r", "f1")], "support")


@query("entity_metrics", WORDS_SQL + f", g2 AS ({SPLIT_SQL} gold), p2 AS ({SPLIT_SQL} (SELECT * FROM pred WHERE sent_id IN (SELECT sent_id FROM gold)))"
       + METRIC_SQL.format(keep="label IN (SELECT label FROM gold)"))
def entity_metrics(spark, sf):
    return _rounded(evaluate.entity_metrics(*gold_and_pred(spark, sf)))


@query("entity_metrics_plain", WORDS_SQL + ", g2 AS (SELECT * FROM gold), p2 AS (SELECT sent_id, label, '您的' || text || '和' || left(text, 2) AS text FROM pred)" + METRIC_SQL.format(keep="true"))
def entity_metrics_plain(spark, sf):
    gold, pred = gold_and_pred(spark, sf)
    pred = pred.withColumn("text", F.concat(F.lit("您的"), "text", F.lit("和"), F.left("text", F.lit(2))))
    return _rounded(evaluate.entity_metrics(gold, pred, process=False, gold_sentences_only=False, gold_labels_only=False))


RUNS_SQL = """
WITH r AS (SELECT (l_linenumber % 2)::INT AS label, (l_partkey % 2)::INT AS rag, (l_suppkey % 2)::INT AS filter, avg(l_discount) AS micro_f1 FROM lineitem GROUP BY 1, 2, 3)
"""


def ablation_runs(spark, sf) -> DataFrame:
    bit = lambda c, n: (F.col(c) % 2).cast("int").alias(n)
    return table(spark, sf, "lineitem").groupBy(bit("l_linenumber", "label"), bit("l_partkey", "rag"), bit("l_suppkey", "filter")).agg(F.avg("l_discount").alias("micro_f1"))


@query("factor_effects", RUNS_SQL + """
, x AS (SELECT unnest(['label', 'rag', 'filter']) AS factor, unnest([label, rag, filter]) AS level, micro_f1 FROM r),
g AS (SELECT factor, avg(micro_f1) FILTER (level = 1) AS a, avg(micro_f1) FILTER (level = 0) AS b, count(*) FILTER (level = 1) AS n_on, count(*) FILTER (level = 0) AS n_off FROM x GROUP BY 1)
SELECT factor, round(a, 6) AS avg_on, round(b, 6) AS avg_off, n_on, n_off, round(a - b, 6) AS diff, CASE WHEN a - b > 0.005 THEN '正向' WHEN a - b < -0.005 THEN '负向' ELSE '无显著' END AS effect FROM g""")
def factor_effects(spark, sf):
    r = evaluate.factor_effects(ablation_runs(spark, sf), ["label", "rag", "filter"])
    return r.select("factor", F.round("avg_on", 6).alias("avg_on"), F.round("avg_off", 6).alias("avg_off"), "n_on", "n_off", F.round("diff", 6).alias("diff"), "effect")


@query("ranked_runs", RUNS_SQL + "SELECT label, rag, filter, round(micro_f1, 6) AS micro_f1, round(micro_f1 - max(micro_f1) OVER (), 6) AS gap FROM r")
def ranked_runs(spark, sf):
    r = evaluate.ranked_runs(ablation_runs(spark, sf))
    return r.select("label", "rag", "filter", F.round("micro_f1", 6).alias("micro_f1"), F.round("gap", 6).alias("gap"))


@query("run_difference", """
WITH g AS (SELECT l_returnflag AS run, avg(l_discount) AS micro_f1, avg(l_tax) AS macro_f1 FROM lineitem GROUP BY 1)
SELECT metric, round(a, 6) AS a, round(b, 6) AS b, round(a - b, 6) AS diff FROM (
  SELECT 'micro_f1' AS metric, max(micro_f1) FILTER (run = 'A') AS a, max(micro_f1) FILTER (run = 'R') AS b FROM g UNION ALL SELECT 'macro_f1', max(macro_f1) FILTER (run = 'A'), max(macro_f1) FILTER (run = 'R') FROM g)""")
def run_difference(spark, sf):
    g = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("run")).agg(F.avg("l_discount").alias("micro_f1"), F.avg("l_tax").alias("macro_f1"))
    r = evaluate.run_difference(g, "run", "A", "R", ["micro_f1", "macro_f1"])
    return r.select("metric", *[F.round(c, 6).alias(c) for c in ("a", "b", "diff")])


@query("filter_saving", """
SELECT role, count(*) AS calls_before, count(*) FILTER (length(text) >= 100) AS calls_after, count(*) FILTER (length(text) < 100) AS filtered,
       round(count(*) FILTER (length(text) < 100) * 100.0 / count(*), 6)::DOUBLE AS saved_pct FROM conversations GROUP BY 1""")
def filter_saving(spark, sf):
    c = table(spark, sf, "conversations").select("role", (F.length("text") < 100).alias("skipped"))
    return evaluate.filter_saving(c, "skipped", "role").withColumn("saved_pct", F.round("saved_pct", 6))
