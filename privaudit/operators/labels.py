"""Clause labels: presence, information content, similarity, thresholds and multi-label metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit import dictionaries as D
from privaudit.session import stored


def clause_presence(found: DataFrame, labels: DataFrame, packages: DataFrame) -> DataFrame:
    """``(package, label, present)`` for every package and label of the fixed dimension.

    The dimension travels as one array literal per package row, so no join on it is planned.
    """
    names = sorted({r[0] for r in labels.select(F.trim("name")).distinct().collect()})
    every = packages.select("package").distinct().withColumn("label", F.explode(F.array(*[F.lit(n) for n in names])))
    hit = found.select("package", F.trim("label").alias("label")).distinct().withColumn("present", F.lit(True))
    return every.join(hit, ["package", "label"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def completeness(presence: DataFrame) -> DataFrame:
    """Included and missing labels (sorted) and the completeness score per package."""
    return presence.groupBy("package").agg(
        F.array_sort(F.collect_set(F.when(F.col("present"), F.col("label")))).alias("included"),
        F.array_sort(F.collect_set(F.when(~F.col("present"), F.col("label")))).alias("missing"),
        F.round(F.count_if("present") * 100.0 / F.count("*"), 1).alias("score"))


def clause_tree_status(status: DataFrame, labels: DataFrame) -> DataFrame:
    """Node is present when it or any child is present, unless it is explicitly missing.

    ``status``: package, id, included, missing. Works upwards one level at a time over the fixed tree, from
    its deepest level.
    """
    max_depth = labels.agg(F.max("depth")).first()[0] or 0
    nodes = status.join(labels.select("id", "parent_id", "depth"), "id")
    level = nodes.filter(F.col("depth") == max_depth).withColumn("present", F.col("included") & ~F.col("missing"))
    out = level
    for d in range(max_depth - 1, 0, -1):
        below = level.groupBy("package", F.col("parent_id").alias("id")).agg(F.bool_or("present").alias("_child"))
        level = (nodes.filter(F.col("depth") == d).join(below, ["package", "id"], "left")
                 .withColumn("present", (F.col("included") | F.coalesce("_child", F.lit(False))) & ~F.col("missing")).drop("_child"))
        out = out.unionByName(level)
    return out.select("package", "id", "depth", "present")


# --- trees ----------------------------------------------------------------------------------------

def ancestors(tree: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``(node, ancestor, up)`` including the node itself; ``tree``: node, parent.

    The tree is a fixed dimension; levels are added until no node has a further ancestor, or up to ``max_depth``.
    """
    edges = tree.select("node", "parent")
    level = edges.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("up"))
    out = level
    deepest = max_depth or tree.count() + 1  # a path cannot be longer, even where parents form a ring
    for i in range(1, deepest):
        step = edges.select(F.col("node").alias("ancestor"), "parent").filter("parent is not null")
        level = level.join(step, "ancestor").select("node", F.col("parent").alias("ancestor"), F.lit(i).alias("up"))
        if max_depth is None and level.isEmpty():
            break
        out = out.unionByName(level)
    return out


def tree_similarity(tree: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``1 / (1 + path length)`` of labels in one tree: ``(node_i, node_j, distance, sim)``, i <= j.

    The label set is a fixed dimension; labels of different trees have no path and no row.
    """
    a = stored(ancestors(tree, max_depth), "ancestors")
    i = a.select(F.col("node").alias("node_i"), "ancestor", F.col("up").alias("up_i"))
    j = a.select(F.col("node").alias("node_j"), "ancestor", F.col("up").alias("up_j"))
    d = i.join(j, "ancestor").filter("node_i <= node_j").groupBy("node_i", "node_j").agg(F.min(F.col("up_i") + F.col("up_j")).alias("distance"))
    return d.withColumn("sim", 1.0 / (1.0 + F.col("distance")))


def lin_similarity(tree: DataFrame, ic: DataFrame, max_depth: int | None = None) -> DataFrame:
    """``2·IC(common ancestor) / (IC_i + IC_j)`` with the most informative common ancestor; ``ic``: node, ic."""
    a = stored(ancestors(tree, max_depth), "ancestors").join(ic.select(F.col("node").alias("ancestor"), F.col("ic").alias("ic_a")), "ancestor", "left")
    i = a.select(F.col("node").alias("node_i"), "ancestor", F.coalesce("ic_a", F.lit(0.0)).alias("ic_a"))
    j = a.select(F.col("node").alias("node_j"), "ancestor")
    common = i.join(j, "ancestor").filter("node_i <= node_j").groupBy("node_i", "node_j").agg(F.max("ic_a").alias("lca_ic"))
    ii = ic.select(F.col("node").alias("node_i"), F.col("ic").alias("ic_i"))
    jj = ic.select(F.col("node").alias("node_j"), F.col("ic").alias("ic_j"))
    zero = (F.coalesce("ic_i", F.lit(0.0)) == 0) | (F.coalesce("ic_j", F.lit(0.0)) == 0)
    sim = F.when(F.col("node_i") == F.col("node_j"), 1.0).when(zero, 0.0) \
        .otherwise(2 * F.col("lca_ic") / (F.col("ic_i") + F.col("ic_j") + 1e-8))
    return common.join(ii, "node_i", "left").join(jj, "node_j", "left").select("node_i", "node_j", sim.alias("sim"))


def label_ic(truth: DataFrame, n_samples: int | None = None) -> DataFrame:
    """Positive count, smoothed probability and information content per label; ``truth``: row_id, label, truth."""
    n = F.lit(n_samples) if n_samples is not None else F.count("*")
    p = (F.col("n_pos") + 1) / (F.col("n_rows") + 2)
    return (truth.groupBy("label").agg(F.sum("truth").alias("n_pos"), n.alias("n_rows"))
            .withColumn("p", p).withColumn("ic", -F.log(F.col("p"))))


def class_weights(truth: DataFrame) -> DataFrame:
    """Negatives over positives per label."""
    return (truth.groupBy("label").agg(F.count_if(F.col("truth") == 1).alias("n_pos"), F.count_if(F.col("truth") == 0).alias("n_neg"))
            .withColumn("weight", F.col("n_neg") / (F.col("n_pos") + 1e-8)))


def one_hot(rows: DataFrame, index: DataFrame, label_ids: str) -> DataFrame:
    """Training labels as long rows with the dense index; removed labels disappear."""
    return rows.select("row_id", F.explode(label_ids).alias("label_idx")).join(index.select("label_idx", "new_idx"), "label_idx") \
        .select("row_id", "new_idx").distinct()


# --- thresholds and metrics -------------------------------------------------------------------------

def best_thresholds(scores: DataFrame, grid=tuple(D.THRESHOLD_PERCENTS)) -> DataFrame:
    """F1-best threshold per label, the lowest on ties, 0.5 without positives; ``scores``: label, score_pct, truth.

    Scores are reduced to one row per (label, percent, truth) first, so the grid multiplies a small table.
    """
    small = scores.groupBy("label", "score_pct", "truth").agg(F.count("*").alias("n"))
    per = (small.withColumn("t", F.explode(F.array(*[F.lit(t) for t in grid]))).groupBy("label", "t").agg(
        F.sum(F.when((F.col("score_pct") >= F.col("t")) & (F.col("truth") == 1), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when((F.col("score_pct") >= F.col("t")) & (F.col("truth") == 0), F.col("n")).otherwise(0)).alias("fp"),
        F.sum(F.when(F.col("truth") == 1, F.col("n")).otherwise(0)).alias("pos")))
    f1 = 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("pos") - F.col("tp") + 1e-8)
    # F1 is compared after rounding so that ties do not depend on the last bit
    best = per.withColumn("f1", F.round(f1, 9)).groupBy("label").agg(
        F.min_by(F.struct("t", "f1"), F.struct(-F.col("f1"), F.col("t"))).alias("b"), F.max("pos").alias("pos"))
    return best.select("label", F.when(F.col("pos") == 0, D.DEFAULT_THRESHOLD).otherwise(F.col("b.t") / 100.0).alias("threshold"),
                       F.when(F.col("pos") == 0, 0.0).otherwise(F.col("b.f1")).alias("f1"))


def multilabel_metrics(pred: DataFrame, thresholds: DataFrame | None = None) -> DataFrame:
    """Subset accuracy and micro, macro and weighted F1; ``pred``: row_id, label, pred, truth."""
    exact = pred.groupBy("row_id").agg(F.bool_and(F.col("pred") == F.col("truth")).alias("ok")).agg(F.avg(F.col("ok").cast("int")))
    per = pred.groupBy("label").agg(
        F.count_if((F.col("pred") == 1) & (F.col("truth") == 1)).alias("tp"),
        F.count_if((F.col("pred") == 1) & (F.col("truth") == 0)).alias("fp"),
        F.count_if((F.col("pred") == 0) & (F.col("truth") == 1)).alias("fn"))

    def f1(tp, fp, fn):
        return F.when(2 * tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0)

    tp, fp, fn = F.sum("tp"), F.sum("fp"), F.sum("fn")
    each = f1(F.col("tp"), F.col("fp"), F.col("fn"))
    support = F.col("tp") + F.col("fn")
    agg = per.withColumn("f1", each).withColumn("support", support).agg(
        f1(tp, fp, fn).alias("f1_micro"), F.avg("f1").alias("f1_macro"),
        F.when(F.sum("support") > 0, F.sum(F.col("f1") * F.col("support")) / F.sum("support")).otherwise(0.0).alias("f1_weighted"))
    out = agg.withColumn("accuracy", exact.scalar())
    if thresholds is not None:
        out = out.withColumn("threshold_mean", thresholds.agg(F.avg("threshold")).scalar()).withColumn("threshold_std", thresholds.agg(F.stddev_pop("threshold")).scalar())
    return out
