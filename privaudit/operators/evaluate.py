"""Entity-extraction metrics and ablation effects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit import dictionaries as D


def entity_rows(sents: DataFrame, col: str) -> DataFrame:
    """``(sent_id, label, text)`` of an entity list, labels lowercased, distinct."""
    return sents.select("sent_id", F.explode(col).alias("e")).select("sent_id", F.lower("e.label").alias("label"), F.col("e.text").alias("text")).distinct()


def postprocess(rows: DataFrame) -> DataFrame:
    """Strip leading modifiers and split parallel phrases."""
    t = F.trim(F.regexp_replace("text", D.ENTITY_PREFIX, ""))
    parts = F.filter(F.split(t, D.ENTITY_SEPARATORS), lambda x: x != "")
    return rows.select("sent_id", "label", F.explode(parts).alias("text")).distinct()


def entity_counts(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """tp, fp and fn per label by set comparison within each sentence."""
    g = gold.select("sent_id", "label", "text", F.lit(1).alias("g"))
    p = pred.select("sent_id", "label", "text", F.lit(1).alias("p"))
    return g.join(p, ["sent_id", "label", "text"], "full").groupBy("label").agg(
        F.count_if(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"),
        F.count_if(F.col("g").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def _prf(df: DataFrame) -> DataFrame:
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return df.withColumn("p", p).withColumn("r", r).withColumn("f1", _ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")))


def entity_metrics(gold: DataFrame, pred: DataFrame, process: bool = True, gold_sentences_only: bool = True,
                   gold_labels_only: bool = True) -> DataFrame:
    """Precision, recall, F1 and support per label plus ``micro`` and ``macro`` rows.

    By default only sentences with gold entities count, micro fp covers all labels while tp and fn cover gold
    labels, and macro averages gold labels. With all three switches off this is the plain variant.
    """
    if gold_sentences_only:
        pred = pred.join(gold.select("sent_id").distinct(), "sent_id", "left_semi")
    gold_labels = gold.select("label").distinct().withColumn("in_gold", F.lit(True))
    if process:
        gold, pred = postprocess(gold), postprocess(pred)
    counts = entity_counts(gold, pred)
    counts = counts.join(gold_labels, "label", "full").fillna(0, ["tp", "fp", "fn"])
    keep = F.coalesce("in_gold", F.lit(False)) if gold_labels_only else F.lit(True)
    counts = counts.withColumn("keep", keep)
    per = _prf(counts.filter("keep")).withColumn("support", F.col("tp") + F.col("fn"))
    micro = _prf(counts.agg(F.sum(F.when(F.col("keep"), F.col("tp")).otherwise(0)).alias("tp"), F.sum("fp").alias("fp"),
                            F.sum(F.when(F.col("keep"), F.col("fn")).otherwise(0)).alias("fn")))
    cols = ["label", "tp", "fp", "fn", "p", "r", "f1", "support"]
    micro = micro.withColumn("label", F.lit("micro")).withColumn("support", F.col("tp") + F.col("fn"))
    macro = per.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.avg("p").alias("p"), F.avg("r").alias("r"),
                    F.avg("f1").alias("f1"), F.sum("support").alias("support")).withColumn("label", F.lit("macro"))
    return per.select(*cols).unionByName(micro.select(*cols)).unionByName(macro.select(*cols))


def perfect_matches(sents: DataFrame, as_sets: bool = False) -> DataFrame:
    """Sentences whose predicted entities equal the gold ones, in order (or as sets)."""
    def norm(c):
        x = F.transform(c, lambda e: F.struct(e["text"].alias("text"), F.lower(e["label"]).alias("label")))
        return F.array_sort(F.array_distinct(x)) if as_sets else x
    return sents.filter(norm("entities") == norm("predicted_entities")).withColumn("n_entities", F.size("entities"))


def factor_effects(runs: DataFrame, factors: list[str], metric: str = "micro_f1") -> DataFrame:
    """Mean metric with each factor on and off, and the direction of the effect."""
    long = runs.select(metric, F.explode(F.array(*[F.struct(F.lit(f).alias("factor"), F.col(f).alias("level")) for f in factors])).alias("x")).select(metric, "x.*")
    on, off = F.avg(F.when(F.col("level") == 1, F.col(metric))), F.avg(F.when(F.col("level") == 0, F.col(metric)))
    out = long.groupBy("factor").agg(on.alias("avg_on"), off.alias("avg_off"), F.count_if(F.col("level") == 1).alias("n_on"),
                                     F.count_if(F.col("level") == 0).alias("n_off")).filter("n_on > 0 and n_off > 0")
    d = F.col("avg_on") - F.col("avg_off")
    return out.withColumn("diff", d).withColumn("effect", F.when(d > 0.005, "正向").when(d < -0.005, "负向").otherwise("无显著"))


def ranked_runs(runs: DataFrame, metric: str = "micro_f1") -> DataFrame:
    """Runs with their gap to the best."""
    return runs.withColumn("best", runs.agg(F.max(metric)).scalar()).withColumn("gap", F.col(metric) - F.col("best"))


def run_difference(runs: DataFrame, run_col: str, a: str, b: str, metrics: list[str]) -> DataFrame:
    """Metric by metric difference of two runs."""
    def v(name, run):
        return F.max(F.when(F.col(run_col) == run, F.col(name)))
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("a"), F.col(f"{m}_b").alias("b")) for m in metrics])
    wide = runs.agg(*[x for m in metrics for x in (v(m, a).alias(f"{m}_a"), v(m, b).alias(f"{m}_b"))])
    return wide.select(F.explode(rows).alias("x")).select("x.*").withColumn("diff", F.col("a") - F.col("b"))


def filter_saving(requests: DataFrame, skipped: str, group: str | None = None) -> DataFrame:
    """Model calls before and after filtering, and the share saved."""
    g = requests.groupBy(group) if group else requests.groupBy()
    return (g.agg(F.count("*").alias("calls_before"), F.count_if(~F.col(skipped)).alias("calls_after"), F.count_if(skipped).alias("filtered"))
            .withColumn("saved_pct", _ratio((F.col("calls_before") - F.col("calls_after")) * 100.0, F.col("calls_before"))))
