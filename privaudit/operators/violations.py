"""Declared versus collected data: undeclared items per app and SDK, vague declarations, severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from privaudit import dictionaries as D
from privaudit.functions.scalars import shorten
from privaudit.operators.joins import substring_pairs
from privaudit.operators.leaks import field_info
from privaudit.operators.policy import normalize_declarations
from privaudit.session import stored

# --- declared side ----------------------------------------------------------------------------------

def processing_acts(sents: DataFrame) -> DataFrame:
    """One row per sentence with its last controller, action, purpose and receiver and all data items."""
    kept = F.filter("entities", lambda x: F.trim(x["text"]) != "")

    def last(*labels):
        hit = F.filter(kept, lambda x: F.lower(x["label"]).isin(*labels))
        return F.try_element_at(hit, F.lit(-1))

    data = F.transform(F.filter(kept, lambda x: F.lower(x["label"]) == "data"), lambda x: F.trim(x["text"]))
    return sents.select(
        "package", "doc_id", "sent_no", "text", F.coalesce(F.trim(last("controller")["text"]), F.lit(D.DEFAULT_CONTROLLER)).alias("controller"),
        F.lower(last(*D.ACTION_LABELS)["label"]).alias("action_type"), F.trim(last(*D.ACTION_LABELS)["text"]).alias("action_verb"),
        data.alias("data_items"), F.trim(last("purpose")["text"]).alias("purpose"), F.trim(last("receiver")["text"]).alias("receiver"))


def declared_items(acts: DataFrame, terms: DataFrame) -> DataFrame:
    """``(package, raw, standard_name)`` of everything a policy declares."""
    raw = acts.select("package", F.explode("data_items").alias("raw")).distinct()
    return raw.join(normalize_declarations(raw, "raw", terms), "raw").select("package", "raw", "standard_name")


def vague_terms(spark, taxonomy: DataFrame) -> DataFrame:
    """``(term, item)``: broad terms and what they hide."""
    fixed = spark.createDataFrame([(t, i) for t, items in D.VAGUE_TERMS.items() for i in items], "term string, item string")
    cats = taxonomy.select(F.col("parent").alias("term"), F.col("child").alias("item")).distinct()
    return fixed.unionByName(cats.join(fixed.select("term").distinct(), "term", "left_anti"))


def acts_by_controller(acts: DataFrame) -> DataFrame:
    """Numbers of collection, sharing and other acts per controller."""
    a = acts.filter(F.col("action_type").isNotNull() & (F.size("data_items") > 0))
    return a.groupBy("package", "controller").agg(*[F.count_if(F.col("action_type") == t).alias(f"n_{t}") for t in D.ACTION_LABELS])


# --- collected side ---------------------------------------------------------------------------------

def collected_items(field_counts: DataFrame, field_sources: DataFrame, field_category: DataFrame):
    """Collected standard items with counts, and their sources.

    ``field_counts``: package, seq, field, n; ``field_sources``: package, source, field, is_third_party, sdk_name.
    """
    f = field_info(field_counts, field_category, "field")
    items = f.groupBy("package", "standard_name").agg(
        F.sum("n").alias("n"), F.min_by(F.struct("category", "field"), "seq").alias("_f")) \
        .select("package", "standard_name", "n", "_f.category", F.col("_f.field").alias("behavior_field"))
    src = field_info(field_sources, field_category, "field").drop("category", "field").distinct()
    return items, src.join(items.select("package", "standard_name"), ["package", "standard_name"], "left_semi")


# --- matching ---------------------------------------------------------------------------------------

def undeclared(collected: DataFrame, declared: DataFrame) -> DataFrame:
    """Collected items no declaration covers: exact, substring either way, shared keyword or declared category.

    ``collected``: package, standard_name, category, …; ``declared``: package, raw, standard_name. Every tier is a
    hash join within the package.
    """
    # every tier reads them, so the distinct items and declarations are computed once
    items = stored(collected.select("package", "standard_name", "category").distinct().withColumn("_item", F.lower("standard_name")), "items")
    declared = stored(declared.select("package", "raw", "standard_name").distinct(), "declarations")
    std = declared.select("package", F.lower("standard_name").alias("_dec")).distinct()
    phrases = std.unionByName(declared.select("package", F.lower("raw").alias("_dec"))).distinct()

    def words(c):
        return F.filter(F.array_distinct(F.split(F.regexp_replace(c, "[-_]", " "), r"\s+")), lambda x: x != "")

    near = substring_pairs(items, "_item", phrases, "_dec", on=["package"], both_ways=True).select("package", "_item")
    iw = items.select("package", "_item", F.explode(words("_item")).alias("w"))
    dw = std.select("package", F.explode(words("_dec")).alias("w")).distinct()
    shared = iw.join(dw, ["package", "w"]).select("package", "_item")
    cats = declared.select("package", F.explode(F.array("raw", "standard_name")).alias("category")).distinct()
    by_cat = items.join(cats, ["package", "category"]).select("package", "_item")
    covered = near.unionByName(shared).unionByName(by_cat).distinct()
    left = items.join(covered, ["package", "_item"], "left_anti").select("package", "standard_name")
    return collected.join(left, ["package", "standard_name"], "left_semi")


def severity(item, category) -> Column:
    """High, medium or low: item lists first, then category lists."""
    return (F.when(item.isin(*D.HIGH_SEVERITY_ITEMS) | category.isin(*D.HIGH_SEVERITY_CATEGORIES), "高")
            .when(item.isin(*D.LOW_SEVERITY_ITEMS) | category.isin(*D.LOW_SEVERITY_CATEGORIES), "低").otherwise("中"))


def _violation(df: DataFrame, kind: str, source, sdk_name) -> DataFrame:
    return df.select("package", F.lit(kind).alias("violation_type"), F.col("standard_name").alias("data_field"), "behavior_field",
                     "category", source.alias("source"), sdk_name.alias("sdk_name"), "n",
                     severity(F.col("standard_name"), F.col("category")).alias("severity"), F.lit("").alias("details"))


def app_undeclared(open_items: DataFrame, sources: DataFrame) -> DataFrame:
    """One violation per undeclared item, at its first source that is not a third party."""
    own = sources.filter("not is_third_party").groupBy("package", "standard_name").agg(F.min("source").alias("source"))
    return _violation(open_items.join(own, ["package", "standard_name"]), D.APP_UNDECLARED, F.col("source"), F.lit(""))


def sdk_undeclared(open_items: DataFrame, sources: DataFrame) -> DataFrame:
    """One violation per undeclared item and third-party source."""
    third = sources.filter("is_third_party").select("package", "standard_name", "source", "sdk_name").distinct()
    name = F.coalesce(F.nullif("sdk_name", F.lit("")), "source")
    return _violation(open_items.join(third, ["package", "standard_name"]), D.SDK_UNDECLARED, F.col("source"), name)


def vague_declarations(declared: DataFrame, collected: DataFrame, vague: DataFrame, shown: int | None = None) -> DataFrame:
    """Broad declared terms behind which specific items were collected, with all or the first ``shown`` of them.

    ``declared``: package, raw (and text); ``vague``: term, item.
    """
    used = declared.join(vague.select("term").distinct(), F.col("raw") == F.col("term"), "left_semi").select("package", F.col("raw").alias("term")).distinct()
    items = stored(used.join(vague, "term").withColumn("_i", F.lower("item")), "vague-items")
    have = stored(collected.select("package", "standard_name").distinct().withColumn("_c", F.lower("standard_name")), "collected-names")
    exact = items.join(have.select("package", F.col("standard_name").alias("item")), ["package", "item"]).select("package", "term", "item", F.col("item").alias("shown"))
    rest = items.join(exact.select("package", "term", "item"), ["package", "term", "item"], "left_anti")
    pairs = substring_pairs(rest, "_i", have, "_c", on=["package"], both_ways=True).join(have, ["package", "_c"])
    near = (rest.join(pairs, ["package", "_i"]).groupBy("package", "term", "item").agg(F.min("standard_name").alias("m"))
            .select("package", "term", "item", F.concat("item", F.lit("("), "m", F.lit(")")).alias("shown")))
    both = stored(exact.unionByName(near), "vague-found")
    w = W.partitionBy("package", "term").orderBy("item")
    listed = both if shown is None else both.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= shown)
    top = listed.groupBy("package", "term").agg(
        F.array_join(F.array_sort(F.collect_list("shown")), ", ").alias("details"))
    n = both.groupBy("package", "term").agg(F.count("*").alias("n"))
    return n.join(top, ["package", "term"])


def vague_violations(vague_rows: DataFrame) -> DataFrame:
    return vague_rows.select("package", F.lit(D.VAGUE_DECLARATION).alias("violation_type"), F.col("term").alias("data_field"),
                             F.lit("").alias("behavior_field"), F.lit(D.VAGUE_DECLARATION).alias("category"), F.lit("隐私政策").alias("source"),
                             F.lit("").alias("sdk_name"), "n", F.lit("中").alias("severity"), F.col("details"))


def violation_summary(violations: DataFrame) -> DataFrame:
    """Counts per type, severity, category and affected SDK in one pass over the violations."""
    dims = F.array(*[F.struct(F.lit(d).alias("dim"), F.col(c).alias("value")) for d, c in
                     (("type", "violation_type"), ("severity", "severity"), ("category", "category"), ("sdk", "sdk_name"))])
    rows = violations.select("package", "data_field", F.explode(dims).alias("d")).select("package", "data_field", "d.*")
    return rows.filter("value <> ''").groupBy("package", "dim", "value").agg(
        F.count("*").alias("n"), F.countDistinct("data_field").alias("n_fields"))


def violation_report(violations: DataFrame) -> DataFrame:
    """One JSON document per package. Violations of a package are bounded by its data items and SDKs."""
    row = F.struct(*[c for c in violations.columns if c != "package"])
    return violations.groupBy("package").agg(F.count("*").alias("n_violations"), F.to_json(F.array_sort(F.collect_list(row))).alias("report"))


def report_lines(violations: DataFrame) -> DataFrame:
    """Text report of every package as rows: package, section, ord, line. Section 0 is the head, 1 the counts per type, 2 the violations.

    A report stays a set of rows until it is written, so none is gathered in memory.
    """
    none = F.lit("")
    per_type = violations.groupBy("package", "violation_type").agg(F.count("*").alias("n"), F.countDistinct("data_field").alias("k"))
    head = per_type.groupBy("package").agg(F.sum("n").alias("n")).select("package", F.lit(0).alias("section"), none.alias("ord"), F.concat(F.lit("violations: "), F.col("n").cast("string")).alias("line"))
    types = per_type.select("package", F.lit(1).alias("section"), F.col("violation_type").alias("ord"),
                            F.concat(F.lit("  "), "violation_type", F.lit(": "), F.col("n").cast("string"), F.lit(" in "), F.col("k").cast("string"), F.lit(" fields")).alias("line"))
    text = F.concat_ws(" | ", F.concat(F.lit("["), "severity", F.lit("] "), "violation_type"), "data_field", "category", "source", F.nullif("sdk_name", none), F.nullif("details", none))
    return head.unionByName(types).unionByName(violations.select("package", F.lit(2).alias("section"), F.concat_ws("\x01", "violation_type", "data_field", "category", "source").alias("ord"), text.alias("line")))
