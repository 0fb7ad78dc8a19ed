"""Compliance rules R1–R8 over policy and behaviour evidence of all packages."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from privaudit import dictionaries as D
from privaudit.functions.scalars import blank, lookup, standard_field
from privaudit.operators.joins import first_match, substring_pairs, text_contains

# --- policy evidence --------------------------------------------------------------------------------

def label_code(c) -> Column:
    """Rule code such as ``C2`` inside a label text."""
    code = F.regexp_extract(F.upper(c), r"\b([A-Z][0-9]+(\.[0-9]+)?)\b", 1)
    return F.when(code != "", code)


def policy_labels(labels: DataFrame) -> DataFrame:
    """Distinct (package, label, code); codes, dotted ids and names all lead to the same rule code."""
    dotted = lookup({i: c for c, i in D.CLAUSE_CODES}, F.col("label"))
    return (labels.select("package", F.trim("label").alias("label")).filter(~blank("label")).distinct()
            .withColumn("code", F.coalesce(label_code(F.col("label")), dotted)))


def policy_entities(sents: DataFrame) -> DataFrame:
    """Declared data, receivers and controllers: ``(package, kind, value)``; ``sents``: package, entities."""
    e = sents.select("package", F.explode("entities").alias("e"))
    return (e.select("package", F.lower("e.label").alias("kind"), F.trim("e.text").alias("value"))
            .filter(F.col("kind").isin("data", "receiver", "controller") & ~blank("value")).distinct())


def policy_pieces(sents: DataFrame, entities: DataFrame) -> DataFrame:
    """Lowercased policy text in pieces: sentences, receivers and controllers."""
    named = entities.filter(F.col("kind").isin("receiver", "controller")).select("package", F.lower("value").alias("piece"))
    return (sents.filter(~blank("text")).select("package", F.lower(F.trim("text")).alias("piece")).unionByName(named).distinct()
            .withColumn("piece_id", F.xxhash64("package", "piece")))


# --- label tests ------------------------------------------------------------------------------------

def has_id(code: str) -> Column:
    return F.coalesce((F.col("code") == code) | F.col("code").startswith(code + "."), F.lit(False))


def has_tag(tags) -> Column:
    return F.col("label").isin(*tags)


def has_label(code: str) -> Column:
    return has_id(code) | has_tag(D.LABEL_ALIASES.get(code, [""]))


def _any(cond: Column, name: str) -> Column:
    return F.coalesce(F.bool_or(cond), F.lit(False)).alias(name)


def label_rules(labels: DataFrame, packages: DataFrame, modules=None) -> DataFrame:
    """R1–R5 in one aggregation over the labels: ``(package, rule_id, violated, reason)``."""
    modules = modules or D.MODULE_PROXIES
    tests = [_any(has_id(m) | has_tag(t), f"m_{m}") for m, t in modules.items()]
    singles = {"C2": "处理的个人信息类别", "C4": "个人信息来源", "E3": "政策更新", **D.STORAGE_PARTS, **D.CORE_RIGHTS}
    tests += [_any(has_id(c) | has_tag([t]), f"t_{c}") for c, t in singles.items()]
    tests += [_any(has_tag(D.STORAGE_PROXIES) | has_id("I1"), "storage"), _any(has_tag(D.RIGHTS_PROXIES) | has_id("E1"), "rights")]
    p = packages.select("package").distinct().join(labels, "package", "left").groupBy("package").agg(*tests)

    def missing(prefix, codes):
        return F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"{prefix}{c}"), c) for c in codes])), ", ")

    no_module, no_storage, no_right = missing("m_", modules), missing("t_", D.STORAGE_PARTS), missing("t_", D.CORE_RIGHTS)
    rules = [
        ("R1", no_module != "", no_module),
        ("R2", F.col("t_C2") & ~F.col("t_C4"), F.lit("C4")),
        ("R3", F.col("storage") & (no_storage != ""), no_storage),
        ("R4", F.col("rights") & (no_right != ""), no_right),
        ("R5", ~F.col("t_E3"), F.lit("E3")),
    ]
    return _stack(p, rules)


def _stack(df: DataFrame, rules) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(r).alias("rule_id"), v.alias("violated"), F.when(v, why).otherwise("").alias("reason")) for r, v, why in rules])
    return df.select("package", F.explode(rows).alias("r")).select("package", "r.*")


# --- behaviour evidence -----------------------------------------------------------------------------

def behaviour(records: DataFrame, api_entities: DataFrame | None = None, category_fields: DataFrame | None = None,
              sdk_fallback: DataFrame | None = None):
    """Accesses and SDK activities from leak records, API entities and, for packages without, summaries.

    ``records``: package, seq, privacy_field, category_level1, host, source, sdk;
    ``api_entities``: package, seq, entity_type, entity_name, category, privacy_type, company.
    """
    rec = records.select(
        "package", "seq", standard_field("privacy_field").alias("item"),
        F.coalesce(F.nullif("category_level1", F.lit("")), F.lit(D.DEFAULT_LEVEL1)).alias("category"),
        F.coalesce(F.nullif("host", F.lit("")), "source", F.lit("")).alias("source"),
        F.coalesce("sdk.name", F.lit("")).alias("sdk_name"), F.coalesce("sdk.company", F.lit("")).alias("company"),
        F.coalesce("sdk.is_third_party", F.lit(False)).alias("third_party"))
    parts = [rec]
    if category_fields is not None:
        # packages without records fall back to their category summary
        parts.append(category_fields.join(rec.select("package").distinct(), "package", "left_anti").select(
            "package", F.lit(0).cast("long").alias("seq"), standard_field("field").alias("item"), "category", F.lit("").alias("source"),
            F.lit("").alias("sdk_name"), F.lit("").alias("company"), F.lit(False).alias("third_party")))
    if api_entities is not None:
        third = F.col("entity_type") == "Third-Party"
        parts.append(api_entities.filter(~blank("privacy_type")).select(
            "package", F.col("seq").cast("long").alias("seq"), F.trim("privacy_type").alias("item"), "category",
            F.col("entity_name").alias("source"), F.when(third, F.col("entity_name")).otherwise("").alias("sdk_name"),
            F.when(third, F.coalesce("company", F.lit(""))).otherwise("").alias("company"), third.alias("third_party")))
    accesses = reduce(DataFrame.unionByName, [p.withColumn("seq", F.col("seq").cast("long")) for p in parts])
    sdks = accesses.filter("third_party").select("package", "seq", F.col("sdk_name").alias("name"), "company", F.array("item").alias("fields"))
    if sdk_fallback is not None:
        sdks = sdks.unionByName(sdk_fallback.join(sdks.select("package").distinct(), "package", "left_anti"))
    return accesses, sdks


def unique_accesses(accesses: DataFrame) -> DataFrame:
    """Last access per (package, item, category, source, sdk_name)."""
    key = ["package", "item", "category", "source", "sdk_name"]
    rest = [c for c in accesses.columns if c not in key]
    return accesses.groupBy(*key).agg(F.max_by(F.struct(*rest), "seq").alias("_r")).select(*key, "_r.*")


def unique_sdks(sdks: DataFrame) -> DataFrame:
    """SDKs merged by name, else company: all fields, first non-empty company.

    Fields are made distinct per row pair before they are gathered, so a busy SDK shuffles its vocabulary only.
    """
    key = F.coalesce(F.nullif(F.trim("name"), F.lit("")), F.nullif(F.trim("company"), F.lit("")))
    s = sdks.withColumn("sdk_key", key).filter("sdk_key is not null")
    head = s.groupBy("package", "sdk_key").agg(
        F.coalesce(F.min_by("name", F.when(~blank("name"), F.col("seq"))), F.lit("")).alias("name"),
        F.coalesce(F.min_by("company", F.when(~blank("company"), F.col("seq"))), F.lit("")).alias("company"))
    fields = (s.select("package", "sdk_key", F.explode("fields").alias("f")).filter(~blank("f")).groupBy("package", "sdk_key")
              .agg(F.array_sort(F.collect_set("f")).alias("fields")))
    return head.join(fields, ["package", "sdk_key"], "left").withColumn("fields", F.coalesce("fields", F.array().cast("array<string>")))


def sdk_company(names: DataFrame, sdk: DataFrame, col: str = "name") -> DataFrame:
    """Company of the first dictionary SDK whose name equals, contains or is part of the name."""
    n = names.select(col).filter(~blank(col)).distinct().withColumn("_low", F.lower(F.trim(col)))
    d = sdk.select("ord", F.lower(F.trim("name")).alias("_sdk"), F.trim("company").alias("company"))
    hit = substring_pairs(n, "_low", d, "_sdk", both_ways=True).join(d, "_sdk")
    best = first_match(hit, ["_low"], ["company"], ["ord"])
    return n.join(best, "_low", "left").select(col, F.coalesce("company", F.lit("")).alias("company"))


# --- R6 ---------------------------------------------------------------------------------------------

def record_before_consent(phase, before_consent=None, pre_consent=None, consent_granted=None) -> Column:
    """Whether a record says it was made before consent: by a flag, by consent not granted or by its phase."""
    tests = [F.lower(F.coalesce(phase, F.lit(""))).isin(*D.PRE_CONSENT_PHASES, *D.START_PHASES)]
    tests += [F.coalesce(c, F.lit(False)) for c in (before_consent, pre_consent) if c is not None]
    if consent_granted is not None:
        tests.append(~F.coalesce(consent_granted, F.lit(True)))
    return reduce(or_, tests)


def run_before_consent(phase, consent_granted, user_consented) -> Column:
    """The same for a whole run, where starting up says nothing; NULL if the run has no timing at all."""
    early = (F.lower(F.coalesce(phase, F.lit(""))).isin(*D.PRE_CONSENT_PHASES) | ~F.coalesce(consent_granted, F.lit(True)) | ~F.coalesce(user_consented, F.lit(True)))
    known = phase.isNotNull() | consent_granted.isNotNull() | user_consented.isNotNull()
    return F.when(known, early)


def pre_consent(packages: DataFrame, gate: DataFrame, explicit: DataFrame, accesses: DataFrame, run: DataFrame) -> DataFrame:
    """Items accessed before consent by the strongest evidence each package has.

    Order: gate dump, explicit list, flags or phase on records, phase of the whole run. Returns package, evidence
    (NULL when nothing tells), from_gate and items. ``gate``: package, item (NULL for an empty gate); ``explicit``:
    package, item; ``accesses``: package, item, flagged; ``run``: package, before_consent (NULL without timing).
    """
    def items(df):
        # distinct items of one package: bounded by the vocabulary
        return df.filter("item is not null").groupBy("package").agg(F.array_sort(F.collect_set("item")).alias("items"))

    none = F.array().cast("array<string>")
    g = gate.select("package").distinct().join(items(gate), "package", "left").select("package", F.coalesce("items", none).alias("g"))
    e = items(explicit).withColumnRenamed("items", "e")
    m = items(accesses.filter("flagged")).withColumnRenamed("items", "m")
    every = items(accesses).withColumnRenamed("items", "a")
    j = (packages.select("package").distinct().join(g, "package", "left").join(e, "package", "left").join(m, "package", "left")
         .join(every, "package", "left").join(run.select("package", "before_consent"), "package", "left"))
    whole = F.when(F.col("before_consent"), F.coalesce("a", none)).when(~F.col("before_consent"), none)
    return j.select("package",
                    F.when(F.col("g").isNotNull(), "gate").when(F.col("e").isNotNull(), "explicit").when(F.col("m").isNotNull(), "record")
                    .when(F.col("before_consent").isNotNull(), "run").alias("evidence"),
                    F.col("g").isNotNull().alias("from_gate"), F.coalesce("g", "e", "m", whole).alias("items"))


def events_before_consent(events: DataFrame, is_consent: Column, api: str = "api") -> DataFrame:
    """R6 from event order: APIs before the first consent of each package; unknown when consent never happens."""
    first = events.groupBy("package").agg(F.min(F.when(is_consent, F.col("ts"))).alias("consent_ts"))
    early = (events.filter(~is_consent).join(first, "package").filter("ts < consent_ts").groupBy("package", api)
             .agg(F.count("*").alias("n")))
    per = early.groupBy("package").agg(F.sum("n").alias("n_early"), F.array_sort(F.collect_set(api)).alias("apis"))
    return first.join(per, "package", "left").select(
        "package", F.coalesce("n_early", F.lit(0)).alias("n_early"), F.coalesce("apis", F.array().cast("array<string>")).alias("apis"),
        F.when(F.col("consent_ts").isNotNull(), F.col("n_early").isNotNull()).alias("violated"))


def gate_evidence(dumps: DataFrame, apps: DataFrame) -> DataFrame:
    """Pre-click APIs of the first candidate name that has gate dumps.

    ``dumps``: name, file, pre_click_apis; ``apps``: app_id, package_name, package, app_name.
    """
    names = F.array(*[F.trim(c) for c in ("package_name", "package", "app_name")])
    cand = apps.select("app_id", F.posexplode(names).alias("rank", "name")).filter(~blank("name") & ~F.lower("name").isin("unknown", "error"))
    usable = dumps.filter("pre_click_apis is not null")
    best = cand.join(usable.select("name").distinct(), "name").groupBy("app_id").agg(F.min_by("name", "rank").alias("name"))
    rows = best.join(usable, "name")
    return rows.select("app_id", "name", "file", F.explode_outer("pre_click_apis").alias("item"))


# --- R7, R8 -----------------------------------------------------------------------------------------

def undisclosed_sdks(sdks: DataFrame, pieces: DataFrame, sharing: DataFrame) -> DataFrame:
    """SDKs whose name and company are absent from the policy, or any SDK when sharing is not declared.

    ``pieces``: package, piece_id, piece; ``sharing``: package, sharing_declared.
    """
    s = sdks.select("package", F.trim("name").alias("name"), F.trim("company").alias("company")).distinct()
    needles = (s.select("package", F.explode(F.array(F.lower("name"), F.lower("company"))).alias("needle")).filter(~blank("needle"))
               .distinct().withColumn("needle_id", F.xxhash64("package", "needle")))
    hit = (text_contains(pieces, "piece_id", "piece", needles, "needle_id", "needle", on=["package"])
           .select("package", "needle_id").distinct().join(needles, ["package", "needle_id"]).select("package", "needle"))
    by_name = hit.select("package", F.col("needle").alias("_n"), F.lit(True).alias("n_hit"))
    by_company = hit.select("package", F.col("needle").alias("_c"), F.lit(True).alias("c_hit"))
    j = (s.withColumn("_n", F.lower("name")).withColumn("_c", F.lower("company")).join(by_name, ["package", "_n"], "left")
         .join(by_company, ["package", "_c"], "left").join(sharing, "package", "left"))
    named = F.coalesce("n_hit", F.lit(False)) | F.coalesce("c_hit", F.lit(False))
    shown = F.coalesce(F.nullif("name", F.lit("")), F.nullif("company", F.lit("")), F.lit("未知第三方SDK"))
    return j.filter(~F.coalesce("sharing_declared", F.lit(False)) | ~named).select("package", shown.alias("sdk")).distinct()


def broad_only(accesses: DataFrame, declared: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Accessed items that are only covered by a broad declared term: ``(package, item, broad)``.

    ``declared``: package, value. The broad term is the smallest of all that apply.
    """
    acc = accesses.filter(~blank("item")).select("package", "item", "category").distinct().withColumn("_item", F.lower("item"))
    dec = declared.select("package", F.lower("value").alias("_dec")).distinct()
    explicit = substring_pairs(dec, "_dec", acc, "_item", on=["package"]).select("package", "_item").distinct()
    open_ = acc.join(explicit, ["package", "_item"], "left_anti")
    parents = taxonomy.select(F.lower("child").alias("_item"), F.col("parent").alias("cat")).distinct()
    cats = (open_.filter(~blank("category")).select("package", "item", F.col("category").alias("cat"))
            .unionByName(open_.join(parents, "_item").select("package", "item", "cat")).distinct())
    alias = F.create_map(*[x for k, v in D.BROAD_ALIASES.items() for x in (F.lit(k), F.array(*[F.lit(t) for t in v]))])
    terms = cats.select("package", "item", F.explode(F.concat(F.array("cat"), F.coalesce(F.try_element_at(alias, F.col("cat")), F.array().cast("array<string>")))).alias("broad"))
    return (terms.withColumn("_dec", F.lower("broad")).join(dec, ["package", "_dec"]).groupBy("package", "item")
            .agg(F.min("broad").alias("broad")))


# --- verdicts ---------------------------------------------------------------------------------------

def status(violated) -> Column:
    return F.when(violated, D.STATUS_VIOLATED).when(~violated, D.STATUS_OK).otherwise(D.STATUS_UNKNOWN)


def _first_n(df: DataFrame, col: str, n: int | None) -> DataFrame:
    """All or the ``n`` smallest values of a package as one text."""
    w = W.partitionBy("package").orderBy(col)
    top = df.select("package", col).distinct()
    if n is not None:
        top = top.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)
    return top.groupBy("package").agg(F.array_join(F.array_sort(F.collect_list(col)), ", ").alias("reason"))


def verdicts(packages: DataFrame, labels: DataFrame, consent: DataFrame, sdks: DataFrame, undisclosed: DataFrame,
             accesses: DataFrame, declared: DataFrame, broad: DataFrame, shown: int | None = None) -> DataFrame:
    """All eight rules per package: rule_id, violated (NULL = unknown), status, reason (of ``shown`` names at most)."""
    pk = packages.select("package").distinct()
    out = label_rules(labels, pk)
    has_items = F.size("items") > 0
    out = out.unionByName(consent.select(
        "package", F.lit("R6").alias("rule_id"), F.when(F.col("items").isNotNull(), has_items).alias("violated"),
        F.when(has_items, F.array_join("items" if shown is None else F.slice("items", 1, shown), ", ")).otherwise("").alias("reason")))

    def flag(df, name):
        return df.select("package").distinct().withColumn(name, F.lit(True))

    seen = flag(accesses.select("package").unionByName(sdks.select("package")), "seen")
    r7 = pk.join(seen, "package", "left").join(_first_n(undisclosed, "sdk", shown), "package", "left").select(
        "package", F.lit("R7").alias("rule_id"), F.when(F.col("seen") | F.col("reason").isNotNull(), F.col("reason").isNotNull()).alias("violated"),
        F.coalesce("reason", F.lit("")).alias("reason"))
    pairs = broad.withColumn("match", F.concat_ws(" -> ", "broad", "item"))
    both = flag(accesses, "acc").join(flag(declared, "dec"), "package")
    r8 = pk.join(both, "package", "left").join(_first_n(pairs, "match", shown), "package", "left").select(
        "package", F.lit("R8").alias("rule_id"), F.when(F.col("acc").isNotNull() | F.col("reason").isNotNull(), F.col("reason").isNotNull()).alias("violated"),
        F.coalesce("reason", F.lit("")).alias("reason"))
    return (out.unionByName(r7).unionByName(r8).withColumn("rule_name", lookup(D.RULE_NAMES, "rule_id"))
            .withColumn("status", status(F.col("violated"))))


def overall(verdict_rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Overall status and score per package; ``scores``: package, policy_score, behaviour_score."""
    s = verdict_rows.groupBy("package").agg(F.bool_or("violated").alias("any_violated"), F.bool_or(F.col("violated").isNull()).alias("any_unknown"),
                                            F.count_if("violated").alias("n_violations"))
    state = F.when(F.col("any_violated"), "non_compliant").when(F.col("any_unknown"), "inconclusive").otherwise("compliant")
    score = F.coalesce("policy_score", F.lit(0)) * 0.4 + F.coalesce("behaviour_score", F.lit(0)) * 0.6
    return s.join(scores, "package", "left").select("package", state.alias("overall_status"), "n_violations", F.round(score, 1).alias("overall_score"))


def evidence_records(consent: DataFrame, undisclosed: DataFrame, unique_sdk: DataFrame, broad: DataFrame, accesses: DataFrame,
                     n_items: int | None = None) -> DataFrame:
    """Evidence rows behind R6–R8: ``(package, rule_id, item, detail)``, all or the first ``n_items`` per rule."""
    r6 = consent.filter("items is not null").select("package", F.explode("items").alias("item")).select(
        "package", F.lit("R6").alias("rule_id"), "item", F.lit("").alias("detail"))
    u = undisclosed.select("package", F.col("sdk").alias("item"))
    r7 = u.join(unique_sdk.select("package", F.col("sdk_key").alias("item"), "company", "fields"), ["package", "item"], "left").select(
        "package", F.lit("R7").alias("rule_id"), "item",
        F.concat_ws(" | ", F.coalesce(F.nullif("company", F.lit("")), F.lit("-")), F.coalesce(F.nullif(F.array_join("fields", ", "), F.lit("")), F.lit("-"))).alias("detail"))
    first = accesses.groupBy("package", "item").agg(F.min_by(F.struct("category", "source", "sdk_name"), "seq").alias("a"))
    r8 = broad.join(first, ["package", "item"], "left").select(
        "package", F.lit("R8").alias("rule_id"), "item", F.concat_ws(" | ", "broad", "a.category", "a.source", "a.sdk_name").alias("detail"))
    w = W.partitionBy("package", "rule_id").orderBy("item")
    every = r6.unionByName(r7).unionByName(r8)
    return every if n_items is None else every.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n_items).drop("rn")


def review_extract(verdict_rows: DataFrame) -> DataFrame:
    """R6–R8 with a reason in every state."""
    normal = (F.when((F.col("rule_id") == "R6") & F.col("violated").isNull(), "未找到同意页面证据")
              .when(F.col("rule_id") == "R6", "未检测到同意前访问")
              .when(F.col("rule_id") == "R7", "未检测到未披露的第三方 SDK 处理行为")
              .otherwise("未检测到仅声明大类而实际访问细粒度信息的情况"))
    return verdict_rows.filter(F.col("rule_id").isin("R6", "R7", "R8")).select(
        "package", "rule_id", "rule_name", "status", F.when(F.col("violated"), F.col("reason")).otherwise(normal).alias("reason"))


def readiness(packages: DataFrame, policy: DataFrame, static: DataFrame, dynamic: DataFrame) -> DataFrame:
    """Whether a verdict may be given, and which analyses are missing."""
    def has(df, n):
        return df.select("package").distinct().withColumn(n, F.lit(True))

    j = packages.select("package").distinct()
    for n, df in (("policy", policy), ("static", static), ("dynamic", dynamic)):
        j = j.join(has(df, n), "package", "full")
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), t) for n, t in D.READINESS_STEPS.items()]))
    ready = reduce(and_, [F.col(n).isNotNull() for n in D.READINESS_STEPS])
    return j.select("package", ready.alias("ready"), F.array_join(missing, "、").alias("missing_steps"))
