"""Leak records: detection in payloads, SDK attribution, normalisation and summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit import dictionaries as D
from privaudit.functions.payload import encoding_fanout
from privaudit.functions.scalars import (any_of, blank, is_internal_host, is_real_host, lookup, shorten,
                                         signed_bytes_to_binary)
from privaudit.operators.joins import first_match, prefix_pairs, substring_pairs, text_contains

# --- SDK attribution ------------------------------------------------------------------------------

def sdk_domains(sdk: DataFrame) -> DataFrame:
    """One row per SDK domain, in dictionary order."""
    return sdk.select("ord", "name", "company", "category", F.posexplode("domains").alias("pos", "domain")) \
        .withColumn("domain", F.lower("domain"))


def sdk_prefixes(sdk: DataFrame) -> DataFrame:
    """One row per SDK package prefix, in dictionary order, with its length."""
    return sdk.select("ord", "name", "company", "category", F.posexplode("packages").alias("pos", "prefix")) \
        .withColumn("prefix_len", F.length("prefix"))


def host_sdk(hosts: DataFrame, sdk: DataFrame, host: str = "host") -> DataFrame:
    """Distinct hosts whose lowercased name contains an SDK domain, with the first such SDK."""
    h = hosts.select(F.col(host).alias("host")).filter(~blank("host")).distinct().withColumn("_h", F.lower("host"))
    d = sdk_domains(sdk)
    pairs = substring_pairs(h, "_h", d, "domain")
    best = first_match(pairs.join(d, "domain"), ["_h"], ["name", "company", "category", "domain"], ["ord", "pos"])
    return h.join(best, "_h").select("host", F.col("name").alias("sdk_name"), "company", "category", "domain")


def host_owner(hosts: DataFrame, sdk: DataFrame, package: str = "package", host: str = "host") -> DataFrame:
    """Owner of each distinct (package, host): own keyword first, then SDK domains, then known host patterns."""
    ph = hosts.select(F.col(package).alias("package"), F.col(host).alias("host")).distinct().withColumn("_h", F.lower("host"))
    words = F.filter(F.split(F.lower("package"), r"\."),
                     lambda p: (F.length(p) > 2) & ~p.isin(*D.GENERIC_PACKAGE_PARTS))
    own = F.exists(words, lambda p: F.col("_h").contains(p))
    matched = host_sdk(ph, sdk).select("host", "sdk_name", "company")
    # Java regexes need no anchor at the start when the pattern opens with '.*'
    known = [F.when(F.col("_h").rlike("^(" + p + ")"), F.struct(F.lit(n).alias("name"), F.lit(c).alias("company")))
             for p, n, c in D.SDK_HOST_PATTERNS]
    j = ph.join(matched, "host", "left").withColumn("_p", F.coalesce(*known))
    third = ~own & (F.col("sdk_name").isNotNull() | F.col("_p").isNotNull())
    return j.select("package", "host", third.alias("is_third_party"),
                    F.when(third, F.coalesce("sdk_name", "_p.name")).otherwise("").alias("sdk_name"),
                    F.when(third, F.coalesce("company", "_p.company")).otherwise("").alias("sdk_company"))


def stack_sdk(calls: DataFrame, sdk: DataFrame, call_id: str, classes: str) -> DataFrame:
    """SDK of the topmost frame that belongs to one; within the frame the first dictionary entry."""
    frames = calls.select(call_id, F.posexplode(classes).alias("frame", "cls"))
    d = sdk_prefixes(sdk)
    per_class = first_match(prefix_pairs(frames, "cls", d, "prefix").join(d, "prefix"), ["cls"],
                            ["name", "company", "category", "prefix"], ["ord", "pos"])
    hit = frames.join(per_class, "cls")
    return first_match(hit, [call_id], ["name", "company", "category", "prefix"], ["frame"])


def caller_sdk(callers: DataFrame, sdk: DataFrame, caller: str) -> DataFrame:
    """Distinct caller classes with the SDK of the longest matching prefix, else system or own code."""
    c = callers.select(F.col(caller)).distinct()
    d = sdk_prefixes(sdk)
    best = (prefix_pairs(c, caller, d, "prefix").join(d, "prefix").groupBy(caller)
            .agg(F.max_by(F.struct("name", "company", "prefix"), F.struct("prefix_len", -F.col("ord"), -F.col("pos"))).alias("m")))
    system = blank(caller) | F.col(caller).rlike("^(" + any_of(D.SYSTEM_PREFIXES) + ")")
    return c.join(best, caller, "left").select(
        caller,
        F.when(F.col("m").isNotNull(), F.col("m.name")).when(system, D.SYSTEM_CALLER).otherwise(D.OWN_CALLER).alias("sdk_name"),
        F.coalesce("m.company", F.lit("")).alias("sdk_company"), F.col("m.prefix").alias("match_prefix"),
        F.col("m").isNotNull().alias("is_third_party"))


# --- categories -----------------------------------------------------------------------------------

def with_field_category(df: DataFrame, field_category: DataFrame, field: str = "privacy_field") -> DataFrame:
    """Add level 1 and level 2 of the field; a field with one level repeats it."""
    fc = field_category.select(F.col("field").alias(field), F.col("level1").alias("_l1"), F.col("level2").alias("_l2"))
    return (df.join(fc, field, "left")
            .withColumn("category_level1", F.coalesce("_l1", F.lit(D.DEFAULT_LEVEL1)))
            .withColumn("category_level2", F.when(F.col("_l1").isNull(), D.DEFAULT_LEVEL2).otherwise(F.coalesce("_l2", "_l1")))
            .drop("_l1", "_l2"))


def field_info(df: DataFrame, field_category: DataFrame, field: str) -> DataFrame:
    """Category and standard name of a behaviour field, retried without its ``-word``/``-token`` suffix."""
    fc = field_category.filter("level2 is not null")
    exact = fc.select(F.col("field").alias(field), F.col("level1").alias("_c1"), F.col("level2").alias("_s1"))
    short = fc.select(F.col("field").alias("_base"), F.col("level1").alias("_c2"), F.col("level2").alias("_s2"))
    base = F.replace(F.replace(F.col(field), F.lit("-word"), F.lit("")), F.lit("-token"), F.lit(""))
    return (df.withColumn("_base", base).join(exact, field, "left").join(short, "_base", "left")
            .withColumn("category", F.coalesce("_c1", "_c2", F.lit(D.DEFAULT_LEVEL1)))
            .withColumn("standard_name", F.coalesce("_s1", "_s2", field)).drop("_base", "_c1", "_s1", "_c2", "_s2"))


# --- detection ------------------------------------------------------------------------------------

def _bytes_text(c):
    """Bytes as text with one character per byte, so that substring tests are byte-exact."""
    return F.decode(c.cast("binary"), "ISO-8859-1")


def _others(leaves: DataFrame) -> list[str]:
    return [c for c in leaves.columns if c not in ("package", "leaf_id")]


def detect_values(leaves: DataFrame, values: DataFrame, preview: int | None = None) -> DataFrame:
    """Leaves that contain a sensitive value under any encoding.

    ``leaves``: package, leaf_id, leaf and any record columns; ``values``: package, field, value, is_keyword.
    """
    coded = encoding_fanout(values.filter("not is_keyword"))
    coded = (coded.filter(~F.col("encode_type").isin(*D.HASH_ENCODINGS) | (F.length("value") >= 6))
             .select("package", "field", "value", "encode_type", _bytes_text(F.col("encoded")).alias("needle"))
             .withColumn("needle_id", F.xxhash64("package", "field", "encode_type", "needle")))
    hay = leaves.withColumn("_hay", _bytes_text(F.encode(F.col("leaf"), "UTF-8")))
    needles = coded.select("package", "needle_id", "needle").distinct()
    hits = text_contains(hay, "leaf_id", "_hay", needles, "needle_id", "needle", on=["package"], keep=_others(leaves))
    return (hits.join(coded.drop("needle"), ["package", "needle_id"])
            .withColumnRenamed("field", "privacy_field")
            .withColumn("value_preview", shorten("value", preview)).drop("needle_id", "value"))


def detect_keywords(leaves: DataFrame, values: DataFrame, preview: int | None = None) -> DataFrame:
    """Leaves that mention a keyword, ignoring case; all-digit leaves are skipped."""
    kw = values.filter("is_keyword").select("package", "field", F.lower("value").alias("word")).distinct()
    low = leaves.filter(~F.col("leaf").rlike("^[0-9]+$")).withColumn("_low", F.lower("leaf"))
    hits = text_contains(low, "leaf_id", "_low", kw.withColumn("kid", F.xxhash64("field", "word")), "kid", "word", on=["package"], keep=_others(leaves))
    kws = kw.withColumn("kid", F.xxhash64("field", "word"))
    return (hits.join(kws, ["package", "kid"])
            .withColumnRenamed("field", "privacy_field").withColumn("encode_type", F.lit("normal"))
            .withColumn("value_preview", shorten("leaf", preview)).drop("kid", "word"))


def propagate_tokens(keyword_hits: DataFrame, leaves: DataFrame, preview: int | None = None) -> DataFrame:
    """Outbound leaves that carry a value captured under a token keyword in the same or an earlier leaf.

    Only the first capture of a value matters, so captures are reduced before the join. ``seq`` orders leaves.
    """
    cap = (keyword_hits.filter(F.col("privacy_field").isin(*D.TOKEN_KEYWORDS))
           .groupBy("package", "source", F.col("privacy_field").alias("keyword"), F.col("leaf").alias("token"))
           .agg(F.min("seq").alias("captured_seq")).withColumn("tid", F.xxhash64("source", "keyword", "token")))
    out = leaves.filter("direction = '>'")
    others = [c for c in _others(out) if c != "source"]
    hits = text_contains(out, "leaf_id", "leaf", cap, "tid", "token", on=["package", "source"], keep=others)
    return (hits.join(cap, ["package", "source", "tid"])
            .filter("seq >= captured_seq")
            .withColumn("privacy_field", F.concat(F.regexp_replace("keyword", "-word$", ""), F.lit("-token")))
            .withColumn("encode_type", F.lit("normal")).withColumn("value_preview", shorten("token", preview))
            .drop("tid", "keyword", "token"))


def detect_crypto(crypto_calls: DataFrame, values: DataFrame) -> DataFrame:
    """Leak records from plaintexts of crypto calls: always outbound, encrypted and addressed to the crypto API."""
    plain = signed_bytes_to_binary("plaintext_text")
    leaves = (crypto_calls.withColumn("leaf", F.coalesce(F.try_validate_utf8(plain.cast("string")), F.decode(plain, "ISO-8859-1")))
              .filter("length(leaf) >= 4").withColumn("leaf_id", F.xxhash64("package", "stage", "line_no")))
    exact, words = detect_values(leaves, values), detect_keywords(leaves, values)
    cols = [c for c in exact.columns if c in words.columns]
    return exact.select(*cols).unionByName(words.select(*cols)).select(
        "package", F.col("ts"), "privacy_field", F.lit("outbound").alias("direction"), F.lit("CryptoAPI").alias("host"),
        F.lit("").alias("path"), F.lit("crypt_direct").alias("source"), F.lit("args[0]").alias("target"),
        F.concat_ws(".", "class", "method").alias("meta"), F.lit("normal").alias("encode_type"),
        F.lit(True).alias("encrypted"), F.lit(False).alias("is_key"), "value_preview",
        F.struct(F.col("stage"), F.col("algorithm"), F.lit(True).alias("third_party"), F.col("encrypt")).alias("crypt"))


# --- normalisation --------------------------------------------------------------------------------

def normalize_leaks(leaks: DataFrame, sdk: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """Fill defaults and attribute each record to a third party, the app itself or nobody known.

    ``hosts`` (host) may name the hosts that occur, where a table has them; else the records are read once more for them.
    """
    defaults = {"category_level1": D.DEFAULT_LEVEL1, "category_level2": D.DEFAULT_LEVEL2, "direction": "unknown",
                "host": "Unknown", "source": "unknown", "encode_type": "normal", "encrypted": False, "is_key": False}
    out = leaves = leaks
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v))) if c in leaves.columns else out.withColumn(c, F.lit(v))
    j = out.drop("sdk").join(host_sdk(out if hosts is None else hosts, sdk).drop("domain"), "host", "left")
    own = is_internal_host("host", "package")
    third = F.col("sdk_name").isNotNull()
    return j.withColumn("sdk", F.struct(
        F.when(third, F.col("sdk_name")).when(own, F.col("package")).otherwise("").alias("name"),
        F.when(third, F.col("company")).otherwise("").alias("company"),
        F.when(third, F.col("category")).when(own, "app_self").otherwise("unknown").alias("category"),
        third.alias("is_third_party"))).drop("sdk_name", "company", "category")


def record_flags(leaks: DataFrame) -> DataFrame:
    """File, crypto, network, third-party and located flags of each record."""
    src, host = F.lower(F.coalesce("source", F.lit(""))), F.coalesce(F.col("host"), F.lit(""))
    f = F.lit(False)
    return (leaks
            .withColumn("is_file", src.startswith("file") | F.lower(host).contains("/storage/"))
            .withColumn("is_crypt", src.startswith("crypt") | (host == "CryptoAPI") | F.col("crypt").isNotNull())
            .withColumn("is_network", src.isin(*D.NETWORK_SOURCES) | (host.contains(".") & (host != "CryptoAPI")))
            .withColumn("is_third", F.coalesce(F.col("sdk.is_third_party"), f) | F.coalesce(F.col("crypt.third_party"), f))
            .withColumn("has_meta", ~blank("meta")))


# --- summaries ------------------------------------------------------------------------------------

def _local():
    return F.coalesce(F.col("source").isin(*D.LOCAL_SOURCES), F.lit(False)) | ~is_real_host("host")


def leak_totals(leaks: DataFrame) -> DataFrame:
    """Record totals per package."""
    return leaks.groupBy("package").agg(
        F.count("*").alias("total_leaks"),
        F.count_if(F.coalesce("encrypted", F.lit(False))).alias("encrypted_count"),
        F.count_if(~F.coalesce("encrypted", F.lit(False))).alias("plaintext_count"),
        F.count_if(F.col("direction") == "outbound").alias("outbound_count"),
        F.count_if(F.col("direction") == "inbound").alias("inbound_count"),
        F.count_if(_local()).alias("local_file_count"), F.count_if(~_local()).alias("network_leak_count"))


def leaks_by_category(leaks: DataFrame, keys=("package",)) -> DataFrame:
    """Counts per category and per (category, field) in one pass; ``privacy_field`` is NULL on category rows."""
    k = list(keys)
    full = [*k, "category_level1", "privacy_field"]
    return (leaks.groupingSets([full[:-1], full], *full)
            .agg(F.count("*").alias("n"), F.grouping("privacy_field").cast("boolean").alias("is_category")))


def leaks_by_host(leaks: DataFrame) -> DataFrame:
    """Network records and the fields seen per host; records are counted per field first, so a set has distinct fields only."""
    return leaks.filter(~_local()).groupBy("package", "host", "privacy_field").agg(F.count("*").alias("n")).groupBy("package", "host").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list("privacy_field")).alias("fields"))


def leaks_by_sdk(leaks: DataFrame) -> DataFrame:
    """Network records per SDK name, or per host where no SDK is known."""
    name = F.when(blank("sdk.name"), F.col("host")).otherwise(F.col("sdk.name"))
    counted = leaks.filter(~_local()).groupBy("package", name.alias("sdk_key"), "privacy_field").agg(
        F.count("*").alias("n"), F.bool_or("sdk.is_third_party").alias("third"))
    return counted.groupBy("package", "sdk_key").agg(
        F.sum("n").alias("n"), F.array_sort(F.collect_list("privacy_field")).alias("fields"), F.bool_or("third").alias("is_third_party"))


def source_class():
    """local_file, third_party, app_self or unknown, in that order."""
    return (F.when(_local(), "local_file").when(F.col("sdk.is_third_party"), "third_party")
            .when(is_internal_host("host", "package"), "app_self").otherwise("unknown"))


def leaks_by_source(leaks: DataFrame) -> DataFrame:
    """Records and distinct fields per source class and key, with class totals (``source_key`` NULL) and package totals.

    Records are counted per (package, class, key, field) first; all three levels are made from that small table.
    """
    cls = source_class()
    key = F.when(cls == "third_party", F.when(blank("sdk.name"), F.col("host")).otherwise(F.col("sdk.name"))).otherwise(F.col("host"))
    rows = leaks.select("package", cls.alias("source_class"), key.alias("source_key"), "privacy_field")
    counted = rows.groupBy("package", "source_class", "source_key", "privacy_field").agg(F.count("*").alias("n"))
    levels = F.array(F.struct(F.lit(0).alias("level"), F.col("source_class").alias("c"), F.col("source_key").alias("k")),
                     F.struct(F.lit(1).alias("level"), F.col("source_class").alias("c"), F.lit(None).cast("string").alias("k")),
                     F.struct(F.lit(3).alias("level"), F.lit(None).cast("string").alias("c"), F.lit(None).cast("string").alias("k")))
    at = counted.select("package", "privacy_field", "n", F.explode(levels).alias("_l")).select(
        "package", F.col("_l.level").alias("level"), F.col("_l.c").alias("source_class"), F.col("_l.k").alias("source_key"), "privacy_field", "n")
    fields = at.groupBy("package", "level", "source_class", "source_key", "privacy_field").agg(F.sum("n").alias("n"))
    return fields.groupBy("package", "level", "source_class", "source_key").agg(F.sum("n").alias("n"), F.count("privacy_field").alias("n_fields")).select(
        "package", "source_class", "source_key", "n", "n_fields", "level")


def source_examples(leaks: DataFrame, per_key: int) -> DataFrame:
    """First brief records of every source key, oldest first."""
    from pyspark.sql import Window as W
    cls = source_class()
    key = F.when((cls == "third_party") & ~blank("sdk.name"), F.col("sdk.name")).otherwise(F.col("host"))
    rows = leaks.select("package", cls.alias("source_class"), key.alias("source_key"), "ts",
                        F.col("privacy_field").alias("field"), "host", "direction", "encrypted")
    w = W.partitionBy("package", "source_class", "source_key").orderBy("ts", "field", "host", "direction", "encrypted")
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= per_key)


def field_group(mapping: dict, field):
    """Category of a field from a fixed mapping, with the default category."""
    return F.coalesce(lookup(mapping, field), F.lit(D.DEFAULT_LEVEL1))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL of same-shaped branches such as http and https, or the two stages."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
