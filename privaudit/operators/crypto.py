"""Crypto calls and file writes: de-duplication, key lookup, fragment assembly and argument roles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.functions.scalars import (b64url_to_bytes, blank, decode_double_base64, may_be_base64, printable_ratio)
from privaudit.operators.scans import HOT_ROWS, Running, asof_join, running


def crypto_calls(lines: DataFrame) -> DataFrame:
    """Usable crypto calls: first call per (package, md5 of plaintext and ciphertext text)."""
    method = F.coalesce("method", "method_name", F.lit(""))
    out = (lines.withColumn("method", method).withColumn("class", F.coalesce("class", "class_name", F.lit("")))
           .withColumn("plaintext_text", F.try_element_at("args", F.lit(1)))
           .withColumn("ciphertext_text", F.trim(F.coalesce("returnValue", "ret")))
           .filter(F.coalesce("category", F.lit("")).isin("", "CryptoAPI"))
           .filter("plaintext_text is not null and plaintext_text <> '' and ciphertext_text <> ''"))
    low = F.lower("method")
    out = (out.withColumn("encrypt", ~low.contains("decrypt"))
           .withColumn("call_md5", F.md5(F.concat(F.encode("plaintext_text", "UTF-8"), F.encode("ciphertext_text", "UTF-8"))))
           .withColumn("ciphertext", b64url_to_bytes("ciphertext_text")))
    keep = ["ts", "class", "method", "algorithm", "hashcode", "encrypt", "plaintext_text", "ciphertext_text", "ciphertext", "stack"]
    best = F.min_by(F.struct("stage", "line_no", *keep), F.struct("stage", "line_no"))
    return (out.groupBy("package", "call_md5").agg(best.alias("b"))
            .select("package", "call_md5", "b.stage", "b.line_no", *[f"b.{c}" for c in keep]))


def cipher_keys(ciphers: DataFrame, key_inits: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each cipher call with the latest key of the same cipher object set at or before it."""
    return asof_join(ciphers, key_inits, ["package", "hashcode"], "ts", "line_no", ["key", "iv", "algorithm", "mode"], hot_rows)


def stitch_fragments(calls: DataFrame, keys: list[str], order: list[str], is_end, piece: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Concatenate the pieces up to each end call: ``(keys…, part, n_pieces, whole)``.

    A run is numbered by the end calls before it; pieces after the last end have no result and are dropped before
    anything is collected, so a group is never larger than one finished value.
    """
    flagged = calls.withColumn("_end", is_end)
    ends = flagged.filter("_end").groupBy(*keys).agg(F.count("*").alias("_n_ends"))
    scanned = running(flagged, keys, order, [Running("_ends", "sum", F.col("_end").cast("int"))], hot_rows)
    pieces = F.array_sort(F.collect_list(F.struct(*order, F.col(piece).alias("piece"))))
    return (scanned.withColumn("part", F.col("_ends") - F.col("_end").cast("int")).join(ends, keys)
            .filter("part < _n_ends").groupBy(*keys, "part")
            .agg(F.count("*").alias("n_pieces"), pieces.alias("_p"))
            .select(*keys, "part", "n_pieces", F.transform("_p", lambda x: x["piece"]).alias("pieces")))


def join_bytes(pieces):
    """Concatenate an array of binaries."""
    return F.aggregate(pieces, F.lit(b""), lambda acc, x: F.concat(acc, F.coalesce(x, F.lit(b""))))


def file_buffers(fs_events: DataFrame) -> DataFrame:
    """Written bytes per (package, stage, fd, path) in log order; undecodable writes are skipped."""
    w = fs_events.filter(F.col("function") == "write").withColumn("_data", F.try_to_binary("data", F.lit("base64")))
    chunks = F.array_sort(F.collect_list(F.when(F.col("_data").isNotNull(), F.struct("line_no", "_data"))))
    return (w.groupBy("package", "stage", "fd", "path").agg(F.count("*").alias("n_writes"), chunks.alias("_c"))
            .withColumn("buffer", join_bytes(F.transform("_c", lambda x: x["_data"]))).drop("_c").filter("length(buffer) > 0"))


def _key_sized(c):
    inner = F.when(may_be_base64(c), F.length(F.try_to_binary(c, F.lit("base64"))))
    return F.length(c).isin(16, 24, 32) | F.coalesce(inner.isin(16, 24, 32), F.lit(False))


def _block_sized(c):
    inner = F.when(may_be_base64(c), F.length(F.try_to_binary(c, F.lit("base64"))))
    return (F.length(c) == 8) | F.coalesce(inner == 8, F.lit(False))


def argument_roles(calls: DataFrame) -> DataFrame:
    """Which of two arguments is the data and which the key (``data_arg``, ``key_arg``, 1-based).

    The argument that varies more over all calls of the method is the data; then key-sized arguments, then length.
    """
    two = calls.filter(F.size("args") == 2).withColumn("a1", F.element_at("args", 1)).withColumn("a2", F.element_at("args", 2))
    spread = two.groupBy("class", "method").agg(F.countDistinct("a1").alias("d1"), F.countDistinct("a2").alias("d2"))
    low = F.lower("method")
    rsa, des = low.contains("rsa"), low.contains("des")

    def keyish(c):
        return (_key_sized(c) & ~rsa) | (_block_sized(c) & des)

    a1, a2 = F.col("a1"), F.col("a2")
    data = (F.when(F.col("d1") > F.col("d2"), 1).when(F.col("d1") < F.col("d2"), 2)
            .when(keyish(a2), 1).when(keyish(a1), 2)
            .when((F.length(a1) > 32) & (F.length(a1) > F.length(a2)), 1)
            .when((F.length(a2) > 32) & (F.length(a2) > F.length(a1)), 2).otherwise(1))
    return (two.join(spread, ["class", "method"]).withColumn("data_arg", data)
            .withColumn("key_arg", F.lit(3) - F.col("data_arg")).drop("a1", "a2", "d1", "d2"))


def argument_roles3(calls: DataFrame) -> DataFrame:
    """Data, key and IV among three arguments: two key-sized ones are key and IV, one key-sized one is the key."""
    low = F.lower("method")
    size = [F.length(F.element_at("args", i)) for i in (1, 2, 3)]
    k1, k2, k3 = [_key_sized(F.element_at("args", i)) & ~low.contains("rsa") for i in (1, 2, 3)]

    def roles(data, key, iv=None):
        return F.struct(F.lit(data).alias("data_arg"), F.lit(key).alias("key_arg"), F.lit(iv).cast("int").alias("iv_arg"))

    def longer(i, j, key):
        return (F.when((size[i - 1] > 32) & (size[i - 1] > size[j - 1]), roles(i, key))
                .when((size[j - 1] > 32) & (size[j - 1] > size[i - 1]), roles(j, key)))

    role = (F.when(k1 & k2, roles(3, 2, 1)).when(k2 & k3, roles(1, 2, 3)).when(k1 & k3, roles(2, 3, 1))
            .when(k1, longer(2, 3, 1)).when(k2, longer(1, 3, 2)).when(k3, longer(1, 2, 3)))
    return calls.filter(F.size("args") == 3).withColumn("_r", role).select("*", "_r.data_arg", "_r.key_arg", "_r.iv_arg").drop("_r")


def inspect_calls(calls: DataFrame, text_limit: int | None = None, hex_limit: int | None = None) -> DataFrame:
    """One row per argument and return value: decoded length, readable text and a hex preview."""
    parts = F.concat(F.transform("args", lambda a, i: F.struct(F.concat(F.lit("arg"), (i + 1).cast("string")).alias("part"), a.alias("raw"))),
                     F.array(F.struct(F.lit("ret").alias("part"), F.coalesce("returnValue", F.lit("")).alias("raw"))))
    rows = calls.select("package", "line_no", F.explode(parts).alias("x")).select("package", "line_no", "x.part", "x.raw")
    data = decode_double_base64("raw")
    out = rows.filter(~blank("raw")).withColumn("data", data).withColumn("n_bytes", F.length("data"))
    text = F.try_validate_utf8(F.col("data").cast("string"))
    return (out.withColumn("text", F.when(printable_ratio(text) > 0.8, text if text_limit is None else F.left(text, F.lit(text_limit))))
            .withColumn("hex_preview", F.lower(F.hex("data")) if hex_limit is None else F.left(F.lower(F.hex("data")), F.lit(hex_limit))).drop("data", "raw"))


def is_part_of(part, whole, n: int = 66):
    """The value, or one of its chunks longer than 32 bytes that is not padding only, occurs in the payload."""
    chunks = F.regexp_extract_all(part, F.lit(f"(?s).{{1,{n}}}"), F.lit(0))
    piece = F.exists(chunks, lambda p: (F.length(p) > 32) & whole.contains(p) & p.rlike("[^A=]"))
    return (F.length(whole) >= 16) & (whole.contains(part) | piece)
