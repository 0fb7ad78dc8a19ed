"""Detection to a fixed point: payloads of flows, written files and whole files are decoded, opened and parsed until nothing
new comes out, and every leaf is searched for sensitive values and keywords.

Work is done per distinct content and not per row that carries it: a content is known by its digest, and a round expands
only contents that no earlier round has seen. An expansion undoes base64 and percent-encoding, opens gzip, bzip2, zlib and
zip containers, and takes JSON, XML and query strings apart; a content that yields only itself is a leaf. Rounds end when no
content is new, so the depth of nesting is bounded by the data alone, and an archive that contains itself ends as well.
Every round is a table in the shared folder. Null payloads have no leaves; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit import dictionaries as D
from privaudit.functions.payload import decode_layers, encoding_fanout, flatten_payload, open_containers, probe_rows
from privaudit.functions.scalars import leaf_is_plausible
from privaudit.operators.joins import text_contains
from privaudit.session import stored

COLUMNS = ["package", "source", "direction", "host", "path", "ts", "target", "meta", "payload"]


def probes(flows: DataFrame | None = None, buffers: DataFrame | None = None, files: DataFrame | None = None) -> DataFrame:
    """Everything that may carry a value, one row each: headers, frames and bodies of ``flows`` (rows per side), written
    ``buffers`` (package, path, buffer) and whole ``files`` (package, path, content), which count as outbound."""
    parts = []
    if flows is not None:
        parts.append(probe_rows(flows).withColumn("source", F.coalesce("scheme", F.lit("unknown"))).select(*COLUMNS))
    for df, name, content in ((buffers, "file_buffer", "buffer"), (files, "whole_file", "content")):
        if df is not None:
            none = F.lit(None).cast("string")
            parts.append(df.select("package", F.lit(name).alias("source"), F.lit(">").alias("direction"), F.col("path").alias("host"), F.lit("").alias("path"),
                                   none.alias("ts"), F.lit("").alias("target"), none.alias("meta"), F.col(content).alias("payload")))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def expand(contents: DataFrame) -> DataFrame:
    """One step for contents (digest, payload): rows (parent, step, digest, payload); a leaf yields itself without a step.

    What decoding gives is a table of its own: every later use of a payload would decode it again."""
    opened = open_containers(stored(decode_layers(contents), "decoded"), "digest")
    text = flatten_payload(opened, "payload", "member").filter(F.col("leaf_path").isNull() | leaf_is_plausible("leaf"))
    raw = opened.filter(F.try_validate_utf8(F.col("payload").cast("string")).isNull() & F.col("payload").isNotNull())
    out = text.select(F.col("digest").alias("parent"), F.col("leaf_path").alias("step"), F.encode("leaf", "UTF-8").alias("payload")) \
        .unionAll(raw.select(F.col("digest").alias("parent"), F.col("member").alias("step"), "payload"))
    return out.select("parent", "step", F.sha2("payload", 256).alias("digest"), "payload")


def resolve(contents: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Leaves (root, leaf_path, digest) of distinct contents (digest, payload), the payloads of all digests, and the rounds."""
    frontier = stored(contents.select("digest", "payload"), "contents")
    known, steps, rounds = frontier, None, 0
    while not frontier.isEmpty():
        found = stored(expand(frontier), "expanded")
        edges = found.select("parent", "step", "digest")
        steps = edges if steps is None else steps.unionAll(edges)
        rounds += 1
        fresh = found.select("digest", "payload").dropDuplicates(["digest"]).join(known.select("digest"), "digest", "left_anti")
        frontier = stored(fresh, "contents")
        known = known.unionAll(frontier)
    start = contents.select(F.col("digest").alias("root"), F.lit(None).cast("string").alias("leaf_path"), "digest")
    if steps is None:
        return start, known, 0
    # a path is longer with every step, and no simple path has more steps than there were rounds
    leaves, open_ = None, start
    for _ in range(rounds + 1):
        o = open_.withColumnRenamed("digest", "parent").join(steps, "parent")
        went = stored(o.select("root", F.when(F.col("leaf_path").isNotNull() | F.col("step").isNotNull(), F.concat_ws("@", "leaf_path", "step")).alias("leaf_path"),
                               "digest", (F.col("digest") == F.col("parent")).alias("ends")), "paths")
        done = went.filter("ends").drop("ends")
        leaves = done if leaves is None else leaves.unionAll(done)
        open_ = went.filter("not ends").drop("ends")
        if open_.isEmpty():
            break
    return leaves.distinct(), known, rounds


def detect(rows: DataFrame, values: DataFrame) -> DataFrame:
    """Leak records of probe rows (see ``probes``): the row's columns without its payload, privacy_field, encode_type and
    leaf_path. ``values``: package, field, value, is_keyword.

    A value is looked for under all its encodings, byte by byte; digests only of values of six characters and more; a
    keyword regardless of case, and not in leaves of digits only.
    """
    named = rows.filter("payload is not null").withColumn("root", F.sha2("payload", 256))
    contents = named.select(F.col("root").alias("digest"), "payload").dropDuplicates(["digest"])
    leaves, known, _ = resolve(contents)
    asked = named.select("package", "root").distinct().join(leaves.select("root", "digest").distinct(), "root").select("package", "digest").distinct()
    hay = asked.join(known, "digest").select("package", "digest", F.decode("payload", "ISO-8859-1").alias("bytes_text"))
    coded = encoding_fanout(values.filter("not is_keyword")).filter(~F.col("encode_type").isin(*D.HASH_ENCODINGS) | (F.length("value") >= 6))
    coded = coded.select("package", F.col("field").alias("privacy_field"), "encode_type", F.decode("encoded", "ISO-8859-1").alias("needle"), F.xxhash64("package", "field", "encode_type", "encoded").alias("needle_id"))
    exact = text_contains(hay, "digest", "bytes_text", coded, "needle_id", "needle", on=["package"]).join(coded.drop("needle"), ["package", "needle_id"])
    words = values.filter("is_keyword").select("package", F.col("field").alias("privacy_field"), F.lower("value").alias("needle")).distinct()
    words = words.withColumn("needle_id", F.xxhash64("privacy_field", "needle"))
    low = hay.filter(~F.col("bytes_text").rlike("^[0-9]+$")).select("package", "digest", F.lower(F.coalesce(F.try_validate_utf8(F.encode("bytes_text", "ISO-8859-1").cast("string")), F.col("bytes_text"))).alias("low"))
    named_words = text_contains(low, "digest", "low", words, "needle_id", "needle", on=["package"]).join(words.drop("needle"), ["package", "needle_id"])
    hits = exact.select("package", "digest", "privacy_field", "encode_type").unionAll(named_words.select("package", "digest", "privacy_field", F.lit("normal").alias("encode_type"))).distinct()
    placed = named.drop("payload").join(leaves, "root").join(hits, ["package", "digest"])
    full = F.when(F.col("meta").isNotNull() & F.col("leaf_path").isNotNull(), F.concat_ws("@", "meta", "leaf_path")).otherwise(F.coalesce("leaf_path", "meta"))
    return placed.withColumn("leaf_path", full).drop("root", "digest")
