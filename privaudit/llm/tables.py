"""Helpers the operators share: scratch tables, keyed frames and connected components."""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from privaudit.session import scratch_path

#: Python memory a task may give to one Arrow output batch.
BATCH_BYTES = 8 << 20


def keyed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text, under fixed names; other columns of any name stay out of the operator."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def finite_vectors(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, v: array<double>) whose vector is not null and holds neither null nor non-finite entries."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & finite)


def rows_and_texts(batches, text_col: str, rows: int = 1000):
    """Slices of Arrow batches of one column of whole rows (structs), each with the texts of its rows as a list."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            row = b.column(0).slice(k, rows)
            text = pc.struct_field(row, text_col)
            yield row, (text if pa.types.is_string(text.type) else pc.cast(text, pa.string())).to_pylist()


def give_back() -> None:
    """Hand freed memory back to the system; Python workers live on from task to task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def released(run):
    """``run`` for mapInArrow, giving back memory at the end of a task."""
    def outer(batches):
        yield from run(batches)
        give_back()

    return outer


def text_key(text_col: str = "text") -> Column:
    """Digest by which a text is known; null and empty texts are one."""
    return F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)


def digest_of(text: str | None) -> str:
    """``text_key`` of one text in Python."""
    return hashlib.sha256((text or "").encode("utf-8", "surrogatepass")).hexdigest()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, read by several branches, safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Delete the table behind a frame of ``written`` that nothing reads any more; frames of other kinds stay."""
    spark, path = df.sparkSession, getattr(df, "_scratch_path", None)
    if path:
        held = spark._jvm.org.apache.hadoop.fs.Path(path)
        held.getFileSystem(spark._jsc.hadoopConfiguration()).delete(held, True)


#: Bits of the filter of ``maybe_in``, and of a piece of it.
SIEVE_BITS, PIECE_BITS = 1 << 24, 1 << 20


def maybe_in(keys: DataFrame, h: str, own: Column) -> Column:
    """Whether the hash ``own`` may be among the hashes in column ``h`` of ``keys``: always true for those that are.

    A bitmap of fixed size (2 MB), so it is broadcast whatever the number of keys; with very many keys it lets all rows
    through. It goes before an exact join, which then shuffles only the rows that may match.
    """
    spark = keys.sparkSession

    def piece(key, rows):
        bits = np.zeros(PIECE_BITS, dtype=bool)
        bits[rows.column("slot").to_numpy() % PIECE_BITS] = True
        return pa.table({"piece": pa.array([key[0].as_py()], type=pa.int64()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], type=pa.binary())})

    slots = keys.select(F.pmod(F.col(h), F.lit(SIEVE_BITS)).alias("slot")).distinct()
    pieces = {r["piece"]: bytes(r["bits"]) for r in slots.groupBy(F.expr(f"slot div {PIECE_BITS}").alias("piece")).applyInArrow(piece, "piece long, bits binary").collect()}  # 2 MB at most
    bitmap = b"".join(pieces.get(k, bytes(PIECE_BITS // 8)) for k in range(SIEVE_BITS // PIECE_BITS)) if pieces else b""
    held = spark.createDataFrame([(bytearray(bitmap),)], "bits binary").select("bits").scalar()
    slot = F.pmod(own, F.lit(SIEVE_BITS))
    byte = F.conv(F.hex(F.substring(held, (slot / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.call_function("shiftright", byte, (slot % 8).cast("int")) % 2 == 1, F.lit(False))


def bytes_of(df: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts; sizes the number of blocks an operator works in."""
    return df.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long")), F.lit(0)).alias("n")).first()["n"]


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Connected components of ``edges`` (u, v: long): rows (node, root), root the smallest node that can be reached.

    Alternates large-star and small-star rounds. Neighbour lists are never built: a round takes the minimum per node
    (map-side combined) and joins it to the edges, where AQE splits the partition of a node with very many edges. Each
    round is written as a table in the shared folder; unlike a checkpoint, that computes it once.
    """
    def both(e: DataFrame) -> DataFrame:
        return e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))

    def starred(e: DataFrame) -> DataFrame:
        least = e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return e.join(least, "u")

    def digest(e: DataFrame):
        return e.agg(F.count("*").alias("n"), F.expr("sum(cast(xxhash64(u, v) as decimal(20, 0)))").alias("h")).first()

    e = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "components")
    seen = digest(e)
    for _ in range(max_rounds):
        if seen["n"] == 0:
            break
        large = starred(both(e)).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")
        before, e = e, written(starred(large).select(pairs).select("e.u", "e.v").where("u <> v").distinct(), "components")
        drop_written(before)
        now = digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def empty_like(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
