"""Sharding along a Hilbert curve: metadata is quantised, rows are ordered by the curve's index and cut into equal runs, so
that every shard is a compact region of all dimensions and its file statistics prune by each of them.

The law held is ``rows``: shard sizes are at most one row apart. Ranks are global but no task orders everything: rows are
counted per cell of the curve (at most 4,096 counts), a cell is cut into 64 slices or as many as keep each at ``SLICE_ROWS``
rows whatever the cell holds, the slices' counts are summed up along the curve, and rows are numbered inside their slice.

Null texts have no bytes (size 1, CRC of the empty string); a null source or language is quantised as 0; null ids sort
first; repeated rows get slots of their own; an empty table gives an empty result. Other columns are ignored by
``assign`` and kept by ``write_shards``, but for a column ``shard``, which the number of the shard replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from privaudit.llm.tables import written

BITS = 4
#: Rows that one task numbers, and the least number of slices, so that a cell of fewer rows is dealt to several tasks too.
SLICE_ROWS, LEAST_SLICES = 1 << 18, 64


def hilbert_index(coordinates: str, dims: int, bits: int) -> Column:
    """Index on the Hilbert curve of an array column of ``dims`` integers of ``bits`` bits, by bit operations on arrays."""
    undo = f"""aggregate(sequence({bits} - 1, 1, -1), {coordinates}, (x, s) -> aggregate(sequence(0, {dims} - 1), x, (y, i) ->
        CASE WHEN y[i] & shiftleft(1, s) <> 0 THEN transform(y, (v, k) -> CASE WHEN k = 0 THEN v ^ (shiftleft(1, s) - 1) ELSE v END)
             ELSE transform(y, (v, k) -> CASE WHEN k = 0 OR k = i THEN v ^ ((y[0] ^ y[i]) & (shiftleft(1, s) - 1)) ELSE v END) END))"""
    if bits == 1:
        undo = coordinates
    gray = f"transform({undo}, (v, k) -> aggregate(slice({undo}, 1, k + 1), 0, (a, b) -> a ^ b))"
    flip = f"aggregate(sequence({bits} - 1, 1, -1), 0, (t, s) -> CASE WHEN element_at(g, {dims}) & shiftleft(1, s) <> 0 THEN t ^ (shiftleft(1, s) - 1) ELSE t END)" if bits > 1 else "0"
    return F.expr(f"""aggregate(transform(array({gray}), g -> transform(g, v -> v ^ {flip})), 0L, (n, x) ->
        aggregate(sequence({bits} - 1, 0, -1), n, (h, s) -> aggregate(x, h, (u, v) -> 2 * u + (shiftright(v, s) & 1))))""")


def curve(spark: SparkSession, dims: int = 3, bits: int = BITS) -> DataFrame:
    """All cells (cell, h) of the curve, 2 ** (dims * bits) rows; a cell is its coordinates' bits one after the other."""
    at = ", ".join(f"cast(shiftright(id, {bits * (dims - 1 - d)}) & {(1 << bits) - 1} AS int)" for d in range(dims))
    return spark.range(1 << (dims * bits)).withColumn("x", F.expr(f"array({at})")).select(F.col("id").alias("cell"), hilbert_index("x", dims, bits).cast("long").alias("h"))


def hashed(c: str) -> Column:
    """A category as 4 bits of its digest."""
    return F.when(F.col(c).isNull(), 0).otherwise(F.conv(F.substring(F.md5(F.col(c).cast("string")), 1, 1), 16, 10).cast("long"))


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", categories: tuple[str, str] = ("source", "lang"), slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, h (curve index), shard and slot, gapless from 0."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    scale = F.least(F.floor(F.log2(size.cast("double"))), F.lit(15)).cast("long")
    facts = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                                (hashed(categories[0]) * 256 + hashed(categories[1]) * 16 + scale).alias("cell"))
                    .withColumn("dealt", F.xxhash64("doc_id", "text_crc32")), "hilbert")
    held = facts.groupBy("cell").agg(F.greatest(F.lit(LEAST_SLICES), F.ceil(F.count("*") / slice_rows)).alias("slices"))
    rows = facts.join(F.broadcast(held.join(F.broadcast(curve(spark)), "cell")), "cell").withColumn("slice", F.pmod("dealt", "slices"))  # 4,096 rows
    counts = rows.groupBy("h", "slice").agg(F.count("*").alias("n"))
    along = Window.orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.groupBy("h").agg(F.sum("n").alias("n")).select("h", F.coalesce(F.sum("n").over(along), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy()).alias("total"))
    inside = Window.partitionBy("h").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = (counts.withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(cells), "h")
              .select("h", "slice", (F.col("base") + F.col("before")).alias("start"), "total"))
    place = F.row_number().over(Window.partitionBy("h", "slice").orderBy("doc_id", "text_crc32", "size"))
    ranked = rows.withColumn("place", place).join(starts, ["h", "slice"]).withColumn("rank", F.col("start") + F.col("place") - 1)
    shard = F.expr(f"rank * {shards} div total")
    first = F.expr(f"(({shards} - 1) + (rank * {shards} div total) * total) div {shards}")  # the first rank of the shard: its share rounded up
    return ranked.select("doc_id", "size", "text_crc32", "h", shard.cast("int").alias("shard"), (F.col("rank") - first).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", **options) -> None:
    """Write ``docs`` under ``path``/shard=n, each shard in the order of the curve; ids must be unique."""
    placed = assign(docs, shards, id_col=id_col, **options).select("doc_id", "shard", "slot")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    rows = rows.join(placed, F.col("id").eqNullSafe(F.col("doc_id"))).repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    rows.select(*(F.col("row").getField(c).alias(c) for c in docs.columns if c != "shard"), "shard").write.partitionBy("shard").parquet(path)
