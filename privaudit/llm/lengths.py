"""Token counts by an exact length histogram: documents are aggregated by encoded length, and suffix sums of the histogram
answer totals, quantiles and truncated totals for every context limit.

A histogram has one row per distinct length, whatever the number of documents; equal lengths meet in a map-side combined
count. Suffix sums take two levels: lengths are dealt over ranges of 1,024, windows run inside a range, and one short
window runs over the ranges' totals.

Null and empty texts have length 0; null ids do not matter; repeated rows count each; an empty table gives an empty
histogram; other columns are ignored. Whole texts are encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from privaudit.llm import bpe
from privaudit.llm.tables import written

RANGE = 1024


def lengths(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens)."""
    return bpe.encode(docs, path, pattern, id_col, text_col).select("doc_id", bpe.n_tokens().alias("n_tokens"))


def histogram(measured: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """Rows (n_tokens, n_docs)."""
    return measured.groupBy(F.col(length_col).cast("long").alias("n_tokens")).agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """For each length as a context limit: documents of that length, at most as long (``docs_fit``) and longer; tokens of
    all documents (``tokens_total``), of those that fit, and what is left if all are truncated to the limit; and the
    share of documents that fit, which is the limit's quantile.

    Between two lengths in the table the documents that fit do not change, and the truncated total is that of the row
    below plus (limit - its length) * its ``docs_longer``.
    """
    hist = written(hist, "lengths")  # at most one row per length, and the encoding behind it runs once
    h = hist.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn("range", F.floor(F.col("n_tokens") / RANGE))
    down = Window.orderBy(F.desc("range")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    ranges = h.groupBy("range").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t")).select(
        "range", F.coalesce(F.sum("d").over(down), F.lit(0)).alias("docs_above"), F.coalesce(F.sum("t").over(down), F.lit(0)).alias("tokens_above"),
        F.sum("d").over(everything).alias("docs_total"), F.sum("t").over(everything).alias("tokens_total"))
    inside = Window.partitionBy("range").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    s = (h.withColumn("docs_in", F.coalesce(F.sum("n_docs").over(inside), F.lit(0))).withColumn("tokens_in", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
         .join(ranges, "range").withColumn("docs_longer", F.col("docs_above") + F.col("docs_in")).withColumn("tokens_longer", F.col("tokens_above") + F.col("tokens_in")))
    return s.select("n_tokens", "n_docs", (F.col("docs_total") - F.col("docs_longer")).alias("docs_fit"), "docs_longer", "tokens_total",
                    (F.col("tokens_total") - F.col("tokens_longer")).alias("tokens_fit"),
                    (F.col("tokens_total") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("tokens_truncated"),
                    ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("quantile"))


def at_limit(table: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit: docs_fit, docs_longer and tokens_truncated, from ``limits``; 0 and all below the shortest."""
    below = F.max_by(F.struct("n_tokens", "docs_fit", "docs_longer", "tokens_truncated"), F.when(F.col("n_tokens") <= limit, F.col("n_tokens")))
    row = table.agg(below.alias("r"), F.coalesce(F.max(F.col("docs_fit") + F.col("docs_longer")), F.lit(0)).alias("all"))
    longer = F.coalesce("r.docs_longer", "all")
    return row.select(F.coalesce("r.docs_fit", F.lit(0)).alias("docs_fit"), longer.alias("docs_longer"),
                      (F.coalesce("r.tokens_truncated", F.lit(0)) + (limit - F.coalesce("r.n_tokens", F.lit(0))) * longer).alias("tokens_truncated"))


def quantile(table: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least ``share`` of the documents do not exceed, in one row (null for an empty table)."""
    return table.where(F.col("quantile") >= share).agg(F.min("n_tokens").alias("n_tokens"))
