"""Ordered scans over a group that stay parallel when one group holds a large share of all rows.

A plain window sorts a whole group in one task. Here groups above ``hot_rows`` are cut into consecutive chunks
by quantiles of the ordering column; each chunk is scanned on its own and the state at the end of the earlier
chunks is added afterwards. The plan is the same for every size; ordinary groups are one chunk. Rows with equal
positions stay in one chunk, whose window spills.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

HOT_ROWS = 5_000_000


@dataclass(frozen=True)
class Running:
    """One running value: ``sum``, ``count``, ``last`` (latest non-null), ``prev`` (previous row) or ``mark`` (number, from the
    group's first row on, of the latest row where the expression is true)."""

    out: str
    kind: str
    expr: Column | None = None


def _position(df: DataFrame, name: str) -> Column:
    dtype = df.schema[name].dataType
    if isinstance(dtype, (T.TimestampNTZType, T.TimestampType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name).cast("double")


#: Steps of a split group's ordering column; a group is cut into at most so many chunks.
GRID = 1024


def split_hot_groups(df: DataFrame, keys: list[str], position: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``_chunk``: 0 for ordinary groups, else the number of the group's chunk along the ordering column; and ``_split``,
    whether the group is cut at all.

    A group of n rows is cut into ceil(n / hot_rows) chunks, so a group just above the limit gets two and not as many
    as the largest one. Sizes and bounds stay DataFrames: nothing is counted or collected on the driver, and where no
    group is hot the join has an empty side, which AQE drops.
    """
    hot = df.groupBy(*keys).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > hot_rows)
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"h.{k}")) for k in keys]
    placed = df.withColumn("_pos", _position(df, position))
    steps = F.array(*[F.lit(i / GRID) for i in range(1, GRID)])
    bounds = (placed.alias("d").join(hot.alias("h"), same).groupBy(*[F.col(f"d.{k}").alias(k) for k in keys])
              .agg(F.percentile_approx("_pos", steps, 10_000).alias("_bounds"), F.least(F.lit(GRID), F.ceil(F.first("_rows") / hot_rows)).alias("_chunks")))
    joined = placed.alias("d").join(bounds.alias("h"), same, "left")
    step = F.size(F.filter(F.col("h._bounds"), lambda b: F.col("_pos") > b))
    chunk = F.when(F.col("h._bounds").isNull(), F.lit(0)).otherwise(F.floor(step * F.col("h._chunks") / GRID).cast("int"))
    return joined.select(*[F.col(f"d.{c}").alias(c) for c in df.columns], chunk.alias("_chunk"), F.col("h._bounds").isNotNull().alias("_split"))


def prepare(df: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Frame for several scans over the same groups, so that group sizes are looked up once."""
    return df if "_chunk" in df.columns else split_hot_groups(df, keys, order[0], hot_rows)


def running(df: DataFrame, keys: list[str], order: list[str], aggs: list[Running],
            hot_rows: int = HOT_ROWS) -> DataFrame:
    """Running values per group in the given order (first ordering column: number or timestamp).

    All values are the state of one scan: each chunk is scanned once, the state at its last row is combined over the
    earlier chunks of its group, and that is added to the rows. Only groups that are cut have such states: without any,
    that side of the plan is empty, and AQE drops it together with the scan below it. A frame that already carries
    ``_chunk`` keeps it.
    """
    base = prepare(df, keys, order, hot_rows)
    part = [*keys, "_chunk"]
    w = W.partitionBy(*part).orderBy(*order)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)

    def operand(a):
        return F.lit(1).cast("long") if a.kind == "count" else (
            F.coalesce(a.expr, F.lit(0)) if a.kind == "sum" else a.expr)

    local = {"sum": lambda a: F.sum(operand(a)).over(upto), "count": lambda a: F.sum(operand(a)).over(upto),
             "last": lambda a: F.last(operand(a), ignorenulls=True).over(upto),
             "prev": lambda a: F.lag(operand(a)).over(w),
             "mark": lambda a: F.last(F.when(operand(a), F.col("_rn")), ignorenulls=True).over(upto)}

    def scanned(rows):
        own = rows.select("*", F.row_number().over(w).cast("long").alias("_rn"))
        return own.select("*", *[local[a.kind](a).alias(f"_l_{a.out}") for a in aggs])

    # the state at the end of each chunk: the running values of its last row
    end = F.struct(*[(operand(a) if a.kind == "prev" else F.col(f"_l_{a.out}")).alias(a.out) for a in aggs])
    cut = base.filter("_split") if "_split" in base.columns else base
    ends = scanned(cut).groupBy(*part).agg(F.max_by(end, "_rn").alias("_end"), F.max("_rn").alias("_size"))
    before = W.partitionBy(*keys).orderBy("_chunk")
    earlier = before.rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("_rows", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    carry_of = {"sum": lambda a: F.sum(f"_end.{a.out}").over(earlier), "count": lambda a: F.sum(f"_end.{a.out}").over(earlier),
                "last": lambda a: F.last(f"_end.{a.out}", ignorenulls=True).over(earlier), "prev": lambda a: F.lag(f"_end.{a.out}").over(before),
                "mark": lambda a: F.last(F.col("_rows") + F.col(f"_end.{a.out}"), ignorenulls=True).over(earlier)}
    # at most 2 * rows / hot_rows rows, joined by their key like any others
    carry = ends.select(*part, "_rows", *[carry_of[a.kind](a).alias(f"_b_{a.out}") for a in aggs]).filter("_chunk > 0")
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in part]
    joined = scanned(base).alias("s").join(carry.alias("b"), on, "left")

    def merged(a):
        loc, bef = F.col(f"_l_{a.out}"), F.col(f"_b_{a.out}")
        if a.kind in ("sum", "count"):
            return loc + F.coalesce(bef, F.lit(0))
        if a.kind == "last":
            return F.coalesce(loc, bef)
        if a.kind == "mark":
            return F.coalesce(loc + F.coalesce(F.col("b._rows"), F.lit(0)), bef)
        return F.when(F.col("_rn") == 1, bef).otherwise(loc)

    return joined.select(*[F.col(f"s.{c}").alias(c) for c in df.columns], *[merged(a).alias(a.out) for a in aggs])


def numbered(df: DataFrame, keys: list[str], order: list[str], out: str = "rn", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Row number per group."""
    return running(df, keys, order, [Running(out, "count")], hot_rows)


def run_lengths(df: DataFrame, keys: list[str], order: list[str], starts: Column, out: str = "run_pos",
                run_id: str | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Position inside the current run, where ``starts`` marks the first row of a run; one scan."""
    start = F.coalesce(starts, F.lit(False))
    aggs = [Running("_n", "count"), Running("_n0", "mark", start), *([Running("_run", "sum", start.cast("int"))] if run_id else [])]
    res = running(df, keys, order, aggs, hot_rows).withColumn(out, F.col("_n") - F.coalesce(F.col("_n0"), F.lit(1)) + 1)
    return (res.withColumnRenamed("_run", run_id) if run_id else res).drop("_n", "_n0")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], ts: str, tie: str, right_cols: list[str],
              hot_rows: int = HOT_ROWS) -> DataFrame:
    """Each left row with the latest right row of the same key at or before its time."""
    value = F.struct(*[F.col(c) for c in right_cols])
    rows = [F.col(k) for k in keys] + [F.col(ts), F.col(tie).cast("long").alias("_tie")]
    l_cols = [c for c in left.columns if c not in (*keys, ts)]
    r = right.select(*rows, F.lit(0).alias("_side"), value.alias("_value"))
    lft = left.select(*rows, F.lit(1).alias("_side"), F.struct(*l_cols).alias("_left"))
    both = lft.unionByName(r, allowMissingColumns=True)
    seen = running(both, keys, [ts, "_side", "_tie"], [Running("_match", "last", F.col("_value"))], hot_rows)
    return (seen.filter("_side = 1")
            .select(*keys, ts, *[F.col(f"_left.{c}").alias(c) for c in l_cols],
                    *[F.col(f"_match.{c}").alias(c) for c in right_cols]))


def window_ranks(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, left_pos: Column, right_pos: Column,
                 right_tie: str, before: int, after: int, hot_rows: int = HOT_ROWS):
    """Rank ranges of right rows that fall in ``[pos - before, pos + after]`` of each left row.

    Returns ``(ranges, ranked)``: per left id the ranks just before and up to the end of its window, and the right
    rows with their rank. Counting is a running count over one merged ordering, so no pair is ever produced; the
    first n matches of a row are an equi-join on (key, rank).
    """
    k = [F.col(c) for c in keys]
    r = right.select(*k, right_pos.cast("long").alias("_pos"), F.lit(1).alias("_side"),
                     F.col(right_tie).cast("long").alias("_tie"), F.struct(*right.columns).alias("_right"))
    probes = left.select(*k, F.col(left_id).alias("_lid"), left_pos.cast("long").alias("_lp"))
    ends = F.array(F.struct((F.col("_lp") - before).alias("pos"), F.lit(0).alias("side")),
                   F.struct((F.col("_lp") + after).alias("pos"), F.lit(2).alias("side")))
    p = (probes.select(*k, "_lid", F.explode(ends).alias("_e"))
         .select(*k, "_lid", F.col("_e.pos").alias("_pos"), F.col("_e.side").alias("_side"), F.lit(0).cast("long").alias("_tie")))
    both = r.unionByName(p, allowMissingColumns=True)
    seen = running(both, keys, ["_pos", "_side", "_tie"],
                   [Running("_rank", "sum", F.when(F.col("_side") == 1, F.lit(1)).otherwise(F.lit(0)).cast("long"))], hot_rows)
    ranges = (seen.filter("_side <> 1").groupBy(*keys, F.col("_lid").alias(left_id))
              .agg(F.max(F.when(F.col("_side") == 0, F.col("_rank"))).alias("lo"),
                   F.max(F.when(F.col("_side") == 2, F.col("_rank"))).alias("hi")))
    ranked = seen.filter("_side = 1").select(*keys, F.col("_rank").alias("rank"), F.col("_right").alias("match"))
    return ranges, ranked
