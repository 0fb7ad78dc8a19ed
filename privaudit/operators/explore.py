"""Exploration runs: running metrics, novelty scores, stuck runs, sampling and screen states."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privaudit import dictionaries as D
from privaudit.functions.scalars import _col
from privaudit.operators.scans import HOT_ROWS, Running, numbered, prepare, run_lengths, running
from privaudit.session import stored


def _first_seen(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Smallest order tuple per (keys, value): one mergeable aggregate, no sort."""
    return df.groupBy(*keys, value).agg(F.min(F.struct(*order)).alias("_f")).select(*keys, value, *[F.col(f"_f.{o}").alias(o) for o in order])


def running_metrics(steps: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Cumulative reward, distinct APIs and distinct activities up to each step.

    ``steps``: keys, order, reward, api_list, activity. A distinct count is the running number of first occurrences.
    """
    apis = steps.select(*keys, *order, F.explode(F.array_distinct("api_list")).alias("_v")).filter("_v is not null")
    new_apis = _first_seen(apis, keys, "_v", order).groupBy(*keys, *order).agg(F.count("*").alias("_na"))
    acts = steps.filter("activity is not null and activity <> '' and activity <> 'unknown'").withColumnRenamed("activity", "_v")
    new_acts = _first_seen(acts, keys, "_v", order).groupBy(*keys, *order).agg(F.count("*").alias("_nt"))
    j = steps.join(new_apis, [*keys, *order], "left").join(new_acts, [*keys, *order], "left")
    out = running(j, keys, order, [
        Running("cum_reward", "sum", F.col("reward")), Running("unique_apis", "sum", F.col("_na")), Running("unique_activities", "sum", F.col("_nt"))], hot_rows)
    return out.withColumn("api_count", F.size("api_list")).drop("_na", "_nt")


def novelty_scores(steps: DataFrame, keys: list[str], order: list[str], mode: int = 2, weight: float = D.API_WEIGHT,
                   decay: float = D.API_DECAY, hot_rows: int = HOT_ROWS) -> DataFrame:
    """API score per step: ``weight · decay^(earlier triggers)`` summed over its APIs if it has a new (state, API) pair.

    ``steps``: keys, order, state_id, api_list. Mode 0 is off, 1 pays once for a new pair, 3 pays for any API.
    """
    rows = steps.select(*keys, *order, "state_id", F.posexplode("api_list").alias("_pos", "api"))
    seen = numbered(rows, [*keys, "api"], [*order, "_pos"], "_nth", hot_rows)
    gain = seen.withColumn("_g", F.lit(weight) * F.pow(F.lit(decay), F.col("_nth") - 1)).groupBy(*keys, *order).agg(F.sum("_g").alias("_decayed"))
    new = (rows.groupBy(*keys, "state_id", "api").agg(F.min(F.struct(*order)).alias("_f"))
           .select(*keys, *[F.col(f"_f.{o}").alias(o) for o in order]).groupBy(*keys, *order).agg(F.count("*").alias("_new")))
    j = steps.join(gain, [*keys, *order], "left").join(new, [*keys, *order], "left")
    new_pairs = F.coalesce("_new", F.lit(0))
    score = {0: F.lit(0.0), 1: F.when(new_pairs > 0, F.lit(weight)).otherwise(0.0),
             2: F.when(new_pairs > 0, F.coalesce("_decayed", F.lit(0.0))).otherwise(0.0),
             3: F.when(F.size("api_list") > 0, F.lit(weight)).otherwise(0.0)}[mode]
    return j.withColumn("new_pairs", new_pairs).withColumn("api_score", score).drop("_decayed", "_new")


def stuck_vote(same_state, xml_score, img_same) -> Column:
    """Two of: same state, layout similarity above 0.97, same image."""
    votes = (F.coalesce(_col(same_state), F.lit(False)).cast("int") + F.coalesce(_col(xml_score) > 0.97, F.lit(False)).cast("int")
             + F.coalesce(_col(img_same), F.lit(False)).cast("int"))
    return votes >= 2


def stuck_runs(steps: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_ROWS, trapped_at: int = 10) -> DataFrame:
    """Stuck flag, length of the current stuck run and whether it traps the run; a recovery ends the run.

    ``steps``: keys, order, state_id, xml_score, img_same, recovered.
    """
    base = prepare(steps, keys, order, hot_rows)
    p = running(base, keys, order, [Running("_prev_state", "prev", F.col("state_id"))], hot_rows)
    vote = stuck_vote(F.col("state_id") == F.col("_prev_state"), "xml_score", "img_same")
    p = p.withColumn("is_stuck", vote & ~F.coalesce("recovered", F.lit(False))).drop("_prev_state")
    stuck = F.coalesce("is_stuck", F.lit(False))
    q = running(p, keys, order, [Running("_was", "prev", stuck), Running("_n", "count"), Running("_free", "mark", ~stuck)], hot_rows)
    n = F.when(F.col("is_stuck"), F.col("_n") - F.coalesce("_free", F.lit(0))).otherwise(0)
    return q.withColumn("was_stuck", F.coalesce("_was", F.lit(False))).withColumn("stuck_run", n).withColumn("trapped", n >= trapped_at).drop("_was", "_n", "_free", "_chunk", "_split")


def step_scores(stuck: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """State, widget and penalty scores of each step; ``stuck`` comes from :func:`stuck_runs`."""
    moved = stuck.filter("not is_stuck")
    first = _first_seen(moved, keys, "state_id", order).withColumn("_new", F.lit(True)).drop("state_id")
    j = stuck.join(first, [*keys, *order], "left")
    s = F.col("is_stuck")
    state = (F.when(F.col("_new"), D.NEW_STATE_SCORE).when(s, 0.0)
             .when(F.col("was_stuck") | F.coalesce("recovered", F.lit(False)), D.ESCAPE_SCORE).otherwise(D.REVISIT_SCORE))
    penalty = F.when(s & (F.col("stuck_run") > 5), D.STUCK_SCORE * 2).when(s, D.STUCK_SCORE).otherwise(0.0)
    return (j.withColumn("state_score", state).withColumn("widget_score", F.when(s, 0.0).otherwise(D.WIDGET_SCORE))
            .withColumn("penalty", penalty).drop("_new"))


def repeat_runs(steps: DataFrame, keys: list[str], order: list[str], action: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """How often the current action has been repeated in a row (0 for its first use)."""
    base = prepare(steps, keys, order, hot_rows)
    p = running(base, keys, order, [Running("_prev", "prev", F.col(action)), Running("_n", "count")], hot_rows)
    p = p.withColumn("_s", (F.col("_n") == 1) | ~F.col("_prev").eqNullSafe(F.col(action))).drop("_n", "_prev")
    r = run_lengths(p, keys, order, F.col("_s"), "_len", hot_rows=hot_rows)
    return r.withColumn("repeat_count", F.col("_len") - 1).drop("_len", "_s", "_chunk", "_split")


def sample_every(df: DataFrame, keys: list[str], order: list[str], mod: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """First, N+1st, 2N+1st, … row of each key."""
    n = numbered(df, keys, order, "_n", hot_rows)
    return n.filter(F.pmod(F.col("_n"), F.lit(mod)) == (1 % mod)).drop("_n")


CHUNK_MS = 3_600_000
#: Chunks that one task composes to a chunk of the next level, and the time a chunk of the last level covers at least.
FAN = 64
TOP_MS = 10 * 24 * 3_600_000


def rate_limited(df: DataFrame, key: str, ts: str, window_ms: int = 1500, chunk_ms: int = CHUNK_MS) -> DataFrame:
    """Keep a row only if ``window_ms`` have passed since the last kept row of its key; rows without a key or time go.

    The anchor is the last *kept* row, so the rule is sequential, but only one number is carried: the time of that
    row. Rows are reduced to one per key and millisecond (later ones are never kept) and cut into time chunks. A chunk
    is a function from its possible first kept rows to its last kept one. ``FAN`` chunks compose to one of the next
    level, up to chunks of ``TOP_MS``; entries are then handed down the same tree and each chunk marks its kept rows.
    A busy key is spread over its chunks on every level, and no task sees them all.
    """
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    rest = [c for c in df.columns if c != key]
    slim = (df.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key, ms.alias("_ms")).agg(F.min(F.struct(ts, *[c for c in rest if c != ts])).alias("_row"))
            .withColumn("_chunk", F.floor(F.col("_ms") / chunk_ms)))
    ktype = f"`{key}` {df.schema[key].dataType.simpleString()}"
    exit_type, entry_type = f"{ktype}, _chunk long, _first long, _last long", f"{ktype}, _chunk long, _first long"
    times = slim.select(key, "_chunk", "_ms")
    parent = F.floor(F.col("_chunk") / FAN).alias("_parent")
    # small tables that both ways through the tree read
    levels, width = [stored(times.groupBy(key, "_chunk").applyInPandas(_chunk_exits(key, window_ms, chunk_ms), exit_type), "exits")], chunk_ms
    while width < TOP_MS:
        width *= FAN
        levels.append(stored(levels[-1].groupBy(key, parent).applyInPandas(_compose_exits(key, window_ms, width), exit_type), "exits"))
    entry = levels[-1].withColumn("_entry", F.lit(None).cast("long")).groupBy(key).applyInPandas(_follow_chunks(key, window_ms), entry_type)
    for below in reversed(levels[:-1]):
        inside = below.withColumn("_parent", parent).join(entry.select(key, F.col("_chunk").alias("_parent"), F.col("_first").alias("_entry")), [key, "_parent"])
        entry = inside.groupBy(key, "_parent").applyInPandas(_follow_chunks(key, window_ms), entry_type)
    kept = times.join(entry, [key, "_chunk"]).groupBy(key, "_chunk").applyInPandas(_mark_kept(key, window_ms), f"{ktype}, _ms long")
    return slim.join(kept, [key, "_ms"], "left_semi").select(key, "_row.*").select(*df.columns)


def _chunk_exits(key: str, window_ms: int, chunk_ms: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["_ms"].to_numpy())
        nxt = np.searchsorted(t, t + window_ms)
        last = np.arange(len(t))
        for i in range(len(t) - 1, -1, -1):
            if nxt[i] < len(t):
                last[i] = last[nxt[i]]
        chunk = int(pdf["_chunk"].iloc[0])
        # a row can be the first kept one only near the start of its chunk
        n = min(len(t), int(np.searchsorted(t, chunk * chunk_ms + window_ms)) + 1)
        return pd.DataFrame({key: pdf[key].iloc[0], "_chunk": chunk, "_first": t[:n], "_last": t[last[:n]]})
    return run


def _next_exits(pdf: pd.DataFrame, window_ms: int) -> tuple[pd.DataFrame, np.ndarray]:
    """Possible first kept rows of several chunks in time order, and for each the place of the one that follows its last kept row."""
    pdf = pdf.sort_values("_first", ignore_index=True)
    return pdf, np.searchsorted(pdf["_first"].to_numpy(), pdf["_last"].to_numpy() + window_ms)


def _compose_exits(key: str, window_ms: int, width_ms: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, nxt = _next_exits(pdf, window_ms)
        first, last = pdf["_first"].to_numpy(), pdf["_last"].to_numpy().copy()
        for i in range(len(last) - 1, -1, -1):
            if nxt[i] < len(last):
                last[i] = last[nxt[i]]
        chunk = int(first[0] // width_ms)
        n = min(len(first), int(np.searchsorted(first, chunk * width_ms + window_ms)) + 1)
        return pd.DataFrame({key: pdf[key].iloc[0], "_chunk": chunk, "_first": first[:n], "_last": last[:n]})
    return run


def _follow_chunks(key: str, window_ms: int):
    """The first kept row of every chunk that has one, from the entry of their parent or, on top, the key's first row."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, nxt = _next_exits(pdf, window_ms)
        entry = pdf["_entry"].iloc[0]
        i, path = 0 if pd.isna(entry) else int(np.searchsorted(pdf["_first"].to_numpy(), int(entry))), []
        while i < len(pdf):
            path.append(i)
            i = int(nxt[i])
        return pdf.loc[path, [key, "_chunk", "_first"]]
    return run


def _mark_kept(key: str, window_ms: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        t = np.sort(pdf["_ms"].to_numpy())
        i, kept = int(np.searchsorted(t, pdf["_first"].iloc[0])), []
        while i < len(t):
            kept.append(t[i])
            i = int(np.searchsorted(t, t[i] + window_ms))
        return pd.DataFrame({key: pdf[key].iloc[0], "_ms": kept})
    return run


# --- screens --------------------------------------------------------------------------------------

def structure_tokens(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Class and digit-free resource-id tokens of a screen with their counts."""
    res = F.regexp_replace(F.regexp_replace(F.trim("resource_id"), r"[0-9]+", ""), "_+", "_")
    toks = F.array_compact(F.array(F.when(F.col("class") != "", F.concat(F.lit("c:"), F.col("class"))), F.when(F.col("resource_id") != "", F.concat(F.lit("r:"), res))))
    return nodes.select(*keys, F.explode(toks).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))


def screen_signature(tokens: DataFrame, keys: list[str], top: int = 120) -> DataFrame:
    """``token#count`` list of the most frequent tokens per screen."""
    from pyspark.sql import Window as W
    w = W.partitionBy(*keys).orderBy(F.desc("n"), "token")
    t = tokens.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top)
    part = F.array_sort(F.collect_list(F.struct("_rn", F.concat_ws("#", "token", F.col("n").cast("string")).alias("s"))))
    return t.groupBy(*keys).agg(part.alias("_p")).select(*keys, F.array_join(F.transform("_p", lambda x: x["s"]), "|").alias("signature"))


def state_id(activity, signature) -> Column:
    return F.md5(F.concat_ws("_", _col(activity), _col(signature)))


def screen_rollup(visits: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct triggered APIs and visited widgets per screen; ``visits``: keys, api, widget_id."""
    return visits.groupBy(*keys).agg(F.countDistinct("api").alias("n_apis"), F.countDistinct("widget_id").alias("n_widgets"))
