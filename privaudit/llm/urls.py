"""URL filters by a temporal list join: dated list entries become validity intervals, and an as-of join evaluates every
capture against the entries that were active when it was fetched.

An entry (list, verdict, action, key, day) adds a key to a list or removes it. A key is a host suffix ("example.com", which
also covers "www.example.com") or a URL prefix of whole path segments ("example.com/en"). Of all entries active on a
capture's day the longest key decides, of equally long ones the verdict "allow"; without any the decision is "none".

Captures are reduced to distinct (url, day) and then to distinct (key, day) before anything is joined, so a host with a
third of all captures is as many probes as it has days. A group of the as-of join holds one key's days, at most two rows
each; its size is bounded by the length of the calendar. Joins back to the captures are plain equi-joins, which AQE splits
where a key is hot. Nothing is broadcast by hand.

Null or unparsable urls and null days match nothing. Several actions of a list on a key in one day count as one, a removal
last; of different verdicts added that day "block" holds. An entry that adds a key again with another verdict ends the
interval before it. Entries with a null key, list or day are no entries. Repeated captures get the same decision each;
empty tables on either side are fine. Other columns of the captures stay, whatever their names, but for columns called
like one of the four of the result, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def host_of(url: str) -> Column:
    return F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def keys_of(url: str) -> Column:
    """All keys that cover a url: suffixes of its host and prefixes of its path; null if it has no host."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    steps = F.filter(F.split(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), "/"), lambda s: s != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), i), "/")))).otherwise(F.array().cast("array<string>"))
    return F.when(host != "", F.array_distinct(F.concat(suffixes, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (list, verdict, key, since, until): active from ``since`` up to, not including, ``until`` (null: open)."""
    daily = (entries.where("key is not null and list is not null and day is not null")
             .groupBy("list", "key", "day").agg(F.max("verdict").alias("verdict"), F.min(F.col("action") == "add").alias("active")))
    w = Window.partitionBy("list", "key").orderBy("day")
    now = F.when(F.col("active"), F.concat(F.lit("+"), F.coalesce("verdict", F.lit("")))).otherwise("-")
    turns = daily.withColumn("was", F.lag(now).over(w)).where(F.col("was").isNull() | (F.col("was") != now))
    return turns.withColumn("until", F.lead("day").over(w)).where("active").select("list", "verdict", "key", F.col("day").alias("since"), "until")


def active(probes: DataFrame, entries: DataFrame) -> DataFrame:
    """As-of join: for distinct probes (key, day), rows (key, day, list, verdict, since) of the entries active that day."""
    spans = intervals(entries)
    asked = probes.join(spans.select("list", "key").distinct(), "key")  # only keys that some list has
    begins = spans.select("list", "key", F.col("since").alias("day"), F.lit(0).alias("kind"), F.struct("since", "until", "verdict").alias("span"))
    rows = begins.unionByName(asked.select("list", "key", "day", F.lit(1).alias("kind"), F.lit(None).cast("struct<since:date,until:date,verdict:string>").alias("span")))
    last = F.last("span", ignorenulls=True).over(Window.partitionBy("list", "key").orderBy("day", "kind").rowsBetween(Window.unboundedPreceding, 0))
    return (rows.withColumn("span", last).where("kind = 1 and span is not null and (span.until is null or day < span.until)")
            .select("key", "day", "list", "span.verdict", "span.since"))


def decide(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "day") -> DataFrame:
    """``captures`` with decision (block, allow or none), and list, key and since of the entry that decides, in columns
    decision, matched_list, matched_key and matched_since."""
    asked = captures.select(F.col(url_col).alias("url"), F.col(day_col).cast("date").alias("day")).where("url is not null and day is not null").distinct()
    keyed = asked.withColumn("key", F.explode(keys_of("url")))
    hits = keyed.join(active(keyed.select("key", "day").distinct(), entries), ["key", "day"])
    best = F.max_by(F.struct("verdict", "list", "key", "since"), F.struct(F.length("key"), (F.col("verdict") == "allow").alias("a"), "list", "since"))
    chosen = hits.groupBy("url", "day").agg(best.alias("best"))
    rows = captures.select(F.struct("*").alias("row"), F.col(url_col).alias("url"), F.col(day_col).cast("date").alias("day"))
    stay = [c for c in captures.columns if c not in ("decision", "matched_list", "matched_key", "matched_since")]
    return rows.join(chosen, ["url", "day"], "left").select(
        *(F.col("row").getField(c).alias(c) for c in stay), F.coalesce("best.verdict", F.lit("none")).alias("decision"), F.col("best.list").alias("matched_list"),
        F.col("best.key").alias("matched_key"), F.col("best.since").alias("matched_since"))
