"""Joins Spark has no operator for, rewritten as hash joins on derived keys.

Substring and prefix conditions would plan as nested loops over both sides. Every helper here derives keys that
must be equal whenever the condition holds, joins on them and re-checks the condition, so the result is exact.
"""

from __future__ import annotations

from itertools import combinations

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def _lengths(df: DataFrame, col: str):
    """Distinct lengths in a dictionary column as a scalar subquery; they are no more than its longest entry has characters."""
    return df.agg(F.array_sort(F.collect_set(F.length(col)))).scalar()


def _pieces(text, size):
    # the lookahead finds overlapping pieces in one pass over the text
    return F.regexp_extract_all(text, F.concat(F.lit("(?s)(?=(.{"), size.cast("string"), F.lit("}))")), F.lit(1))


def _substrings(col: str, lengths):
    """All substrings of the given lengths."""
    usable = F.filter(lengths, lambda n: (n > 0) & (n <= F.length(col)))
    return F.array_distinct(F.flatten(F.transform(usable, lambda n: _pieces(F.col(col), n))))


def substring_pairs(texts: DataFrame, text: str, terms: DataFrame, term: str, on: list[str] | None = None,
                    both_ways: bool = False) -> DataFrame:
    """Distinct ``(on…, text, term)`` where the text contains the term (or, both ways, the reverse too).

    For short strings such as hosts and item names: every substring with a length found in the dictionary becomes
    a join key.
    """
    on = on or []
    t = texts.select(*on, F.col(text).alias("_text")).filter("_text is not null and _text <> ''").distinct()
    d = terms.select(*on, F.col(term).alias("_term")).filter("_term is not null and _term <> ''").distinct()
    fwd = (t.withColumn("_sizes", _lengths(d, "_term")).withColumn("_term", F.explode(_substrings("_text", F.col("_sizes"))))
           .join(d, [*on, "_term"]).select(*on, "_text", "_term"))
    if both_ways:
        rev = (d.withColumn("_sizes", _lengths(t, "_text")).withColumn("_text", F.explode(_substrings("_term", F.col("_sizes"))))
               .join(t, [*on, "_text"]).select(*on, "_text", "_term"))
        fwd = fwd.unionByName(rev).distinct()
    return fwd.withColumnsRenamed({"_text": text, "_term": term})


def prefix_pairs(paths: DataFrame, path: str, prefixes: DataFrame, prefix: str) -> DataFrame:
    """Distinct ``(path, prefix)`` where the path starts with the prefix."""
    p = paths.select(F.col(path).alias("_path")).filter("_path is not null").distinct()
    d = prefixes.select(F.col(prefix).alias("_prefix")).filter("_prefix <> ''").distinct()
    usable = F.filter("_sizes", lambda n: n <= F.length("_path"))
    heads = F.transform(usable, lambda n: F.left(F.col("_path"), n))
    return (p.withColumn("_sizes", _lengths(d, "_prefix")).withColumn("_prefix", F.explode(heads)).join(d, "_prefix")
            .select(F.col("_path").alias(path), F.col("_prefix").alias(prefix)))


WORD_BREAK = "[^A-Za-z0-9]+"
GRAM = 8
#: Largest dictionary that is broadcast, and what a row of it counts beside its value.
DICTIONARY_BYTES, ROW_BYTES = 8 << 20, 64


def _anchored(values: DataFrame, value: str) -> DataFrame:
    """Add the anchor of each value: ``_kind`` word, pair, inside or gram, ``_key`` and its ``_shape``."""
    words = F.split(F.col(value), WORD_BREAK)
    inner = F.filter(F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0))), lambda x: x != "")
    longest = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("w"))))["w"]
    across = F.nullif(F.regexp_extract(value, "([A-Za-z0-9]{0,3}[^A-Za-z0-9]+[A-Za-z0-9]{1,4})", 1), F.lit(""))
    v = values.withColumn("_word", longest).withColumn("_pair", across)
    kind = F.when(F.col("_word").isNotNull(), "word").when(F.col("_pair").isNotNull(), "pair") \
        .when(F.col(value).rlike(r"^[A-Za-z0-9]+\z"), "inside").otherwise("gram")
    v = v.withColumn("_kind", kind).withColumn("_key", F.coalesce("_word", "_pair", F.left(F.col(value), F.lit(GRAM))))
    sides = F.concat_ws(",", F.length(F.regexp_extract("_key", "^[A-Za-z0-9]*", 0)).cast("string"), F.length(F.regexp_extract("_key", r"[A-Za-z0-9]*\z", 0)).cast("string"))
    shape = F.when(F.col("_kind") == "pair", sides).otherwise(F.length("_key").cast("string"))
    return v.withColumn("_shape", F.when(F.col("_kind") != "word", shape)).drop("_word", "_pair")


def _text_keys(text: str, kind: str, shapes: list[str]):
    """All keys of one kind a text can offer."""
    if kind in ("word", "inside"):
        return F.array_distinct(F.split(F.col(text), WORD_BREAK))
    if kind == "gram":
        return F.array_distinct(F.concat(*[_pieces(F.col(text), F.lit(n)) for n in shapes]))
    pats = ["(?s)(?=([A-Za-z0-9]{%s}[^A-Za-z0-9]+[A-Za-z0-9]{%s}))" % tuple(s.split(",")) for s in shapes]
    return F.array_distinct(F.concat(*[F.regexp_extract_all(F.col(text), F.lit(p), F.lit(1)) for p in pats]))


def _candidates(docs: DataFrame, keep: list[str], text: str, side: DataFrame, kind: str, shapes: list[str]):
    """Docs with every dictionary key they offer, ``keep`` columns and ``_key`` only."""
    keyed = docs.select(*keep, F.explode(_text_keys(text, kind, shapes)).alias("_key"))
    if kind != "inside":
        return keyed
    words = keyed.withColumnRenamed("_key", "_w")
    sizes = F.array(*[F.lit(int(n)) for n in shapes])
    known = words.select("_w").distinct().withColumn("_key", F.explode(_substrings("_w", sizes))).join(side.select("_key").distinct(), "_key")
    return words.join(known, "_w").drop("_w")


_automata: dict[int, tuple] = {}


def _automaton(held, scoped: bool) -> tuple:
    """The worker's automaton of a broadcast dictionary, with the scopes of each value; the last one is kept."""
    key = id(held.value)
    if key not in _automata:
        _automata.clear()
        scopes: dict[str, set] = {}
        for *scope, value in held.value:
            scopes.setdefault(value, set()).add(tuple(scope))
        a = ahocorasick.Automaton()
        for value, own in scopes.items():
            a.add_word(value, (value, own if scoped else None))
        a.make_automaton()
        _automata[key] = (a, held.value)  # the value is held, so its id stays its own
    return _automata[key][0]


def _scan_dictionary(docs: DataFrame, doc_id: str, text: str, given: DataFrame, value: str, on: list[str], keep: list[str], scoped: bool) -> DataFrame:
    """``(on…, doc_id, keep…, _value)`` from one pass over the texts, whose cost does not grow with the dictionary; where
    not ``scoped``, values of other scopes are found as well."""
    rows = [tuple(r) for r in given.select(*(on if scoped else []), value).distinct().collect()]
    held = docs.sparkSession.sparkContext.broadcast(rows)
    cols = [*on, doc_id, *keep]
    fields = [docs.schema[c] for c in cols]

    def run(batches):
        automaton = _automaton(held, scoped) if held.value else None
        for batch in batches:
            scopes = list(zip(*[batch.column(i).to_pylist() for i in range(len(on))])) if scoped else None
            at, found = [], []
            for i, t in enumerate(batch.column(len(cols)).to_pylist() if automaton else []):
                if t:
                    for v in {v for _, (v, own) in automaton.iter(t) if own is None or scopes[i] in own}:
                        at.append(i)
                        found.append(v)
            where = pa.array(at, type=pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(where) for i in range(len(cols))), pa.array(found, type=pa.string())], names=[*cols, "_value"])

    return docs.select(*cols, F.col(text).alias("_text")).mapInArrow(run, T.StructType([*fields, T.StructField("_value", T.StringType())]))


def text_contains(docs: DataFrame, doc_id: str, text: str, values: DataFrame, value_id: str, value: str,
                  on: list[str] | None = None, keep: list[str] | None = None, dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """``(on…, doc_id, keep…, value_id)`` where the whole text contains the whole value; ``keep`` are columns of the docs.

    An empty dictionary reads no text. One of at most ``dictionary_bytes`` (measured, not guessed) is broadcast, and one pass of an Aho-Corasick
    automaton over each text finds all its values at once; a value counts only in its own scope ``on``, and no text is
    shuffled. Where only the scopes make it larger, its distinct values are broadcast and a join on what was found
    checks the scopes. A dictionary of more values is joined on keys: a word that is not at either end of the value must appear as a
    whole word in any text that contains it, so the longest such word is the key. A value of two words is keyed by the
    characters around its gap. An unbroken word must lie inside one word of the text, so such words are matched against
    the distinct words of all texts. Anything else is keyed by its first eight characters. Candidates are checked on
    the whole text.
    """
    on, keep = on or [], keep or []
    given = values.filter(f"{value} is not null and {value} <> ''").select(*on, value_id, value)

    def size(rows):
        return rows.agg(F.coalesce(F.sum(F.octet_length(value).cast("long") + ROW_BYTES), F.lit(0)).alias("n")).first()["n"]

    total = size(given)
    if not total:  # no value, no match: the texts need not be read
        return docs.sparkSession.createDataFrame([], T.StructType([*(docs.schema[c] for c in [*on, doc_id, *keep]), values.schema[value_id]]))
    scoped = bool(on) and total <= dictionary_bytes
    if scoped or size(given.select(value).distinct()) <= dictionary_bytes:
        found = _scan_dictionary(docs, doc_id, text, given, value, on, keep, scoped)
        return found.join(given.withColumnRenamed(value, "_value"), [*on, "_value"]).select(*on, doc_id, *keep, value_id)
    v = _anchored(given, value)
    # how many keys there are of each kind and which shapes they have: a handful of rows whatever the dictionary
    facts = v.groupBy("_kind").agg(F.collect_set("_shape").alias("shapes")).collect()
    found = []
    for f in facts:
        kind = f["_kind"]
        side = v.filter(F.col("_kind") == kind).select(*on, F.col(value_id), "_key")
        keyed = _candidates(docs, [*on, doc_id], text, side, kind, sorted(f["shapes"]))
        found.append(keyed.join(side, [*on, "_key"]).select(*on, doc_id, value_id))
    cand = found[0]
    for more in found[1:]:
        cand = cand.unionByName(more)
    return (cand.distinct().join(values.select(*on, value_id, F.col(value).alias("_value")), [*on, value_id])
            .join(docs.select(*on, doc_id, *keep, F.col(text).alias("_text")), [*on, doc_id])
            .filter(F.contains("_text", "_value")).select(*on, doc_id, *keep, value_id))


def first_match(pairs: DataFrame, key: list[str], value_cols: list[str], order: list[str]) -> DataFrame:
    """Per key the values of the smallest ``order``."""
    best = F.min_by(F.struct(*value_cols), F.struct(*order))
    return pairs.groupBy(*key).agg(best.alias("_best")).select(*key, *[F.col(f"_best.{c}").alias(c) for c in value_cols])


def hamming_pairs(hashes: DataFrame, hash_col: str, max_distance: int, bits: int = 64, bands: int | None = None) -> DataFrame:
    """Pairs of distinct hashes at most ``max_distance`` bits apart, with the number of rows behind each.

    With ``max_distance + 2`` bands at least two agree, so every two bands form a key. Copies collapse to one row
    with a count first, and a pair is kept only under its first agreeing band pair, so no later distinct is needed.
    """
    bands = bands or max_distance + 2
    edges = [round(i * bits / bands) for i in range(bands + 1)]
    d = hashes.groupBy(F.col(hash_col).cast("long").alias("h")).agg(F.count("*").alias("n"))

    def band(c, i):
        mask = (1 << (edges[i + 1] - edges[i])) - 1
        return F.shiftrightunsigned(c, edges[i]).bitwiseAND(F.lit(mask).cast("long"))

    keys = list(combinations(range(bands), bands - max_distance))
    keyed = d.select("h", "n", F.posexplode(F.array(*[
        F.concat_ws("-", *[band(F.col("h"), i).cast("string") for i in combo]) for combo in keys])).alias("combo", "key"))
    a = keyed.select(F.col("h").alias("hash_a"), F.col("n").alias("n_a"), "combo", "key")
    b = keyed.select(F.col("h").alias("hash_b"), F.col("n").alias("n_b"), "combo", "key")
    x = F.col("hash_a").bitwiseXOR(F.col("hash_b"))
    agree = [band(x, i) == 0 for i in range(bands)]
    first = F.coalesce(*[F.when(_all([agree[i] for i in combo]), F.lit(j)) for j, combo in enumerate(keys)])
    return (a.join(b, ["combo", "key"]).filter("hash_a < hash_b")
            .withColumn("distance", F.bit_count(x)).filter(F.col("distance") <= max_distance)
            .filter(F.col("combo") == first).select("hash_a", "n_a", "hash_b", "n_b", "distance"))


def _all(conds):
    out = conds[0]
    for c in conds[1:]:
        out = out & c
    return out


# --- vector search --------------------------------------------------------------------------------

#: Vectors in a block at most, and blocks a side is cut into before they grow: a vector is shuffled once per block of the
#: other side, so up to BLOCKS * BLOCK_ROWS vectors what is shuffled grows no faster than the input.
BLOCK_ROWS, BLOCKS = 1 << 19, 8


def block_count(n: int, rows: int) -> int:
    """Blocks of about ``rows`` vectors, then BLOCKS of them, then as many as BLOCK_ROWS asks for."""
    return max(1, min(-(-n // rows), BLOCKS), -(-n // BLOCK_ROWS))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype("float64")
    size = np.linalg.norm(v, axis=1, keepdims=True)
    return v / np.where(size == 0, 1.0, size)  # a zero vector is similar to nothing: its similarity is 0


def _tile_top_k(qid, qv, bid, bv, k: int, decimals: int, same_id_excluded: bool) -> pd.DataFrame:
    sims = np.round(qv @ bv.T, decimals)
    if same_id_excluded:
        sims[qid[:, None] == bid[None, :]] = -np.inf
    kk = min(k, sims.shape[1])
    floor = np.partition(sims, sims.shape[1] - kk, axis=1)[:, sims.shape[1] - kk]
    rows, cols = np.nonzero((sims >= floor[:, None]) & np.isfinite(sims))
    return _first_k(pd.DataFrame({"query_id": qid[rows], "match_id": bid[cols], "sim": sims[rows, cols]}), k)


def _first_k(out: pd.DataFrame, k: int) -> pd.DataFrame:
    out = out.sort_values(["query_id", "sim", "match_id"], ascending=[True, False, True])
    return out.groupby("query_id", sort=False).head(k)


def _block_top_k(k: int, decimals: int, same_id_excluded: bool, tile: int):
    """Top k of a pair of blocks; a tile of ``tile`` by ``tile`` similarities is held at a time."""
    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "match_id": pd.Series(dtype="int64"),
                              "sim": pd.Series(dtype="float64")})
        if q.empty or b.empty:
            return empty
        qv, bv = np.vstack(q["vec"].to_numpy()), np.vstack(b["vec"].to_numpy())
        qid, bid = q["query_id"].to_numpy(), b["match_id"].to_numpy()
        found = []
        for i in range(0, len(qid), tile):
            rows = slice(i, i + tile)
            own = _unit(qv[rows])
            parts = [_tile_top_k(qid[rows], own, bid[j: j + tile], _unit(bv[j: j + tile]), k, decimals, same_id_excluded) for j in range(0, len(bid), tile)]
            found.append(parts[0] if len(parts) == 1 else _first_k(pd.concat(parts), k))
        return pd.concat(found)
    return run


#: Vectors of a block below which a table is cut into fewer than BLOCKS; small tables are cut like large ones, so that what
#: is shuffled is in proportion to the input from the start.
CUT_ROWS = 64


def nearest(queries: DataFrame, base: DataFrame, k: int, decimals: int = 6, block_rows: int = 2048,
            same_id_excluded: bool = False, kind: str | None = None) -> DataFrame:
    """Exact top-k cosine matches of every query: ``(query_id, match_id, sim, rank)``.

    Inputs are ``(query_id, vec)`` and ``(match_id, vec)``. Both sides are cut into equal blocks by id hash, BLOCKS of them
    or more (``block_count``); each pair of blocks returns k rows per query, from matrix products of ``block_rows`` vectors
    a side, and the partial lists are merged. Memory per task is fixed by BLOCK_ROWS and no side is broadcast. Missing
    vectors match nothing; zero vectors have similarity 0. With ``kind``, a boolean column of ``base`` that comes along,
    matches are ranked for each of its values on their own.
    """
    queries, base = queries.filter("vec is not null"), base.filter("vec is not null")
    kinds = [kind] if kind else []
    cut = min(block_rows, CUT_ROWS)
    nq, nb = block_count(queries.count(), cut), block_count(base.count(), cut)
    q = queries.select("query_id", "vec", F.pmod(F.xxhash64("query_id"), F.lit(nq)).alias("qb"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nb - 1).cast("long"))).alias("bb"))
    b = base.select("match_id", "vec", *kinds, F.pmod(F.xxhash64("match_id"), F.lit(nb)).alias("bb"),
                    F.explode(F.sequence(F.lit(0).cast("long"), F.lit(nq - 1).cast("long"))).alias("qb"))
    run = _block_top_k(k, decimals, same_id_excluded, block_rows)
    part = (q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb"))
            .applyInPandas(_each_kind(run, kind) if kind else run, "query_id long, match_id long, sim double" + ", {} boolean".format(kind) * len(kinds)))
    w = W.partitionBy("query_id", *kinds).orderBy(F.desc("sim"), "match_id")
    return part.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _each_kind(run, kind: str):
    def each(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([run(q, b[b[kind] == value]).assign(**{kind: value}) for value in (True, False)])
    return each
