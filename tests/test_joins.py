"""Join helpers against brute force on random data."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from privaudit.operators import joins
from privaudit.operators.scans import window_ranks


def words(rng, n, alphabet="abcde"):
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 9))) for _ in range(n)]


def test_text_contains_scans_once_for_values_of_many_scopes(spark):
    docs = spark.createDataFrame([(i, i % 40, f"x value number {i % 7} y") for i in range(80)], "doc int, pkg int, text string")
    vals = spark.createDataFrame([(v, p, f"value number {v}") for v in range(5) for p in range(40) if (v + p) % 3], "vid int, pkg int, val string")
    got = joins.text_contains(docs, "doc", "text", vals, "vid", "val", ["pkg"], dictionary_bytes=1000)
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in got.collect()} == {(i % 40, i, i % 7) for i in range(80) if i % 7 < 5 and (i % 7 + i % 40) % 3}


def test_text_contains_equals_plain_contains(spark):
    rng = random.Random(1)
    sep = [" ", ", ", "-", "\n", "é", "隐"]
    docs = [(i, i % 3, "".join(w + rng.choice(sep) for w in words(rng, 40))) for i in range(60)]
    vals = []
    for j in range(120):
        d = rng.choice(docs)
        a = rng.randint(0, len(d[2]) - 2)
        b = min(len(d[2]), a + rng.randint(1, 25))
        vals.append((j, rng.randint(0, 2), d[2][a:b] if j % 4 else "".join(words(rng, 2))))
    df, vf = spark.createDataFrame(docs, "doc int, pkg int, text string"), spark.createDataFrame(vals, "vid int, pkg int, val string")
    want = {(d, v) for d, _, t in docs for v, _, x in vals if x and x in t}
    keyed = {(p, d, v) for d, p, t in docs for v, q, x in vals if x and p == q and x in t}
    for limit in (0, joins.DICTIONARY_BYTES):
        got = joins.text_contains(df.drop("pkg"), "doc", "text", vf.drop("pkg"), "vid", "val", dictionary_bytes=limit)
        assert {(r.doc, r.vid) for r in got.collect()} == want
        assert {tuple(r) for r in joins.text_contains(df, "doc", "text", vf, "vid", "val", ["pkg"], dictionary_bytes=limit).collect()} == keyed
        kept = joins.text_contains(df, "doc", "text", vf, "vid", "val", ["pkg"], keep=["text"], dictionary_bytes=limit).collect()
        assert {(r.pkg, r.doc, r.vid) for r in kept} == keyed and all(r.text == docs[r.doc][2] for r in kept)
        assert joins.text_contains(df.limit(0), "doc", "text", vf, "vid", "val", ["pkg"], dictionary_bytes=limit).collect() == []
    assert joins.text_contains(df, "doc", "text", vf.limit(0), "vid", "val").collect() == []


def test_text_is_not_shuffled_for_a_broadcast_dictionary(spark):
    df, vf = spark.createDataFrame([(1, "some text")], "doc int, text string"), spark.createDataFrame([(1, "text")], "vid int, val string")
    plan = joins.text_contains(df.repartition(3), "doc", "text", vf, "vid", "val")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RoundRobinPartitioning") == 1 and "hashpartitioning(doc" not in plan  # only the test's own


def test_nearest_with_zero_and_missing_vectors(spark):
    base = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [-1.0, 0.0])], "match_id long, vec array<double>")
    q = spark.createDataFrame([(10, [2.0, 0.0]), (11, [0.0, 0.0]), (12, None)], "query_id long, vec array<double>")
    for k in (1, 2, 3):
        got = {}
        for r in joins.nearest(q, base, k).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.match_id
        assert got[10] == dict(enumerate([1, 2, 3][:k], 1)) and got[11] == dict(enumerate([1, 2, 3][:k], 1)) and set(got) == {10, 11}


def test_substring_pairs_both_ways(spark):
    rng = random.Random(2)
    a, b = set(words(rng, 80, "ab隐私")), set(words(rng, 60, "ab隐私"))
    t, d = spark.createDataFrame([(x,) for x in a], "t string"), spark.createDataFrame([(x,) for x in b], "d string")
    assert {tuple(r) for r in joins.substring_pairs(t, "t", d, "d").collect()} == {(x, y) for x in a for y in b if y in x}
    both = {tuple(r) for r in joins.substring_pairs(t, "t", d, "d", both_ways=True).collect()}
    assert both == {(x, y) for x in a for y in b if y in x or x in y}


def test_prefix_pairs(spark):
    rng = random.Random(3)
    a, b = set(words(rng, 100, "ab.")), set(words(rng, 40, "ab."))
    got = joins.prefix_pairs(spark.createDataFrame([(x,) for x in a], "p string"), "p", spark.createDataFrame([(x,) for x in b], "q string"), "q")
    assert {tuple(r) for r in got.collect()} == {(x, y) for x in a for y in b if x.startswith(y)}


def test_prefix_pairs_without_prefixes(spark):
    empty = spark.createDataFrame([], "q string")
    assert joins.prefix_pairs(spark.createDataFrame([("a",)], "p string"), "p", empty, "q").count() == 0


def test_hamming_pairs_at_screen_distance(spark):
    rng = random.Random(4)
    base = [rng.getrandbits(63) for _ in range(40)]
    hs = base + [b ^ sum(1 << k for k in rng.sample(range(63), rng.randint(0, 8))) for b in base for _ in range(3)]
    got = {(r.hash_a, r.hash_b, r.distance) for r in joins.hamming_pairs(spark.createDataFrame([(h,) for h in hs], "h long"), "h", 6).collect()}
    u = sorted(set(hs))
    assert got == {(x, y, bin(x ^ y).count("1")) for i, x in enumerate(u) for y in u[i + 1:] if bin(x ^ y).count("1") <= 6}


def test_hamming_pairs_counts_copies_of_one_hot_hash(spark):
    got = joins.hamming_pairs(spark.range(3000).select((F.col("id") % 2).alias("h")), "h", 1, bits=8).collect()
    assert [(r.hash_a, r.n_a, r.hash_b, r.n_b) for r in got] == [(0, 1500, 1, 1500)]


def test_nearest_over_several_blocks(spark):
    rng = np.random.default_rng(5)
    q, b = rng.normal(size=(37, 6)), rng.normal(size=(53, 6))
    qf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "query_id long, vec array<double>")
    bf = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(b)], "match_id long, vec array<double>")
    sims = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (b / np.linalg.norm(b, axis=1, keepdims=True)).T, 6)
    want = {(i, int(j)) for i in range(37) for j in sorted(range(53), key=lambda j: (-sims[i, j], j))[:4]}
    for block in (8, 4096):
        got = joins.nearest(qf, bf, 4, block_rows=block).collect()
        assert {(r.query_id, r.match_id) for r in got} == want


def test_window_ranks_with_a_hot_key(spark):
    rng = random.Random(6)
    left = [(i, rng.choice("aaab"), rng.randint(0, 300)) for i in range(80)]
    right = [(i, rng.choice("aaab"), rng.randint(0, 300)) for i in range(120)]
    lf, rf = spark.createDataFrame(left, "lid long, k string, p long"), spark.createDataFrame(right, "rid long, k string, p long")
    for hot in (10, 10_000):
        ranges, ranked = window_ranks(lf, rf, ["k"], "lid", F.col("p"), F.col("p"), "rid", 5, 20, hot_rows=hot)
        assert {r.lid: r.hi - r.lo for r in ranges.collect()} == {i: sum(k == q and p - 5 <= x <= p + 20 for _, q, x in right) for i, k, p in left}
        order = {k: [i for i, _, _ in sorted((r for r in right if r[1] == k), key=lambda r: (r[2], r[0]))] for k in "ab"}
        assert {(r.k, r["rank"]): r["match"].rid for r in ranked.collect()} == {(k, n + 1): i for k, ids in order.items() for n, i in enumerate(ids)}


def test_blocks_of_vectors_grow_with_their_number():
    copies = [n * 2 * joins.block_count(n, 2048) / n for n in (100_000, 600_000, 4_000_000)]
    assert max(copies) == 2 * joins.BLOCKS  # each vector goes to as many blocks, however many there are
    assert [joins.block_count(n, 2048) for n in (0, 1, 2048, 2049)] == [1, 1, 1, 2]


def test_tiles_of_a_block_give_the_same_rows():
    rng = np.random.default_rng(3)
    vecs = rng.integers(-2, 3, (50, 4)).astype("float64")  # many ties and copies, some zero vectors
    q = pd.DataFrame({"query_id": np.arange(50), "vec": list(vecs)})
    b = pd.DataFrame({"match_id": np.arange(50), "vec": list(vecs)})
    whole, tiled = (joins._block_top_k(3, 6, True, n)(q, b).reset_index(drop=True) for n in (50, 7))
    assert len(whole) == 150
    pd.testing.assert_frame_equal(whole, tiled)


def shuffled_vectors(spark, n):
    """Rows that enter the pairs of blocks, by the plan's own operators up to the cogroup."""
    v = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.rand(1), F.rand(2)).alias("vec"))
    sent = []
    real = joins._block_top_k
    def counted(*a):
        run = real(*a)
        def one(q, b):
            out = run(q, b)
            return out.iloc[:0].reset_index(drop=True).reindex([0]).fillna({"query_id": len(q) + len(b), "match_id": 0, "sim": 0.0}).astype({"query_id": "int64", "match_id": "int64"})
        return one
    joins._block_top_k = counted
    try:
        for r in joins.nearest(v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "match_id"), 10**6).collect():
            sent.append(r.query_id)
    finally:
        joins._block_top_k = real
    return sum(sent)


def test_vectors_sent_to_blocks_grow_no_faster_than_the_table(spark):
    few, many = shuffled_vectors(spark, 600), shuffled_vectors(spark, 6000)
    assert few == 600 * 2 * joins.BLOCKS and many == 10 * few


def test_nearest_of_each_kind(spark):
    rng = np.random.default_rng(6)
    v, kinds = rng.normal(size=(90, 5)), rng.random(90) < 0.3
    qf = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "query_id long, vec array<double>")
    bf = spark.createDataFrame([(i, x.tolist(), bool(k)) for i, (x, k) in enumerate(zip(v, kinds))], "match_id long, vec array<double>, good boolean")
    got = joins.nearest(qf, bf, 3, same_id_excluded=True, kind="good")
    apart = [joins.nearest(qf, bf.filter(F.col("good") == k).drop("good"), 3, same_id_excluded=True).withColumn("good", F.lit(k)) for k in (True, False)]
    assert sorted(map(tuple, got.select("query_id", "match_id", "sim", "rank", "good").collect())) == sorted(
        tuple(r) for a in apart for r in a.select("query_id", "match_id", "sim", "rank", "good").collect())
