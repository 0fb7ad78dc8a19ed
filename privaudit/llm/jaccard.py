"""Near duplicates by SimHash and by the Jaccard similarity of word shingles: every pair that either of them links is found.

SimHash links texts whose fingerprints (``simhash``: shingles with their repeats) differ in at most BITS bits, by its trie
walk over all distinct fingerprints. At similarity 0.8 two fingerprints differ in about 10 of 64 bits, so SimHash alone would
lose pairs; the sets of shingles alone would lose texts that are made of one repeated passage but for a few words. Groups are
the components of both kinds of links. Jaccard finds its links as follows.

Two sets of similarity t share one of their first n - ceil(t n) + 1 shingles in any fixed order of all shingles (prefix
filter), whatever n each has. The order takes rare shingles first: all texts are counted into a sketch of fixed size (one
counter per hash value), and shingles are ordered by their counter. So passages that many texts share come last and make
hardly any candidates; collisions in the sketch change the work and not the result.

1. Texts of one set of shingles are one node. Nodes that share a shingle in their prefixes, and whose sizes and positions
   there allow the similarity, are candidates; a shingle of more than CROWD nodes links them all to its first instead,
   n - 1 edges. Chance alone makes candidates too, and in a large table enough of them to link most texts to each other. So
   a pair that shares fewer than SHARED shingles of the prefixes stays only if signatures allow the similarity: counts of
   the shingles by ranges of their hash, whose smaller values add up to no less than what two sets share. The components of
   the edges that are left hold every similar pair.
2. The texts of a component come together in blocks of a few megabytes; every pair of blocks of one component is a task.
   One text per node is shuffled for that, found by a bitmap of ids and texts. A task verifies pairs on the sets themselves: the
   most central set first, each set against all sets that share its prefix and are not connected to it yet, by SimHash or by
   pairs found before; so the bulk of a crowd of near copies is connected before any of its pairs are enumerated. It returns
   a forest of similar pairs.

Shingles and sets are 64-bit digests. A text of fewer words is one shingle; null texts and texts without words are one set.
An empty table gives an empty result; a very long text is a block of its own; columns of any name are carried along.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from privaudit.llm import simhash
from privaudit.llm.bpe import pieces
from privaudit.llm.tables import components, digest_of, give_back, keyed, maybe_in, released, text_key, written

WORDS, SIMILARITY = 5, 0.8
#: Bytes of text in a block, and of texts shingled at once.
BLOCK_BYTES, PIECE_BYTES = 4 << 20, 1 << 20
#: Counters of the sketch, and counters per row of its parts.
COUNTERS, PART = 1 << 20, 1 << 14
#: Rows of one shingle up to which its pairs are looked at one by one.
CROWD = 64
#: Shared shingles of the prefixes from which a pair is a candidate without a look at the signatures; least counters of a
#: signature, and shingles per counter.
SHARED, LEAST, LOAD = 8, 32, 6
#: Bits in which two fingerprints that SimHash links may differ.
BITS = 3

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def _pieces(texts: list):
    """Consecutive runs of texts of about PIECE_BYTES."""
    k = 0
    while k < len(texts):
        n, total = k, 0
        while n < len(texts) and (n == k or total + len(texts[n]) <= PIECE_BYTES):
            total += len(texts[n])
            n += 1
        yield texts[k:n]
        k = n


def shingle_sets(texts: list, words: int = WORDS, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct digests of the runs of ``words`` lower-case words of each text, end to end, and where each text's begin.

    Lower case and white space are those of ASCII. A word is hashed once per call; runs are mixed from the words' hashes.
    """
    flat, sizes = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for part in _pieces([(t or "").encode("utf-8", "surrogatepass") for t in texts]):
        data = LOWER[np.frombuffer(b" ".join(part) + b" ", dtype=np.uint8)]
        edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in part])))
        inside = ~SPACES[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        starts = np.flatnonzero(begins)
        letters = data[inside]
        cuts = np.append(np.cumsum(inside)[starts] - 1, len(letters)).astype(np.int64)
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(letters)]).dictionary_encode()
        hashes = np.array([xxhash.xxh64_intdigest(w, seed) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
        w = hashes[coded.indices.to_numpy()] if len(starts) else np.empty(0, dtype=np.uint64)
        first = np.searchsorted(starts, edges)
        count = np.diff(first)  # words of each text
        runs = np.where(count > 0, np.maximum(1, count - words + 1), 0)
        doc = np.repeat(np.arange(len(part)), runs)
        at = np.arange(len(doc)) - np.repeat(np.cumsum(runs) - runs, runs) + first[doc]
        length = np.minimum(count, words)[doc]
        h = length.astype(np.uint64)
        with np.errstate(over="ignore"):
            for i in range(words):
                live = i < length
                g = (h ^ w[np.minimum(at + i, max(len(w) - 1, 0))]) * np.uint64(0x9E3779B97F4A7C15) if len(w) else h
                g ^= g >> np.uint64(29)
                g *= np.uint64(0xD6E8FEB86659FD93)
                g ^= g >> np.uint64(32)
                h = np.where(live, g, h)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        flat.append(h[new])
        sizes.append(np.bincount(doc[new], minlength=len(part)))
    return np.concatenate(flat), np.concatenate(([0], np.cumsum(np.concatenate(sizes)))).astype(np.int64)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    return shingle_sets([text], words)[0]


def prefix_sizes(n: np.ndarray, similarity: float) -> np.ndarray:
    """How many shingles of a set of n must share one with any similar set."""
    return np.where(n > 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1, 0)


def in_order(flat: np.ndarray, offsets: np.ndarray, count: np.ndarray | None) -> np.ndarray:
    """The sets with their shingles in the global order: by counter, then by digest."""
    if count is None or not len(flat):
        return flat
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return flat[np.lexsort((flat, count[(flat % np.uint64(len(count))).astype(np.int64)], doc))]


def prefixes(flat: np.ndarray, offsets: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Arrays (shingle, set, position) of the prefixes of sets whose shingles are in order."""
    size = prefix_sizes(np.diff(offsets), similarity)
    doc = np.repeat(np.arange(len(size)), size)
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    return flat[offsets[doc] + pos], doc, pos


def nodes_of(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    view = memoryview(flat.view(np.uint8)) if len(flat) else memoryview(b"")
    return np.array([xxhash.xxh3_64_intdigest(view[8 * a: 8 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], dtype=np.uint64).view(np.int64)


def signatures(flat: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Per set its shingles counted by ranges of their hash, a byte each: a power of two of ranges, about LOAD shingles in one.

    Null where a count does not fit a byte.
    """
    size = np.diff(offsets)
    bits = np.ceil(np.log2(np.maximum(LEAST, size / LOAD))).astype(np.int64)
    start = np.concatenate(([0], np.cumsum(1 << bits)))
    doc = np.repeat(np.arange(len(size)), size)
    count = np.bincount(start[doc] + (flat >> (64 - bits[doc]).astype(np.uint64)).astype(np.int64), minlength=start[-1])
    fits = np.maximum.reduceat(count, start[:-1]) < 256 if len(size) else np.zeros(0, dtype=bool)
    held = np.minimum(count, 255).astype(np.uint8).tobytes()
    return pa.array([held[a:b] if ok else None for a, b, ok in zip(start[:-1].tolist(), start[1:].tolist(), fits.tolist())], type=pa.binary())


def may_be_similar(a: pa.Array, b: pa.Array, similarity: float) -> np.ndarray:
    """Whether the signatures allow sets that are similar; true wherever one is missing."""
    sizes = [pc.fill_null(pc.binary_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
    ok = (sizes[0] == 0) | (sizes[1] == 0)
    for m, n in set(zip(sizes[0][~ok].tolist(), sizes[1][~ok].tolist())):
        at = np.flatnonzero((sizes[0] == m) & (sizes[1] == n))
        least = min(m, n)  # a range of the coarser signature is several of the finer one
        x, y = (np.frombuffer(b"".join(side.take(pa.array(at)).to_pylist()), dtype=np.uint8).reshape(len(at), least, -1).sum(axis=2, dtype=np.int64) for side in (a, b))
        both = np.minimum(x, y).sum(axis=1)
        ok[at] = both >= similarity * (x.sum(axis=1) + y.sum(axis=1) - both) - 1e-9
    return ok


def sketch(docs: DataFrame, words: int) -> np.ndarray:
    """In how many texts each hash value of shingles is found, over the whole table; COUNTERS numbers."""
    def run(batches):
        count = np.zeros(COUNTERS, dtype=np.int64)
        for b in pieces(batches, 4):
            flat, _ = shingle_sets(b.column(0).to_pylist(), words)
            count += np.bincount((flat % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(COUNTERS // PART), type=pa.int32()),
                                          "count": pa.array([np.minimum(c, 0xFFFFFFFF).astype(np.uint32).tobytes() for c in np.split(count, COUNTERS // PART)], type=pa.binary())})

    def added(rows):
        total = sum(np.frombuffer(x, dtype=np.uint32).astype(np.int64) for x in rows.column("count").to_pylist())
        return pa.table({"part": rows.column("part").slice(0, 1), "count": pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], type=pa.binary())})

    parts = docs.select("text").mapInArrow(released(run), "part int, count binary").groupBy("part").applyInArrow(added, "part int, count binary").collect()  # COUNTERS numbers
    return np.concatenate([np.frombuffer(bytes(r["count"]), dtype=np.uint32) for r in sorted(parts, key=lambda r: r["part"])]) if parts else np.zeros(COUNTERS, dtype=np.uint32)


def similar_pairs(flat: np.ndarray, offsets: np.ndarray, side: np.ndarray, similarity: float, near: np.ndarray | None = None):
    """Spanning forest (i, j) of the pairs of similar sets; where ``side`` has two values, of pairs between the two.

    Sets are compared in full: shared shingles are counted for one set against many at once. Sets of one number in ``near``
    are connected already: together with those links the forest connects what all similar pairs connect.
    """
    n, size = len(offsets) - 1, np.diff(offsets)
    if n < 2:
        return
    _, local = np.unique(flat, return_inverse=True)
    local = local.reshape(-1)
    often = np.bincount(local)
    root = np.arange(n) if near is None else np.unique(near, return_inverse=True)[1].reshape(-1)
    here = np.zeros(len(often), dtype=bool)
    two = len(np.unique(side)) > 1

    def verified(i: int, others: np.ndarray) -> np.ndarray:
        own = local[offsets[i]: offsets[i + 1]]
        here[own] = True
        length = size[others]
        place = np.repeat(offsets[others] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        both = np.add.reduceat(here[local[place]], np.cumsum(length) - length, dtype=np.int64) if len(place) else np.zeros(len(others), dtype=np.int64)
        here[own] = False
        return others[both >= similarity * (size[i] + length - both) - 1e-9]

    def join(i: int, others: np.ndarray):
        for j in others.tolist():
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                yield i, j

    def usable(i: int, others: np.ndarray) -> np.ndarray:
        ok = (root[others] != root[i]) & (np.minimum(size[others], size[i]) >= similarity * np.maximum(size[others], size[i]) - 1e-9)
        return others[ok & (side[others] != side[i])] if two else others[ok]

    # every set against all that share its prefix and are not connected to it, sets with the most common shingles first
    h, doc, _ = prefixes(local, offsets, similarity)
    order = np.argsort(h, kind="stable")
    h, doc = h[order], doc[order]
    _, begin = np.unique(h, return_index=True)
    end = np.append(begin[1:], len(h))
    run_of = np.searchsorted(h[begin], h) if len(h) else h
    mine = np.argsort(doc, kind="stable")
    first = np.searchsorted(doc[mine], np.arange(n + 1))
    shared = end - begin > 1
    central = np.add.reduceat(often[local], offsets[:-1][size > 0]) / size[size > 0] if len(flat) else np.zeros(0)
    for i in np.flatnonzero(size > 0)[np.argsort(-central, kind="stable")].tolist():
        runs = run_of[mine[first[i]: first[i + 1]]]
        runs = runs[shared[runs]]
        if len(runs):
            length = end[runs] - begin[runs]
            place = np.repeat(begin[runs] - (np.cumsum(length) - length), length) + np.arange(length.sum())
            others = usable(i, doc[place])
            if len(others):
                yield from join(i, verified(i, np.unique(others)))


def candidate_pairs(similarity: float, crowd: int = CROWD):
    """Arrow batches of (h, node, n, pos), sorted by h, to edges (u, v, star); a node counts once per shingle."""
    def edges(h, node, n, pos):
        for k in range(1, crowd):
            i = np.flatnonzero(h[k:] == h[:-k])
            if not len(i):
                return
            j = i + k
            bound = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= similarity / (1 + similarity) * (n[i] + n[j]) - 1e-9
            ok = bound & (np.minimum(n[i], n[j]) >= similarity * np.maximum(n[i], n[j]) - 1e-9) & (node[i] != node[j])
            yield node[i[ok]], node[j[ok]]

    def run(batches):
        held, star = None, None  # rows of the last shingle so far; its first node once it is crowded
        for b in batches:
            rows = [b.column(c).to_numpy() for c in range(4)]
            if not b.num_rows:
                continue
            rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows)]
            order = np.lexsort((rows[1], rows[0]))
            rows = [x[order] for x in rows]
            new = np.ones(len(order), dtype=bool)
            new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
            rows = [x[new] for x in rows]
            h = rows[0]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            size = np.diff(np.append(starts, len(h)))
            full = size > crowd
            full[0] |= star is not None
            first = np.repeat(rows[1][starts], size)
            crowded = np.repeat(full, size)
            done = np.arange(len(h)) < starts[-1]
            found = [(rows[1][crowded], first[crowded]), *edges(*(x[~crowded & done] for x in rows))]
            star_of = np.arange(sum(len(x) for x, _ in found)) < crowded.sum()
            if full[-1]:
                star, held = True, [x[starts[-1]: starts[-1] + 1] for x in rows]
            else:
                star, held = None, [x[starts[-1]:] for x in rows]
            u, v = (np.concatenate(x) for x in zip(*found))
            yield pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v]), pa.array(star_of[u != v])], names=["u", "v", "star"])
        if held is not None and star is None:
            for u, v in edges(*held):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.zeros(len(u), dtype=bool))], names=["u", "v", "star"])

    return run


def pick(key, doc_id) -> Column:
    """A row by its text's digest and its id."""
    return F.concat_ws("|", key, F.col(doc_id).cast("string"))


def groups(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, key (digest of the text) and group, the same for documents that near fingerprints or similar sets connect."""
    docs = keyed(docs, id_col, text_col)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(sketch(docs, words))  # COUNTERS numbers

    def mark(batches):
        for b in pieces(batches, 4):
            texts = b.column(1).to_pylist()
            sets = shingle_sets(texts, words)
            fp = np.array([simhash.fingerprint(t, words) for t in texts], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([digest_of(t) for t in texts], type=pa.string()), pa.array(nodes_of(*sets)), pa.array(fp), pc.cast(pc.fill_null(pc.binary_length(b.column(1)), 0), pa.int64()),
                                              signatures(*sets)], names=["doc_id", "key", "node", "fp", "size", "sig"])

    def heads(batches):
        seen: set[int] = set()
        for b in pieces(batches, 4):
            flat, offsets = shingle_sets(b.column(0).to_pylist(), words)
            node = nodes_of(flat, offsets)
            fresh = np.zeros(len(node), dtype=bool)  # a set counts once per task
            for i, x in enumerate(node.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            h, doc, pos = prefixes(in_order(flat, offsets, held.value), offsets, similarity)
            pick = fresh[doc]
            h, doc, pos = h[pick], doc[pick], pos[pick]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(node[doc]), pa.array(np.diff(offsets)[doc].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["h", "node", "n", "pos"])

    def compare(rows):
        flat, offsets = shingle_sets(rows.column("text").to_pylist(), words)
        node = rows.column("node").to_pylist()
        pairs = list(similar_pairs(flat, offsets, rows.column("side").to_numpy(), similarity, rows.column("near").to_numpy()))
        del flat, offsets
        give_back()
        return pa.table({"u": pa.array([node[i] for i, _ in pairs], type=pa.int64()), "v": pa.array([node[j] for _, j in pairs], type=pa.int64())})

    def allowed(batches):
        for b in batches:
            yield b.select(["u", "v"]).filter(pa.array(may_be_similar(b.column(2), b.column(3), similarity)))

    marks = written(docs.mapInArrow(released(mark), "doc_id long, key string, node long, fp long, size long, sig binary"), "jaccard-marks")
    # SimHash: every node with the component of its fingerprint; a node whose texts differ in repeats may have several
    near = components(simhash.links(written(marks.select("fp").distinct(), "simhash-distinct"), BITS)).select(F.col("node").alias("fp"), "root")
    one_text = F.min(F.struct("key", "doc_id", "size")).alias("t")  # of each node
    nodes = written(marks.groupBy("node", "fp").agg(one_text).join(near, "fp", "left").select("node", "t.*", F.coalesce("root", "fp").alias("near")), "simhash-nodes")
    shared = nodes.groupBy("near").agg(F.min("node").alias("v"), F.max("node").alias("last")).where("v <> last").select("near", "v")
    alike = nodes.join(shared, "near").select(F.col("node").alias("u"), "v")
    first = docs.select("text").mapInArrow(released(heads), "h long, node long, n int, pos int").repartition("h").sortWithinPartitions("h")
    pairs = written(first.mapInArrow(released(candidate_pairs(similarity)), "u long, v long, star boolean").groupBy(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                    .agg(F.count("*").alias("n"), F.max("star").alias("star")), "jaccard-pairs")
    sure = F.col("star") | (F.col("n") >= SHARED)
    weak = pairs.where(~sure).select("u", "v")
    asked = weak.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    sigs = marks.select("node", "sig").join(asked, "node", "left_semi").dropDuplicates(["node"])
    told = weak.join(sigs.select(F.col("node").alias("u"), F.col("sig").alias("a")), "u").join(sigs.select(F.col("node").alias("v"), F.col("sig").alias("b")), "v").select("u", "v", "a", "b")
    edges = components(pairs.where(sure).select("u", "v").unionAll(told.mapInArrow(released(allowed), "u long, v long")))
    candidates = edges.unionAll(edges.select(F.col("root").alias("node"), "root").distinct())  # a root has no row of its own
    # one text of each node that has a candidate, in blocks; a component of several blocks is compared block by block
    picked = nodes.groupBy("node").agg(one_text, F.min("near").alias("near")).select("node", pick("t.key", "t.doc_id").alias("pick"), "t.size", "near")
    picked = written(picked.join(candidates, "node"), "jaccard-picked")
    total = picked.groupBy("root").agg(F.ceil(F.sum("size") / BLOCK_BYTES).cast("int").alias("blocks"))
    tasks = max(1, -(-picked.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // BLOCK_BYTES))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sides = picked.join(total, "root").select("pick", "node", "root", "near", "blocks", own.alias("own"))
    held_texts = docs.select("text", pick(text_key("text"), "doc_id").alias("pick"))
    texts = held_texts.where(maybe_in(picked.select(F.xxhash64("pick").alias("h")), "h", F.xxhash64("pick"))).join(sides, "pick").dropDuplicates(["pick"])
    dealt = (texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest("blocks", F.lit(1)) - 1)))
             .select("node", "near", "text", F.coalesce("own", F.lit(0)).alias("side"), F.when(F.col("blocks") > 1, F.col("root")).alias("hot"),
                     F.when(F.col("blocks") > 1, F.least("own", "other")).otherwise(F.pmod(F.xxhash64("root"), F.lit(tasks))).cast("long").alias("x"),
                     F.when(F.col("blocks") > 1, F.greatest("own", "other")).cast("long").alias("y")))
    linked = components(dealt.groupBy("hot", "x", "y").applyInArrow(compare, "u long, v long").unionAll(alike))
    return marks.join(linked, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("group"))


def keep_one(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, one with the smallest id; all columns stay.

    Ids need not be unique: a row is known by its id and text, and of rows that share both one stays. A row without an id
    stays only if its whole group has none. Only rows whose verdict two bitmaps leave open are shuffled with their texts.
    """
    found = written(groups(docs, words, similarity, id_col, text_col), "jaccard-groups")
    best = found.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("k"))
    rows = found.groupBy("doc_id", "key", "group").agg(F.count("*").alias("n")).join(best, "group")
    stays = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("key") == F.col("k.key"))
    told = written(rows.select(F.col("doc_id").alias("id"), "key", stays.alias("stays"), (F.col("n") > 1).alias("many")), "jaccard-verdicts")
    named = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("own_id"), text_key(text_col).alias("own_key"))

    def maybe(verdicts):
        return maybe_in(verdicts.select(F.xxhash64("id", "key").alias("h")), "h", F.xxhash64("own_id", "own_key"))

    # every row goes, stays or is one of several alike; only what two bitmaps leave open is shuffled with its text
    touched = told.where(~F.col("stays") | F.col("many"))
    goes, kept = maybe(touched), maybe(told.where("stays"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key"))
    open_ = named.where(goes & kept).join(touched, same, "left")
    alone = open_.where("stays is null").select("row")
    one = open_.where("stays").dropDuplicates(["own_id", "own_key"]).select("row")
    return named.where(~goes).select("row").unionAll(alone).unionAll(one).select("row.*")
