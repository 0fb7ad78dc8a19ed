"""SimHash near-duplicates: fingerprints of word shingles, joined to themselves by walking a binary trie in node pairs.

The trie of all distinct fingerprints is cut at a fixed depth. A pair of subtrees whose prefixes differ in at most
``max_bits`` bits is one task; inside it both subtrees are walked together from their roots, the differing bits are
added up and a node pair is dropped as soon as the error budget is exceeded. A task returns a spanning forest of the
links it finds, so a cluster of n near copies costs n - 1 rows and not n squared.

Null and empty texts have fingerprint zero and are linked like any other; a null id is carried along. Repeated rows
give repeated rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.llm.tables import components, digest_of, keyed, text_key, written

#: Fingerprints per subtree aimed at; more than this under one prefix are cut into chunks.
SUBTREE = 20_000
#: Shallowest and deepest cut of the trie: small tables make 136 tasks too, and at most 2**12 prefixes are counted on the
#: driver. With a least depth the copies per fingerprint (prefixes within the budget: 15 at depth 4) hardly grow with n.
MIN_DEPTH, MAX_DEPTH = 4, 12
#: Node pairs walked at once.
FRONTIER = 1 << 18


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingle hashes."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and bytes.split know ASCII only
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(joined, seed)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - words + 1].tolist()
    h = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[words - 1:].tolist())], dtype=">u8")
    return majority(h)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the 64-bit hashes."""
    ones, h = np.zeros(64, dtype=np.int64), h.astype(">u8")
    for i in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[i: i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """Rows (doc_id, fp): fp is the fingerprint as a signed long. ``with_key`` adds the digest of the text (key)."""
    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words, seed) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            keys = [pa.array([digest_of(t.as_py()) for t in b.column(1)], type=pa.string())] if with_key else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *keys], names=["doc_id", "fp", "key"][: 2 + with_key])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long" + ", key string" * with_key)


def trie_links(a: np.ndarray, b: np.ndarray | None, max_bits: int = 3):
    """Yield index arrays (i, j) of all pairs of ``a`` x ``b`` within ``max_bits``; ``b`` None: pairs i < j of ``a`` itself.

    Both arrays are sorted and distinct, so a trie node is a range. The walk starts at the pair of roots and goes down
    one bit at a time, depth first over pieces of at most ``FRONTIER`` pairs.
    """
    own = b is None
    b = a if own else b
    if not len(a) or not len(b):
        return
    one = np.array([0], dtype=np.int64)
    stack = [(63, one, one + len(a), one, one + len(b), np.zeros(1, dtype=np.int8))]
    while stack:
        bit, alo, ahi, blo, bhi, diff = stack.pop()
        single = (ahi - alo == 1) & (bhi - blo == 1)
        if bit < 0:
            single[:] = True
        if single.any():
            i, j = alo[single], blo[single]
            near = np.bitwise_count(a[i] ^ b[j]) <= max_bits
            if own:
                near &= i != j
            if near.any():
                yield i[near], j[near]
            alo, ahi, blo, bhi, diff = (x[~single] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            continue
        step = np.uint64(1) << np.uint64(bit)
        keep = ~((step << np.uint64(1)) - np.uint64(1)) if bit < 63 else np.uint64(0)
        amid = np.clip(np.searchsorted(a, (a[alo] & keep) | step), alo, ahi)
        bmid = np.clip(np.searchsorted(b, (b[blo] & keep) | step), blo, bhi)
        same = (alo == blo) & (ahi == bhi) if own else np.zeros(len(alo), dtype=bool)
        parts = []
        for left, right in ((0, 0), (1, 1), (0, 1), (1, 0)):
            x0, x1 = (alo, amid) if left == 0 else (amid, ahi)
            y0, y1 = (blo, bmid) if right == 0 else (bmid, bhi)
            d = diff + (left != right)
            ok = (x1 > x0) & (y1 > y0) & (d <= max_bits)
            if (left, right) == (1, 0):
                ok &= ~same
            parts.append((x0[ok], x1[ok], y0[ok], y1[ok], d[ok]))
        alo, ahi, blo, bhi, diff = (np.concatenate(x) for x in zip(*parts))
        for k in range(0, len(alo), FRONTIER):
            s = slice(k, k + FRONTIER)
            stack.append((bit - 1, alo[s], ahi[s], blo[s], bhi[s], diff[s]))


def forest(n: int, links) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the index pairs that ``links`` yields."""
    root = np.arange(n)
    for i, j in links:
        while True:
            x, y = root[i], root[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
    return root


def _pair_task(max_bits: int):
    def run(rows):
        fp = rows.column("fp").to_numpy().view(np.uint64)
        second = rows.column("second").to_numpy(zero_copy_only=False)
        a, b = np.unique(fp[~second]), np.unique(fp[second])
        if second.any():
            nodes = np.concatenate((a, b))
            root = forest(len(nodes), ((i, j + len(a)) for i, j in trie_links(a, b, max_bits)))
        else:
            nodes = a
            root = forest(len(nodes), trie_links(a, None, max_bits))
        linked = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.table({"u": nodes[linked].view(np.int64), "v": nodes[root[linked]].view(np.int64)})

    return run


def links(fps: DataFrame, max_bits: int = 3, subtree: int = SUBTREE) -> DataFrame:
    """Edges (u, v) that connect all distinct fingerprints (column fp) within ``max_bits`` bits; per task a spanning forest.

    The driver sees one count per prefix, at most 2**12. A prefix with more than ``subtree`` fingerprints is cut into
    chunks by hash, and every pair of chunks is a task of its own, so no task grows with the largest subtree.
    """
    spark = fps.sparkSession
    n = fps.count()
    depth = max(MIN_DEPTH, min(MAX_DEPTH, int(np.ceil(np.log2(max(1, n / subtree))))))
    prefix = F.shiftrightunsigned("fp", 64 - depth).alias("prefix")
    counts = {r["prefix"]: r["count"] for r in fps.groupBy(prefix).count().collect()}
    leaves = [(p, -(-c // subtree)) for p, c in sorted(counts.items())]
    pairs, k = [], 0
    for i, (p, np_) in enumerate(leaves):
        for q, nq in leaves[i:]:
            if (p ^ q).bit_count() > max_bits:
                continue
            for x in range(np_):
                for y in range(x if p == q else 0, nq):
                    pairs += [(p, x, k, False)] + [(q, y, k, True)] * ((p, x) != (q, y))
                    k += 1
    table = spark.createDataFrame(pairs, "prefix long, chunk long, pair long, second boolean")
    chunks = spark.createDataFrame(leaves, "prefix long, chunks long")  # at most 2**12 rows
    placed = (fps.select("fp", prefix).join(F.broadcast(chunks), "prefix")
              .select("fp", "prefix", F.pmod(F.xxhash64("fp"), F.col("chunks")).alias("chunk"))
              .join(table, ["prefix", "chunk"]))
    return placed.select("pair", "second", "fp").groupBy("pair").applyInArrow(_pair_task(max_bits), "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3, max_bits: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """One row per document: doc_id, fp (signed long), fingerprint (16 hex digits), component_id and n_in_component.

    ``with_key`` adds the digest of the text (key) and the component's least fingerprint (root).
    """
    marks = written(fingerprints(docs, words, seed, id_col, text_col, with_key), "simhash")
    fps = written(marks.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")), "simhash-distinct")
    roots = components(links(fps.select("fp"), max_bits))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "first_doc", "n", F.coalesce("root", "fp").alias("root"))
    totals = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.sum("n").alias("n_in_component"))
    of_fp = rooted.join(totals, "root").select("fp", "root", "component_id", "n_in_component")
    return marks.join(of_fp, "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_in_component", *["key", "root"] * with_key)


def keep_one(docs: DataFrame, words: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group of near duplicates, the one with the smallest id; all columns stay.

    A row is known by its id and text, so ids need not be unique; repeated rows are reduced to one. A document without an
    id stays only if its whole group has none.
    """
    found = near_duplicates(docs, words, max_bits, id_col=id_col, text_col=text_col, with_key=True)
    kept = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.key").alias("__key"))
    named = docs.withColumn("__text_key", text_key(text_col))
    return (named.join(kept, named[id_col].cast("long").eqNullSafe(kept["__id"]) & (named["__text_key"] == kept["__key"]), "left_semi")
            .dropDuplicates([id_col, "__text_key"]).drop("__text_key"))
