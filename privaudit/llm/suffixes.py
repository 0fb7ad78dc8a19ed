"""Exact substring dedup by a sparse suffix array: sampled splitters range-partition suffixes by their leading bytes,
buckets sort them by multikey quicksort, and groups that cross a bucket border are compared across it.

A byte goes when it is covered by a string of ``length`` bytes that also starts earlier: in a document with a smaller id,
or earlier in the same document. Strings are judged on the input and never cross documents.

Which suffixes are sorted. Every string of ``length`` bytes names one of its own k-grams, the leftmost with the smallest
hash, as its anchor; equal strings name the same one. So strings can only be equal if their anchors are, and the strings
that share one anchor in one document are consecutive: one *slice* of the text, a suffix that starts ``at`` bytes before
the anchor. There is one anchor per 35 bytes or so of ordinary text instead of one suffix per byte.

1. The texts are dealt over blocks of a few megabytes by the hash of their id. A block returns its distinct anchor
   hashes; a hash seen once in all blocks cannot repeat, and nothing of it is sorted.
2. Each block cuts the slices of the anchors that repeat. Splitters sampled from the texts (leading bytes, then document)
   deal them to buckets; as the document breaks ties, a very common passage is spread over several buckets.
3. A bucket sorts its slices from the anchor on, 8 bytes at a time, going on only with rows that still tie (multikey
   quicksort). Equal slices are neighbours: all but the earliest are repeats. Slices that share an anchor but differ are
   compared string by string, with the bytes themselves as the last word. Groups that a splitter cuts return their
   earliest strings, and a window over these settles them across buckets.
4. The blocks remove what is covered.

Null texts are empty. A null id sorts after all others; such rows, and repeated rows of one id, are ordered by their text.
Repeated rows are documents of their own, so the second one goes. Empty tables give empty results; other columns are
ignored. Nothing is capped: a long text is one block's work, processed in pieces.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from privaudit.llm.tables import bytes_of, keyed

#: Bytes of text per block and of slices per bucket aimed at; they set how many there are, not what is compared.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 32 << 20
#: Splitters are at most so many; beyond, buckets are divided further by the anchor's hash.
MAX_BUCKETS = 4096
#: Suffixes drawn for the splitters, and the text they are drawn from.
SAMPLE, SAMPLE_BYTES = 20_000, 16 << 20
#: Positions hashed at once.
PIECE = 1 << 20
LAST = (1 << 63) - 1

_MIX = [np.random.default_rng(s).integers(1, 1 << 63, 256, dtype=np.uint64) for s in (11, 12)]
_BASE = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)]


def gram_size(length: int) -> int:
    """Bytes of an anchor: the largest power of two that is at most a third of ``length``."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def rolling(values: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """Polynomial hashes of all runs of ``size`` bytes along the last axis, by doubling."""
    full, have, powers, step, base = None, 0, _BASE[which], 1, _MIX[which][values]
    with np.errstate(over="ignore"):
        while True:
            if size & step:
                if full is None:
                    full, have = base, step
                else:
                    n = values.shape[-1] - have - step + 1
                    full, have = full[..., :n] * powers + base[..., have:have + n], have + step
            if step * 2 > size:
                return full
            n = values.shape[-1] - 2 * step + 1
            base = base[..., :n] * powers + base[..., step:step + n]
            powers, step = powers * powers, step * 2


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))


def least_positions(h: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` hashes, the position of the leftmost smallest (by their upper 40 bits)."""
    low = np.uint64((1 << 24) - 1)
    m = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        m = np.minimum(m[:-step], m[step:])
        step *= 2
    if step < width:
        m = np.minimum(m[: len(m) - (width - step)], m[width - step:])
    return (m & low).astype(np.int64)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Slices of the texts in ``data`` cut at ``offsets``: arrays (row, first string's start, strings, anchor, anchor's hash)."""
    k = gram_size(length)
    width, out = length - k + 1, []
    edges = np.unique(np.concatenate((offsets, np.maximum(offsets[:-1], offsets[1:] - length + 1))))
    for c in range(0, len(data) - length + 1, PIECE):
        part = data[c: c + PIECE + length - 1]
        h = mixed(rolling(part, k))
        at = least_positions(h, width)
        inner = edges[np.searchsorted(edges, c + 1): np.searchsorted(edges, c + len(at))] - c
        cuts = np.unique(np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, inner)))
        row = np.searchsorted(offsets, cuts + c, side="right") - 1
        ok = cuts + c + length <= offsets[row + 1]
        n = np.diff(np.append(cuts, len(at)))
        m = at[cuts]
        out.append((row[ok], cuts[ok] + c, n[ok], m[ok] + c, h[m[ok]]))
    if not out:
        e = np.zeros(0, dtype=np.int64)
        return e, e, e, e, np.zeros(0, dtype=np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out))


class Block:
    """The documents of one block, in the order of their ids (then texts), as one run of bytes."""

    def __init__(self, docs: pa.Table):
        ids = docs.column("doc_id").fill_null(LAST).to_numpy()
        column = docs.column("text").combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
        column = column.cast(pa.large_binary()).fill_null(b"")
        order = np.argsort(ids, kind="stable")
        s = ids[order]
        edges = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1], [True]))) if len(s) else np.zeros(1, dtype=np.int64)
        for i in np.flatnonzero(np.diff(edges) > 1):
            part = slice(edges[i], edges[i + 1])
            order[part] = sorted(order[part].tolist(), key=lambda j: column[j].as_py())
        column = column.take(pa.array(order))
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        self.nulls, self.order = docs.column("doc_id").is_null().to_numpy()[order], order
        self.ids, n = s, len(s)
        raw = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
        body = column.buffers()[2] if n else None
        self.data = np.frombuffer(body, dtype=np.uint8)[raw[0]: raw[-1]] if body is not None else np.zeros(0, dtype=np.uint8)
        self.offsets = raw - raw[0]


def _seen_in_block(length: int):
    def run(key, docs):
        b = Block(docs)
        h, n = np.unique(anchors(b.data, b.offsets, length)[4], return_counts=True)
        block = key[0].as_py()
        return pa.table({"h": h.view(np.int64), "tag": np.where(n > 1, -1 - block, block).astype(np.int32)})

    return run


def _cut_slices(length: int, splitters: list, parts: int):
    k = gram_size(length)

    def run(key, docs, again):
        b, block = Block(docs), key[0].as_py()
        row, start, n, m, h = anchors(b.data, b.offsets, length)
        repeats = np.sort(again.column("h").to_numpy().view(np.uint64))
        if len(repeats):
            hit = repeats[np.minimum(np.searchsorted(repeats, h), len(repeats) - 1)] == h
            row, start, n, m, h = (x[hit] for x in (row, start, n, m, h))
        else:
            row, start, n, m, h = (x[:0] for x in (row, start, n, m, h))
        view, seen = memoryview(b.data), set()
        first = np.zeros(len(row), dtype=bool)
        for i, (x, y, z) in enumerate(zip(start.tolist(), (start + n + length - 1).tolist(), m.tolist())):
            d = (xxhash.xxh3_128_digest(view[x:y]), z - x)
            if d not in seen:
                seen.add(d)
                first[i] = True
        # repeats inside the block are settled here; runs of them that touch become one row
        r, s, c = row[~first], start[~first], n[~first]
        new = np.ones(len(r), dtype=bool)
        new[1:] = (r[1:] != r[:-1]) | (s[1:] != s[:-1] + c[:-1])
        at = np.flatnonzero(new)
        gone = (r[at], s[at] - b.offsets[r[at]], np.add.reduceat(c, at) if len(at) else c[:0])
        row, start, n, m, h = (x[first] for x in (row, start, n, m, h))
        ids = b.ids[row].tolist()
        bucket = [bisect_right(splitters, (view[z:z + k].tobytes(), d)) for z, d in zip(m.tolist(), ids)]
        bucket = np.array(bucket, dtype=np.int64) * parts + (h % np.uint64(parts)).astype(np.int64)
        text = [view[x:y].tobytes() for x, y in zip(start.tolist(), (start + n + length - 1).tolist())]
        spread = np.arange(len(gone[0])) % ((len(splitters) + 1) * parts)
        both = lambda x, y: np.concatenate((x, y))
        total = len(row) + len(gone[0])
        return pa.table({
            "bucket": both(bucket, spread).astype(np.int64), "slice": pa.array(text + [None] * len(gone[0]), type=pa.binary()),
            "at": both(m - start, np.zeros(len(gone[0]), dtype=np.int64)).astype(np.int32), "n": both(n, gone[2]).astype(np.int32),
            "doc_id": both(b.ids[row], b.ids[gone[0]]), "block": np.full(total, block, dtype=np.int32), "row": both(row, gone[0]).astype(np.int32),
            "start": both(start - b.offsets[row], gone[1]).astype(np.int32)})

    return run


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of ``words`` and, along it, the number of the group of equal rows.

    Multikey quicksort with one 8-byte word as a character: rows are split by one word, and only rows that still tie go on
    to the next.
    """
    order = np.arange(len(words))
    group = np.zeros(len(words), dtype=np.int64)
    tied = np.arange(len(words))  # places in the order
    for c in range(words.shape[1]):
        if not len(tied):
            break
        rows = order[tied]
        local = np.lexsort((words[rows, c], group[tied]))
        rows = rows[local]
        order[tied] = rows  # places are sorted, and groups keep theirs
        g, w = group[tied], words[rows, c]
        new = np.ones(len(tied), dtype=bool)
        new[1:] = (g[1:] != g[:-1]) | (w[1:] != w[:-1])
        first = np.flatnonzero(new)
        group[tied] = tied[np.repeat(first, np.diff(np.append(first, len(tied))))]  # a group is named by its first place
        size = np.repeat(np.diff(np.append(first, len(tied))), np.diff(np.append(first, len(tied))))
        tied = tied[size > 1]
    return order, group


def _sort_bucket(length: int, cut: frozenset):
    k = gram_size(length)
    width = length - k + 1
    right = -(-length // 8) * 8
    left = -(-(width - 1) // 8) * 8

    def run(rows):
        body = rows.column("slice")
        settled = body.is_null().to_numpy()
        col = {c: rows.column(c).to_numpy() for c in ("at", "n", "doc_id", "block", "row", "start")}
        done = [{c: col[c][settled] for c in ("block", "row", "start", "n", "doc_id")}]
        live = np.flatnonzero(~settled)
        at, n, doc, block, row, start = (col[c][live] for c in ("at", "n", "doc_id", "block", "row", "start"))
        text = [x.as_py() for x in body.take(pa.array(live))] if len(live) else []
        N = len(text)
        open_rows: list[dict] = []
        if N:
            # bytes around the anchor: its suffix to the right, what precedes it to the left
            x = np.zeros((N, left + right), dtype=np.uint8)
            for i, (t, a) in enumerate(zip(text, at.tolist())):
                x[i, left - a: left - a + len(t)] = np.frombuffer(t, dtype=np.uint8)
            words = np.concatenate((np.ascontiguousarray(x[:, left:]).view(">u8"), np.ascontiguousarray(x[:, :left][:, ::-1]).view(">u8").reshape(N, -1)), axis=1).astype(np.uint64)
            words = np.concatenate((words, (at.astype(np.uint64) << np.uint64(32) | n.astype(np.uint64))[:, None]), axis=1)
            order, same = multikey_sort(words)
            docs, place = np.unique(np.stack((doc, block.astype(np.int64), row.astype(np.int64))), axis=1, return_inverse=True)
            when = (place.reshape(-1).astype(np.int64) << 32) | start.astype(np.int64)
            order = order[np.lexsort((when[order], same))]  # equal slices: earliest first
            later = np.zeros(N, dtype=bool)
            later[1:] = same[1:] == same[:-1]
            r = order[later]
            done.append({"block": block[r], "row": row[r], "start": start[r], "n": n[r], "doc_id": doc[r]})
            # different slices with one anchor: compare their strings
            r = order[~later]
            gram = np.ascontiguousarray(x[r, left: left + k]).view(f"V{k}").reshape(-1)
            new = np.ones(len(r), dtype=bool)
            new[1:] = gram[1:] != gram[:-1]
            group = np.cumsum(new) - 1
            crosses = np.array([g.tobytes() in cut for g in gram[new]], dtype=bool)[group] if cut else np.zeros(len(r), dtype=bool)
            pick = crosses | (np.bincount(group)[group] > 1)
            r, group, crosses = r[pick], group[pick], crosses[pick]
            if len(r):
                hashes = [np.concatenate([rolling(x[r[i: i + 2048]], length, w) for i in range(0, len(r), 2048)]) for w in (0, 1)]
                who = np.repeat(np.arange(len(r)), n[r])
                step = np.arange(len(who)) - np.repeat(np.cumsum(n[r]) - n[r], n[r])
                column = left - at[r][who] + step
                w0, w1 = hashes[0][who, column], hashes[1][who, column]
                begin, key = start[r][who] + step, when[r][who] + step
                o = np.lexsort((key, column, w1, w0, group[who]))
                eq = np.zeros(len(o), dtype=bool)
                a, b = o[1:], o[:-1]
                eq[1:] = (group[who[a]] == group[who[b]]) & (w0[a] == w0[b]) & (w1[a] == w1[b]) & (column[a] == column[b])
                for i in range(0, len(o) - 1, 1 << 16):  # the bytes have the last word
                    j = np.flatnonzero(eq[1 + i: 1 + i + (1 << 16)]) + 1 + i
                    if len(j):
                        span = column[o[j]][:, None] + np.arange(length)
                        eq[j] = (x[r[who[o[j]]][:, None], span] == x[r[who[o[j - 1]]][:, None], span]).all(axis=1)
                z = np.sort(o[eq])  # in the order of slices, then starts
                begins = np.ones(len(z), dtype=bool)
                begins[1:] = (who[z[1:]] != who[z[:-1]]) | (begin[z[1:]] != begin[z[:-1]] + 1)
                f = np.flatnonzero(begins)
                q = r[who[z[f]]]
                done.append({"block": block[q], "row": row[q], "start": begin[z[f]], "n": np.diff(np.append(f, len(z))), "doc_id": doc[q]})
                z = o[~eq]
                z = z[crosses[who[z]]]
                q = r[who[z]]
                open_rows.append({"block": block[q], "row": row[q], "start": begin[z], "n": np.ones(len(z), dtype=np.int64), "doc_id": doc[q], "w0": w0[z], "w1": w1[z]})
        kinds = {"block": np.int32, "row": np.int32, "start": np.int32, "n": np.int32, "doc_id": np.int64}
        both = {c: np.concatenate([d[c] for d in done + open_rows]).astype(t) for c, t in kinds.items()}
        settled_n = sum(len(d["n"]) for d in done)
        for c in ("w0", "w1"):
            tail = open_rows[0][c].view(np.int64) if open_rows else np.zeros(0, dtype=np.int64)
            both[c] = pa.array(np.concatenate((np.zeros(settled_n, dtype=np.int64), tail)), mask=np.arange(settled_n + len(tail)) < settled_n)
        return pa.table(both)

    return run


def _remove(length: int, carry: bool = False):
    def run(docs, gone):
        b = Block(docs)
        row, start, n = (gone.column(c).to_numpy().astype(np.int64) for c in ("row", "start", "n"))
        lo = b.offsets[row] + start
        hi = lo + n + length - 1
        edge = np.zeros(len(b.data) + 1, dtype=np.int32)
        np.add.at(edge, lo, 1)
        np.add.at(edge, hi, -1)
        away = np.cumsum(edge[:-1]) > 0
        begins = away.copy()
        begins[1:] &= ~away[:-1]
        inner = b.offsets[:-1][b.offsets[:-1] < len(away)]
        begins[inner] = away[inner]  # runs do not cross documents
        total = np.concatenate(([0], np.cumsum(away))).astype(np.int64)
        spans = np.concatenate(([0], np.cumsum(begins))).astype(np.int64)
        kept = b.data[~away]
        cuts = b.offsets - total[b.offsets]
        body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(b.ids), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(kept)])
        out = {"row": docs.column("row").take(pa.array(b.order))} if carry else {}
        out |= {"doc_id": pa.array(b.ids, mask=b.nulls), "n_bytes": np.diff(b.offsets), "n_removed": np.diff(total[b.offsets]), "n_spans": np.diff(spans[b.offsets]), "kept": body.cast(pa.binary())}
        return pa.table(out)

    return run


def splitters_of(docs: DataFrame, length: int, total: int, buckets: int) -> list:
    """At most ``buckets`` - 1 splitters (leading bytes, doc_id) from suffixes of texts drawn by their hash; for balance only."""
    if buckets < 2:
        return []
    k = gram_size(length)
    share = max(1, total // SAMPLE_BYTES)

    def run(batches):
        for batch in batches:
            b = Block(pa.Table.from_batches([batch]))
            row, _, _, m, h = anchors(b.data, b.offsets, length)
            pick = mixed(h) % np.uint64(max(1, min(total, SAMPLE_BYTES) // 35 // SAMPLE)) == 0
            view = memoryview(b.data)
            yield pa.RecordBatch.from_pydict({"gram": pa.array([view[z:z + k].tobytes() for z in m[pick].tolist()], type=pa.binary()), "doc_id": b.ids[row[pick]]})

    drawn = docs.where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0).mapInArrow(run, "gram binary, doc_id long")
    rows = sorted((bytes(r["gram"]), r["doc_id"]) for r in drawn.limit(4 * SAMPLE).collect())
    return sorted({rows[len(rows) * i // buckets] for i in range(1, buckets)}) if rows else []


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def deduplicate(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and kept (the bytes that stay)."""
    return _deduplicated(keyed(docs, id_col, text_col), length)


def _deduplicated(docs: DataFrame, length: int) -> DataFrame:
    """``deduplicate`` of rows (doc_id, text), and perhaps a struct ``row`` that is handed back with each."""
    carry = "row" in docs.columns
    total = bytes_of(docs)
    blocks = max(1, -(-total // BLOCK_BYTES))
    pieces = max(1, -(-total * 4 // BUCKET_BYTES))
    splitters = splitters_of(docs.select("doc_id", "text"), length, total, min(pieces, MAX_BUCKETS))
    parts = max(1, -(-pieces // MAX_BUCKETS))
    cut = frozenset(g for g, _ in splitters)
    placed = docs.withColumn("block", F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id")), F.lit(blocks)).cast("int"))

    seen = placed.groupBy("block").applyInArrow(_seen_in_block(length), "h long, tag int")
    repeats = (seen.withColumn("times", F.count("*").over(Window.partitionBy("h"))).where("times > 1 or tag < 0")
               .select("h", F.when(F.col("tag") < 0, -1 - F.col("tag")).otherwise(F.col("tag")).alias("block")))
    slices = placed.groupBy("block").cogroup(repeats.groupBy("block")).applyInArrow(
        _cut_slices(length, splitters, parts), "bucket long, slice binary, at int, n int, doc_id long, block int, row int, start int")
    found = slices.groupBy("bucket").applyInArrow(_sort_bucket(length, cut), "block int, row int, start int, n int, doc_id long, w0 long, w1 long")
    # strings of groups that a splitter cut: the earliest of all buckets stays; every other row is settled and alone in its group
    alone = F.when(F.col("w0").isNull(), F.struct("block", "row", "start"))
    earliest = F.min(F.struct("doc_id", "block", "row", "start")).over(Window.partitionBy("w0", "w1", alone))
    gone = found.withColumn("earliest", earliest).where(F.col("w0").isNull() | (F.col("earliest") != F.struct("doc_id", "block", "row", "start"))).select("block", "row", "start", "n")
    schema = T.StructType([*([docs.schema["row"]] if carry else []), *T.StructType.fromDDL(SCHEMA).fields])
    return placed.groupBy("block").cogroup(gone.groupBy("block")).applyInArrow(_remove(length, carry), schema)


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of the texts; a document with nothing left goes.

    A character of which only a part is left is dropped, and in a text that is cut so is U+FFFD. Texts in which nothing
    repeats stay as they are, and all other columns stay. Ids need not be unique. The other columns travel with the texts
    through the blocks, so that nothing is joined back.
    """
    others = [F.col(c) for c in docs.columns if c != text_col]
    whole = docs.select(F.struct(F.col(text_col).isNull().alias("null"), F.struct(F.lit(1).alias("any"), *others).alias("rest")).alias("row"),
                        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kept = F.col("kept").cast("string")
    text = F.when(F.col("n_removed") > 0, F.translate(F.make_valid_utf8(kept), "\ufffd", "")).when(~F.col("row.null"), kept)
    return (_deduplicated(whole, length).where("n_removed = 0 or octet_length(kept) > 0")
            .select(*[text.alias(c) if c == text_col else F.col("row.rest").getField(c).alias(c) for c in docs.columns]))
