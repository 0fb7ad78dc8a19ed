"""Benchmark decontamination by the q-gram lemma: regions of a document that share enough character q-grams with a benchmark
item, counted in overlapping diagonal bands, are kept and verified by banded alignment.

An occurrence of an item of m characters with at most k edits shares at least m - q + 1 - q k of its q-grams, and their
diagonals (document position minus item position) lie within k of each other. Bands of 2 k diagonals that overlap by half
hold every such occurrence whole. Case and kind of white space are no edits.

The documents are never shuffled. The benchmark is the query set: it is cut into blocks of at most ``BLOCK_CHARS``
characters (one long item may exceed it), and each block's q-gram index is broadcast in a pass of its own, so a larger
benchmark means more passes and not a larger broadcast. Items shorter than ``min_chars`` are too short to tell a leak from
chance and match nothing.

Null and empty texts hold no item, null items match nothing; null ids are carried along; repeated rows give repeated
results; an empty table on either side gives an empty result; other columns are ignored. Whole texts are searched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.llm.tables import keyed, rows_and_texts

BLOCK_CHARS = 1 << 20
#: Characters of documents hashed at once.
PIECE = 1 << 20
#: Candidates aligned at once.
TOGETHER = 256
SCHEMA = "doc_id long, item_id long, start long, end long, distance int"


def plain(text: str) -> str:
    """Lower case, every white space a blank, each character in its place."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for c in "\n\t\r\x0b\x0c ":
        low = low.replace(c, " ")
    return low


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gram_hashes(points: np.ndarray, q: int) -> np.ndarray:
    """Hashes of all runs of q code points."""
    n = len(points) - q + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        base, step, power, full, have = points.astype(np.uint64) + np.uint64(7), 1, np.uint64(0x9E3779B97F4A7C15), None, 0
        while True:
            if q & step:
                full = base if full is None else full[: len(points) - have - step + 1] * power + base[have: len(points) - step + 1]
                have += step
            if 2 * step > q:
                break
            base = base[: len(base) - step] * power + base[step:]
            power, step = power * power, 2 * step
        h = full[:n] ^ (full[:n] >> np.uint64(31))
        return h * np.uint64(0xFF51AFD7ED558CCD)


class Index:
    """q-grams of a block of items, with what the lemma asks of each item."""

    def __init__(self, items: list[tuple[int, str]], q: int, rate: float):
        self.q, self.ids = q, [i for i, _ in items]
        self.points = [code_points(plain(t)) for _, t in items]
        self.size = np.array([len(p) for p in self.points])
        self.budget = np.floor(rate * self.size).astype(np.int64)
        self.least = np.maximum(1, self.size - q + 1 - q * self.budget)
        h = [gram_hashes(p, q) for p in self.points]
        item, at = np.repeat(np.arange(len(h)), [len(x) for x in h]), np.concatenate([np.arange(len(x)) for x in h])
        h = np.concatenate(h)
        order = np.argsort(h, kind="stable")
        self.item, self.at = item[order], at[order]
        self.grams, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.shift = np.uint64(64 - max(10, int(16 * len(self.grams)).bit_length()))
        self.table = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.table[self.grams >> self.shift] = True
        # any window of `window` positions that a match fills at least by half has so many hits, by averaging
        self.window = int((self.size + self.budget).min())
        self.dense = int(np.ceil(self.least / np.ceil((self.size + self.budget) / self.window)).min())
        self.reach = int((self.size + self.budget).max())

    def hits(self, points: np.ndarray):
        """Arrays (position, item, item position) of equal q-grams, in the parts of the text that are dense enough to matter."""
        h = gram_hashes(points, self.q)
        near = np.flatnonzero(self.table[h >> self.shift])
        if len(near) < self.dense:
            return None
        # enough hits within one window: the hit `dense` - 1 places later is near
        close = np.flatnonzero(near[self.dense - 1:] - near[: len(near) - self.dense + 1] < self.window)
        if not len(close):
            return None
        edge = np.zeros(len(h) + 1, dtype=np.int32)
        np.add.at(edge, np.maximum(near[close] - self.reach, 0), 1)
        np.add.at(edge, np.minimum(near[close] + self.window + self.reach, len(h)), -1)
        near = near[np.cumsum(edge[:-1])[near] > 0]
        g = np.minimum(np.searchsorted(self.grams, h[near]), len(self.grams) - 1)
        ok = self.grams[g] == h[near]
        near, g = near[ok], g[ok]
        n = self.count[g]
        spread = np.repeat(self.first[g] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(near, n), self.item[spread], self.at[spread]

    def regions(self, points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Candidates (row, item, lowest diagonal of the band) of the texts cut at ``offsets``."""
        found = self.hits(points)
        if found is None or not len(found[0]):
            return np.zeros((0, 3), dtype=np.int64)
        pos, item, at = found
        row = np.searchsorted(offsets, pos, side="right") - 1
        inside = pos + self.q <= offsets[row + 1]
        pos, item, at, row = pos[inside], item[inside], at[inside], row[inside]
        k = np.maximum(self.budget[item], 1)
        band = (pos - offsets[row] - at) // k
        keys = np.concatenate((np.stack((row, item, band)), np.stack((row, item, band - 1))), axis=1)
        keys, n = np.unique(keys, axis=1, return_counts=True)
        keys = keys[:, n >= self.least[keys[1]]].T
        keys[:, 2] *= np.maximum(self.budget[keys[:, 1]], 1)
        return keys

    def align(self, texts: list[np.ndarray], regions: np.ndarray) -> list[tuple]:
        """Verified matches (row, item, start, end, distance) among ``regions``: alignment within the band and k beyond it."""
        out = []
        for c in range(0, len(regions), TOGETHER):
            part = regions[c: c + TOGETHER]
            m, k = self.size[part[:, 1]], np.maximum(self.budget[part[:, 1]], 1)
            wide, long = int(4 * k.max()) + 1, int(m.max())
            begin = part[:, 2] - k
            text = np.full((len(part), long + wide), -1, dtype=np.int64)
            item = np.full((len(part), long), -2, dtype=np.int64)
            for i, (r, x, _) in enumerate(part.tolist()):
                lo, hi = max(0, begin[i]), min(len(texts[r]), begin[i] + m[i] + 4 * k[i] + 1)
                if hi > lo:
                    text[i, lo - begin[i]: hi - begin[i]] = texts[r][lo:hi]
                item[i, : m[i]] = self.points[x]
            shift, one = np.arange(wide), 1 << 20  # a cell: edits times `one` plus where the match starts
            cell = np.tile(shift, (len(part), 1))
            best = np.full(len(part), one << 20)
            end = np.zeros(len(part), dtype=np.int64)
            for i in range(long):
                same = text[:, i: i + wide] == item[:, i: i + 1]
                step = cell + one * ~same
                step[:, :-1] = np.minimum(step[:, :-1], cell[:, 1:] + one)
                cell = np.minimum.accumulate(step - one * shift, axis=1) + one * shift
                last = np.flatnonzero(m == i + 1)
                if len(last):
                    j = cell[last].argmin(axis=1)
                    best[last], end[last] = cell[last, j], i + 1 + j
            for i in np.flatnonzero(best // one <= self.budget[part[:, 1]]).tolist():
                out.append((int(part[i, 0]), int(part[i, 1]), int(begin[i] + best[i] % one), int(begin[i] + end[i]), int(best[i] // one)))
        return out

    def search(self, texts: list[str]) -> list[tuple]:
        """Matches (row, item, start, end, distance) in whole texts; of overlapping matches of an item the closest."""
        out, k = [], 0
        while k < len(texts):
            n, total = k, 0
            while n < len(texts) and (n == k or total + len(texts[n]) <= PIECE):
                total += len(texts[n])
                n += 1
            points = [code_points(plain(t)) for t in texts[k:n]]
            offsets = np.concatenate(([0], np.cumsum([len(p) for p in points])))
            best: dict[tuple, list] = {}
            for r, x, start, end, d in sorted(self.align(points, self.regions(np.concatenate(points), offsets)), key=lambda m: (m[4], m[2])):
                spans = best.setdefault((r, x), [])
                if all(end <= s or e <= start for s, e, _ in spans):
                    spans.append((start, end, d))
            out += [(r + k, x, *s) for (r, x), spans in best.items() for s in sorted(spans)]
            k = n
        return out


def _indexes(benchmark: DataFrame, q: int, rate: float, min_chars: int, item_col: str, item_text: str):
    """Yield (ids, index) of the benchmark's items block by block, each broadcast."""
    if min_chars < 2 * q or q * rate >= 0.9:
        raise ValueError("the lemma keeps nothing: min_chars must be at least 2 q, and q * rate below 0.9")
    items = (benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
             .where(F.length("text") >= min_chars).distinct())
    total = items.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-total * 2 // BLOCK_CHARS))
    for b in range(blocks):
        block = sorted((r["item_id"] if r["item_id"] is not None else -1, r["text"], r["item_id"]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect())
        if block:
            yield benchmark.sparkSession.sparkContext.broadcast(([i for _, _, i in block], Index([(i, t) for i, t, _ in block], q, rate)))


def matches(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.06, min_chars: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, start, end, distance): items found in the texts with at most ``rate`` edits per character."""
    names = ["doc_id", "item_id", "start", "end", "distance"]
    spark, docs, out = docs.sparkSession, keyed(docs, id_col, text_col), None
    for held in _indexes(benchmark, q, rate, min_chars, item_col, item_text):
        def run(batches, held=held):
            ids, index = held.value
            for batch in batches:
                found = index.search([t or "" for t in batch.column(1).to_pylist()])
                rows, item, start, end, d = zip(*found) if found else ((),) * 5
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, type=pa.int64())), pa.array([ids[i] for i in item], type=pa.int64()), pa.array(start, type=pa.int64()),
                                                  pa.array(end, type=pa.int64()), pa.array(d, type=pa.int32())], names=names)

        found = docs.mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 10, rate: float = 0.06, min_chars: int = 50, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item; all columns stay, whatever their names. Each row is
    judged where it is, so nothing is shuffled and ids need not be unique."""
    rows = docs.select(F.struct("*").alias("row"))
    for held in _indexes(benchmark, q, rate, min_chars, item_col, item_text):
        def run(batches, held=held):
            _, index = held.value
            for row, texts in rows_and_texts(batches, text_col):
                leaks = np.zeros(len(row), dtype=bool)
                leaks[[r for r, *_ in index.search([t or "" for t in texts])]] = True
                yield pa.RecordBatch.from_arrays([row.filter(pa.array(~leaks))], names=["row"])

        rows = rows.mapInArrow(run, rows.schema)
    return rows.select("row.*")
