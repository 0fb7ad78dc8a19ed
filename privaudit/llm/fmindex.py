"""Substring dedup by compressed FM-indexes: shards index the passages that may repeat, documents are streamed against them
by backward search over wavelet trees, and what matches a passage of an earlier document over at least ``window`` words goes.

A word goes when it is covered by ``window`` consecutive words of its document that also start in a document with a smaller
id. Windows are judged on the input and never cross documents.

Which passages meet. Every window of words names one of its own k-grams of words, the leftmost with the smallest hash, as
its anchor; equal windows name the same one. The windows of a document that share an anchor are consecutive, a *passage*.

1. The texts are dealt over blocks of a few megabytes by the hash of their id. A block returns its distinct anchors, packed
   by the part of the hash range they fall into; a part tells each block which of its anchors are in other blocks as well.
   An anchor of one document only cannot repeat, and nothing of it is sent.
2. A block sends each distinct passage of the other anchors once, with the smallest id that has it, to the shard of its
   anchor. An anchor found in many blocks would make a shard hot: its windows are sent one by one to the shards of their
   own hashes, so that only equal windows meet, one row per block.
3. A shard builds the FM-index of its distinct passages (Burrows-Wheeler transform of word numbers in a wavelet matrix of
   packed bits with rank counts; the suffix array is dropped but for the smallest document per group of suffixes that agree
   on ``window`` words). Passages are searched backwards, all at once: a match is extended by the word to its left, and
   matches longer than ``window`` are cut back to it, which is the matching statistic up to the threshold. The interval of
   a full match names the earliest document.
4. The blocks remove what is covered in documents later than the earliest.

Words are compared as words in the index; hashes only decide which passages meet. Null texts have no words. A null id
comes after all ids, and rows of one id (null too) are not earlier than each other, so repeated rows keep what only they
share. Empty tables give empty results, other columns are ignored, and whole texts are searched whatever their length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.llm.tables import bytes_of, keyed

#: Bytes of text per block and of passages per shard aimed at, and packed anchors per part; they set how many there are.
BLOCK_BYTES, SHARD_BYTES, PART_BYTES = 4 << 20, 6 << 20, 16 << 20
#: Blocks with an anchor from which its windows travel one by one.
HOT = 64
#: Windows whose anchors are found at once.
PIECE = 1 << 20
LAST = (1 << 63) - 1
SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
        return h ^ (h >> np.uint64(29))


def runs(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` word hashes."""
    out = np.zeros(max(0, len(h) - size + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i: i + len(out)])
    return out


def leftmost_least(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the leftmost smallest of each run of ``width`` hashes (by their upper 40 bits)."""
    low = np.uint64((1 << 24) - 1)
    m, step = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1
    while 2 * step <= width:
        m, step = np.minimum(m[:-step], m[step:]), 2 * step
    if step < width:
        m = np.minimum(m[: len(m) - (width - step)], m[width - step:])
    return (m & low).astype(np.int64)


class Words:
    """The words of the documents of one block, in the order of their ids, and their passages."""

    def __init__(self, docs: pa.Table):
        ids = docs.column("doc_id").fill_null(LAST).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.nulls = ids[order], docs.column("doc_id").is_null().to_numpy()[order]
        texts = docs.column("text").take(pa.array(order)).cast(pa.large_binary()).fill_null(b"").to_pylist()
        edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))  # a space between texts
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        inside = ~SPACES[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        starts = np.flatnonzero(begins)
        self.letters = data[inside]
        self.cuts = np.append(np.cumsum(inside)[starts] - 1, len(self.letters)).astype(np.int64)
        self.offsets = np.searchsorted(starts, edges)  # words before each document
        words = self.column(np.arange(len(starts))).dictionary_encode()
        self.code = words.indices.to_numpy()
        self.hash = np.array([xxhash.xxh3_64_intdigest(w) for w in words.dictionary.to_pylist()], dtype=np.uint64)

    def column(self, at: np.ndarray) -> pa.LargeBinaryArray:
        """Consecutive words at ``at`` as an array."""
        cuts = self.cuts[at[0]: at[-1] + 2] if len(at) else np.zeros(1, dtype=np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.ascontiguousarray(cuts)), pa.py_buffer(self.letters)])

    def passages(self, window: int, gram: int):
        """Arrays (document, first window's start, windows, hash of the anchor) of all passages."""
        width, n = window - gram + 1, len(self.code)
        h = self.hash[self.code] if n else np.zeros(0, dtype=np.uint64)
        edges = np.unique(np.concatenate((self.offsets, np.maximum(self.offsets[:-1], self.offsets[1:] - window + 1))))
        out = [(np.zeros(0, dtype=np.int64),) * 3 + (np.zeros(0, dtype=np.uint64),)]
        for c in range(0, n - window + 1, PIECE):
            grams = runs(h[c: c + PIECE + window - 1], gram)
            at = leftmost_least(grams, width)
            inner = edges[np.searchsorted(edges, c + 1): np.searchsorted(edges, c + len(at))] - c
            first = np.unique(np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1, inner)))
            count = np.diff(np.append(first, len(at)))
            doc = np.searchsorted(self.offsets, first + c, side="right") - 1
            ok = first + c + window <= self.offsets[doc + 1]
            out.append((doc[ok], first[ok] + c, count[ok], grams[at[first[ok]]]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def texts(self, start: np.ndarray, n: np.ndarray) -> list[bytes]:
        """The words of each run, joined by a space."""
        gaps = np.zeros(len(self.letters), dtype=bool)
        gaps[self.cuts[1:-1]] = True
        at = np.flatnonzero(gaps)
        joined = memoryview(np.insert(self.letters, at, 32))
        a = self.cuts[start] + start
        b = self.cuts[start + n] + start + n - 1
        return [joined[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())]


def _multi(hashes: np.ndarray, doc_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and whether each is in rows of several ids."""
    order = np.lexsort((doc_ids, hashes))
    h, d = hashes[order], doc_ids[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, dtype=np.int64)
    last = np.append(first[1:], len(h)) - 1
    return h[first], d[first] != d[last]


def _anchors(window: int, gram: int, parts: int):
    def run(key, docs):
        w = Words(docs)
        doc, _, _, h = w.passages(window, gram)
        found, _ = _multi(h, w.ids[doc])
        part = (found >> np.uint64(40)) % np.uint64(parts)
        body = [found[part == p].tobytes() for p in range(parts)]
        return pa.table({"part": np.arange(parts, dtype=np.int32), "block": np.full(parts, key[0].as_py(), dtype=np.int32), "anchors": pa.array(body, type=pa.binary())})

    return run


def _shared(hot: int):
    def run(rows):
        body = [np.frombuffer(x, dtype=np.uint64) for x in rows.column("anchors").to_pylist()]
        who = np.repeat(np.arange(len(body)), [len(x) for x in body])
        h = np.concatenate(body)
        order = np.argsort(h, kind="stable")
        h, who = h[order], who[order]
        new = np.concatenate(([True], h[1:] != h[:-1])) if len(h) else np.zeros(0, dtype=bool)
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(h)))
        times = np.repeat(size, size)
        pick = times > 1
        h, who, many = h[pick], who[pick], times[pick] > hot
        back = [(h[who == i], many[who == i]) for i in range(len(body))]
        return pa.table({"block": rows.column("block"), "cold": pa.array([x[~m].tobytes() for x, m in back], type=pa.binary()), "hot": pa.array([x[m].tobytes() for x, m in back], type=pa.binary())})

    return run


def _found_in(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), dtype=bool)
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h


class Sent:
    """What a block sends: its distinct passages, by the runs of words it has; the same each time it is made."""

    def __init__(self, docs: pa.Table, shared: pa.Table, window: int, gram: int):
        w = self.words = Words(docs)
        doc, start, n, h = w.passages(window, gram)
        own, several = _multi(h, w.ids[doc])
        cold, hot = (np.sort(np.concatenate([np.zeros(0, dtype=np.uint64), *(np.frombuffer(x, dtype=np.uint64) for x in shared.column(c).to_pylist())])) for c in ("cold", "hot"))
        burn = _found_in(h, hot)
        pick = (_found_in(h, cold) | _found_in(h, own[several])) & ~burn
        # windows of hot anchors one by one
        single = np.repeat(start[burn], n[burn]) + np.arange(n[burn].sum()) - np.repeat(np.cumsum(n[burn]) - n[burn], n[burn])
        route = np.concatenate((h[pick], runs(w.hash[w.code], window)[single] if len(single) else h[:0]))
        self.doc = np.concatenate((doc[pick], np.repeat(doc[burn], n[burn])))
        self.start, self.n = np.concatenate((start[pick], single)), np.concatenate((n[pick], np.ones(len(single), dtype=np.int64)))
        # equal passages are one row; by number of words and a 128-bit digest of them
        texts = w.texts(self.start, self.n + window - 1)
        seen: dict[bytes, int] = {}
        self.row = np.array([seen.setdefault(t, len(seen)) for t in texts], dtype=np.int64)
        self.distinct = list(seen)
        self.least = np.full(len(seen), LAST)
        np.minimum.at(self.least, self.row, w.ids[self.doc])
        self.route = np.zeros(len(seen), dtype=np.uint64)
        self.route[self.row] = route


def _passages(window: int, gram: int, shards: int):
    def run(key, docs, shared):
        s = Sent(docs, shared, window, gram)
        return pa.table({"shard": (mixed(s.route) % np.uint64(shards)).astype(np.int32), "block": np.full(len(s.distinct), key[0].as_py(), dtype=np.int32),
                         "row": np.arange(len(s.distinct), dtype=np.int32), "least": s.least, "passage": pa.array(s.distinct, type=pa.binary())})

    return run


class Wavelet:
    """Wavelet matrix: one packed row of bits per bit of the symbols, with the ones counted before every 64."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.n, self.levels = len(symbols), []
        for b in range(bits - 1, -1, -1):
            on = (symbols >> b & 1).astype(bool)
            packed = np.packbits(np.concatenate((on, np.zeros(-len(on) % 64 + 64, dtype=bool))), bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed)[:-1], dtype=np.int64)))
            self.levels.append((b, packed, before, self.n - int(on.sum())))
            symbols = np.concatenate((symbols[~on], symbols[on]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol is among the first ``at``, plus what ``base`` has of it."""
        for b, packed, before, zeros in self.levels:
            word = at >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbol >> b & 1, zeros + ones, at - ones)
        return at

    def base(self, symbols: int) -> np.ndarray:
        """Where the places of each symbol begin at the lowest level."""
        return self.rank(np.arange(symbols), np.zeros(symbols, dtype=np.int64))


class FMIndex:
    """FM-index of passages given as word numbers from 1; 0 ends a passage."""

    def __init__(self, text: np.ndarray, doc: np.ndarray, window: int):
        n, self.window = len(text), window
        # order of suffixes by their first `window` words at least, by doubling
        rank, have = text.astype(np.int64), 1
        while have < window:
            second = np.zeros(n, dtype=np.int64)
            second[: n - have] = rank[have:] + 1
            key = rank * (n + 2) + second
            order = np.argsort(key, kind="stable")
            new = np.concatenate(([False], key[order][1:] != key[order][:-1]))
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new)
            have *= 2
        order = np.argsort(rank, kind="stable")
        bits = max(1, int(text.max(initial=0)).bit_length())
        self.first = np.searchsorted(text[order], np.arange((1 << bits) + 1))  # where suffixes with each first word begin
        self.tree = Wavelet(text[order - 1], bits)
        self.base = self.tree.base(1 << bits)
        # suffixes that agree on `window` words lie together: their bounds, and the smallest document among them
        self.common = np.zeros(n, dtype=np.int8 if window < 128 else np.int32)  # words shared with the suffix before, up to `window`
        equal = np.ones(max(n - 1, 0), dtype=bool)
        for k in range(window):
            shifted = np.where(order + k < n, text[np.minimum(order + k, n - 1)], 0)
            equal &= shifted[1:] == shifted[:-1]
            self.common[1:] += equal
        self.breaks: dict[int, np.ndarray] = {}
        new = self.common < window
        self.group = (np.cumsum(new) - 1).astype(np.int32)
        self.begin = np.append(np.flatnonzero(new), n)
        self.least = np.minimum.reduceat(doc[order], self.begin[:-1]) if n else np.zeros(0, dtype=np.int64)

    def extend(self, word: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward step: the interval of the match with ``word`` before it."""
        both = self.tree.rank(np.concatenate((word, word)), np.concatenate((lo, hi)))
        start = self.first[word] - self.base[word]
        return both[: len(word)] + start, both[len(word):] + start

    def cut_back(self, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Interval of the suffixes that share their first ``length`` words with the one at each place."""
        lo, hi = np.empty_like(at), np.empty_like(at)
        for k in np.unique(length).tolist():
            if k not in self.breaks:
                self.breaks[k] = np.append(np.flatnonzero(self.common < k) if k else 0, len(self.common))
            edges, own = self.breaks[k], length == k
            right = np.searchsorted(edges, at[own], side="right")
            lo[own], hi[own] = edges[right - 1], edges[np.minimum(right, len(edges) - 1)]
        return lo, hi

    def statistics(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place of ``text``: words matched there up to ``window``, and the smallest document with a full match.

        Passages are [start, end); all are searched from their last word on at once, the longest first.
        """
        size = ends - starts
        order = np.argsort(-size, kind="stable")
        matched, earliest = np.zeros(len(text), dtype=np.int32), np.full(len(text), LAST)
        lo, hi, have = np.zeros(len(order), dtype=np.int64), np.full(len(order), self.tree.n, dtype=np.int64), np.zeros(len(order), dtype=np.int32)
        for step in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-size[order], -step, side="left"))  # passages with more words than steps taken
            at = ends[order[:live]] - 1 - step
            a, b = self.extend(text[at], lo[:live], hi[:live])
            more = have[:live] + 1
            gone = np.flatnonzero(a >= b)  # not indexed with all that follows: the match loses words at its right end until it is
            while len(gone):
                lost = more[gone] == 1  # the word alone is not indexed
                a[gone[lost]], b[gone[lost]], more[gone[lost]] = 0, self.tree.n, 0
                gone = gone[~lost]
                more[gone] -= 1
                lo[gone], hi[gone] = self.cut_back(lo[gone], more[gone] - 1)
                a[gone], b[gone] = self.extend(text[at[gone]], lo[gone], hi[gone])
                gone = gone[a[gone] >= b[gone]]
            full = more >= self.window
            g = self.group[np.minimum(a, len(self.group) - 1)]
            a, b = np.where(full, self.begin[g], a), np.where(full, self.begin[g + 1], b)
            more = np.minimum(more, self.window)
            matched[at] = more
            earliest[at[full]] = self.least[g[full]]
            lo[:live], hi[:live], have[:live] = a, b, more
        return matched, earliest


def _search(window: int):
    def run(rows):
        passages = rows.column("passage").combine_chunks()
        passages = pa.concat_arrays(passages.chunks) if isinstance(passages, pa.ChunkedArray) else passages
        coded = passages.dictionary_encode()
        number, least = coded.indices.to_numpy(), np.full(len(coded.dictionary), LAST)
        np.minimum.at(least, number, rows.column("least").to_numpy())
        words = pc.split_pattern(coded.dictionary, b" ")
        size = np.diff(words.offsets.to_numpy().astype(np.int64))
        codes = words.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        ends = np.cumsum(size + 1) - 1
        starts = ends - size
        text = np.zeros(int((size + 1).sum()), dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[ends] = False
        text[inside] = codes
        index = FMIndex(text, np.repeat(least, size + 1), window)
        matched, earliest = index.statistics(text, starts, ends)
        # an interval at or above the threshold is reported window by window, per block that asked
        block, row = rows.column("block").to_numpy(), rows.column("row").to_numpy()
        order = np.lexsort((row, block))
        block, row, number = block[order], row[order], number[order]
        count = size[number] - window + 1
        place = np.repeat(starts[number], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        answer = np.where(matched[place] >= window, earliest[place], LAST)
        cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else np.zeros(0, dtype=np.int64)
        stop, upto = np.append(cuts[1:], len(block)), np.concatenate(([0], np.cumsum(count)))
        return pa.table({"block": block[cuts].astype(np.int32), "rows": pa.array([row[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, stop)], type=pa.binary()),
                         "counts": pa.array([count[a:b].astype(np.int32).tobytes() for a, b in zip(cuts, stop)], type=pa.binary()),
                         "earliest": pa.array([answer[upto[a]: upto[b]].tobytes() for a, b in zip(cuts, stop)], type=pa.binary())})

    return run


def _cut(window: int, gram: int):
    def run(key, docs, told):
        shared = told.filter(pc.is_valid(told.column("cold")))
        found = told.filter(pc.is_valid(told.column("rows")))
        s = Sent(docs, shared, window, gram)
        w = s.words
        # answers in the order of the rows sent
        joined = lambda c, t: np.concatenate([np.zeros(0, dtype=t), *(np.frombuffer(x, dtype=t) for x in found.column(c).to_pylist())])
        row, count, earliest = joined("rows", np.int32), joined("counts", np.int32), joined("earliest", np.int64)
        begin = np.zeros(len(s.distinct), dtype=np.int64)
        begin[row] = np.cumsum(count, dtype=np.int64) - count
        n = s.n
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        away = earliest[np.repeat(begin[s.row], n) + step] < np.repeat(w.ids[s.doc], n)
        at = (np.repeat(s.start, n) + step)[away]
        edge = np.zeros(len(w.code) + 1, dtype=np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        gone = np.cumsum(edge[:-1]) > 0
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        inner = w.offsets[:-1][w.offsets[:-1] < len(gone)]
        begins[inner] = gone[inner]
        ends = gone.copy()
        ends[:-1] &= ~gone[1:] | begins[1:]
        lo, hi = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        doc = np.searchsorted(w.offsets, lo, side="right") - 1
        spans = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(w.ids))))).astype(np.int32)),
                                         pa.StructArray.from_arrays([pa.array(lo - w.offsets[doc]), pa.array(hi - w.offsets[doc])], names=["start", "end"]))
        total = np.concatenate(([0], np.cumsum(gone))).astype(np.int64)
        # words that stay, each but a document's first after a space
        stay = np.flatnonzero(~gone)
        size = np.diff(w.cuts)[stay]
        kept_before = (w.offsets - total[w.offsets]).astype(np.int64)
        lead = np.ones(len(stay), dtype=np.int64)
        lead[kept_before[:-1][np.diff(kept_before) > 0]] = 0
        letters = w.letters[np.repeat(~gone, np.diff(w.cuts))]
        cuts = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        letters = np.insert(letters, cuts[:-1][lead > 0], 32)
        ends_at = np.concatenate(([0], np.cumsum(size + lead))).astype(np.int64)
        kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(w.ids), [None, pa.py_buffer(ends_at[kept_before]), pa.py_buffer(letters)])
        return pa.table({"doc_id": pa.array(w.ids, mask=w.nulls), "n_words": np.diff(w.offsets).astype(np.int64), "n_removed": np.diff(total[w.offsets]), "spans": spans, "kept": kept.cast(pa.binary())})

    return run


def deduplicate(docs: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans of removed words and kept (the words that stay, UTF-8, joined
    by one space)."""
    docs, gram = keyed(docs, id_col, text_col), max(1, (window + 1) // 2)
    total = bytes_of(docs)
    blocks, shards, parts = (max(1, -(-total // size)) for size in (BLOCK_BYTES, SHARD_BYTES, 12 * PART_BYTES))
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
    placed = docs.withColumn("block", F.pmod(own, F.lit(blocks)).cast("int"))
    found = placed.groupBy("block").applyInArrow(_anchors(window, gram, parts), "part int, block int, anchors binary")
    shared = found.groupBy("part").applyInArrow(_shared(HOT), "block int, cold binary, hot binary")
    sent = placed.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(_passages(window, gram, shards), "shard int, block int, row int, least long, passage binary")
    answers = sent.groupBy("shard").applyInArrow(_search(window), "block int, rows binary, counts binary, earliest binary")
    none = [F.lit(None).cast("binary").alias(c) for c in ("rows", "counts", "earliest")]
    told = shared.select("block", "cold", "hot", *none).unionAll(answers.select("block", F.lit(None).cast("binary").alias("cold"), F.lit(None).cast("binary").alias("hot"), "rows", "counts", "earliest"))
    return placed.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_cut(window, gram), SCHEMA)
