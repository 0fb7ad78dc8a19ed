"""Byte-level BPE: encoding by a segment tree over byte positions, decoding by a table of token bytes.

A text is cut by the tokenizer's pattern, and every piece is merged alone. The tree's leaf at a byte position holds the
rank of the pair of live tokens that starts there, together with the position, so the root is always the leftmost pair of
the smallest rank. A merge changes three leaves (the pair itself, the pair before it, the swallowed one) and their paths
to the root: n bytes take O(n log n), also where a text has no white space at all.

Null texts are empty: no ids, no bytes. Null ids decode to no bytes. Other columns of the input are ignored, rows come
back one for one, and an empty table gives an empty result. Whole texts are encoded.
"""

from __future__ import annotations

import base64
import re
import struct
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from privaudit.llm.tables import BATCH_BYTES, keyed, released

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces whose ids a worker remembers; when there are more, it starts anew.
CACHE_PIECES = 250_000
#: Latin letters, and what finds a character beyond them, ASCII and its white space.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
OTHER = re.compile(f"[^\\t-\\r -~{LETTERS}]").search
#: Bytes of a piece up to which many are merged at once (longer ones alone), and how many.
SHORT, TOGETHER = 64, 1 << 11
NONE = 1 << 62
#: Rank of no pair in the array form; ranks are below it.
FREE = (1 << 23) - 1

_coders: dict[bytes, Coder] = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from lines "base64 rank"."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of the tokens that byte-pair merges leave of ``piece``; for pieces of any length, one at a time."""
    n = len(piece)
    rank, shift = ranks.get, n.bit_length()
    size, low = 1 << (n - 1).bit_length(), (1 << shift) - 1
    tree = array("q", [NONE]) * (2 * size)
    for i in range(n - 1):
        r = rank(piece[i:i + 2])
        if r is not None:
            tree[size + i] = r << shift | i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    end, before = array("q", range(1, n + 1)), array("q", range(-1, n))
    while (best := tree[1]) != NONE:
        i = best & low
        j = end[i]
        e = end[j]
        end[i] = e
        before[e] = i
        r = rank(piece[i:end[e]]) if e < n else None
        changed = [(j, NONE), (i, NONE if r is None else r << shift | i)]
        p = before[i]
        if p >= 0:
            r = rank(piece[p:e])
            changed.append((p, NONE if r is None else r << shift | p))
        for k, value in changed:
            k += size
            tree[k] = value
            while k > 1:
                value = min(value, tree[k ^ 1])
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


class Merger:
    """The same merges for many short pieces at once: one segment tree per row of an array, one merge per row and step."""

    def __init__(self, ranks: dict[bytes, int]):
        self.base = max(ranks.values(), default=0) + 1
        self.byte = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
        pairs = {ranks[t[:i]] * self.base + ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int32)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs of tokens; FREE where there is none, or where a token is -1."""
        if not len(self.keys):
            return np.full(a.shape, FREE, dtype=np.int32)
        k = a.astype(np.int64) * self.base + b
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[at] == k) & (a >= 0) & (b >= 0), self.values[at], FREE)

    def __call__(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece; all of 1 to 64 bytes. Arrays are flat: row r of the tokens starts at r * width."""
        count, lengths = len(pieces), np.array([len(p) for p in pieces])
        size = 1 << max(1, (int(lengths.max()) - 1).bit_length())
        width, low = size + 1, np.int32(255)
        raw = np.frombuffer(b"".join([p.ljust(size, b"\0") for p in pieces]), dtype=np.uint8).reshape(-1, size)
        token = np.full((count, width), -1, dtype=np.int32)
        token[:, :size] = np.where(np.arange(size) < lengths[:, None], self.byte[raw], -1)
        tree = np.full((count, 2 * size), FREE << 8, dtype=np.int32)
        tree[:, size:] = (self.rank(token[:, :size], token[:, 1:]) << 8) | np.arange(size, dtype=np.int32)
        level = size
        while level > 1:
            level >>= 1
            np.minimum(tree[:, 2 * level: 4 * level: 2], tree[:, 2 * level + 1: 4 * level: 2], out=tree[:, level: 2 * level])
        after = np.tile(np.minimum(np.arange(1, width + 1), size), count)
        before = np.tile(np.arange(-1, size), count)
        token, tree = token.reshape(-1), tree.reshape(-1)
        rows = np.arange(count)
        while True:
            best = tree[rows * (2 * size) + 1]
            going = best < FREE << 8
            rows, best = rows[going], best[going]
            if not len(rows):
                break
            at, top = rows * width, rows * (2 * size)
            i = (best & low).astype(np.int64)
            j = after[at + i]
            e = after[at + j]
            p = before[at + i]
            merged = best >> 8
            token[at + i], token[at + j], after[at + i], before[at + e] = merged, -1, e, i
            first = p < 0
            q = np.where(first, i, p)
            tree[top + size + j] = (FREE << 8) | j
            tree[top + size + i] = (self.rank(merged, token[at + e]) << 8) | i
            left = (self.rank(token[at + q], merged) << 8) | q
            tree[top + size + q] = np.where(first, tree[top + size + i], left)
            i, j, q = i + size, j + size, q + size
            level = size
            while level > 1:  # the three leaves' paths, one level at a time
                level >>= 1
                i, j, q = i >> 1, j >> 1, q >> 1
                for node in (i, j, q):
                    child = top + 2 * node
                    tree[top + node] = np.minimum(tree[child], tree[child + 1])
        token = token.reshape(count, width)[:, :size]
        held = token >= 0
        ends = (np.cumsum(held.sum(axis=1)) * 4).tolist()
        packed = token[held].astype("<u4").tobytes()
        return [packed[x:y] for x, y in zip([0, *ends], ends)]


class Coder(dict):
    """Encoder and decoder of one vocabulary; as a dict it remembers the packed ids of pieces."""

    def __init__(self, data: bytes, pattern: str):
        super().__init__()
        self.ranks = read_ranks(data)
        # white space by the Unicode property: the regex module's own \s also takes the separators 1C to 1F
        self.any = regex.compile(pattern.replace(r"\S", r"\P{White_Space}").replace(r"\s", r"\p{White_Space}")).findall
        # the same for texts of Latin letters, ASCII and its white space alone, in the faster re module
        self.latin = re.compile(re.sub(r"(\[\^?)(.*?)\]", lambda m: m[1] + m[2].replace(r"\p{L}", LETTERS).replace(r"\p{N}", "0-9") + "]", pattern).replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", "[0-9]")).findall
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for t, r in self.ranks.items():
            self.tokens[r] = t

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        ids = merge(data, self.ranks) if whole is None else [whole]
        return struct.pack(f"<{len(ids)}I", *ids)

    @cached_property
    def merger(self) -> Merger:
        return Merger(self.ranks)  # decoding does without

    def split(self, text: str) -> list[str]:
        return (self.any if OTHER(text) else self.latin)(text)

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of the short ones of ``pieces``."""
        new = pieces.difference(self)
        if len(self) + len(new) > CACHE_PIECES:
            self.clear()
            new = pieces
        by_size: dict[int, list] = {}
        for piece in new:
            data = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(data)
            if whole is not None:
                self[piece] = struct.pack("<I", whole)
            elif len(data) <= SHORT:
                by_size.setdefault((len(data) - 1).bit_length(), []).append((piece, data))
        for group in by_size.values():
            for k in range(0, len(group), TOGETHER):
                part = group[k: k + TOGETHER]
                self.update(zip([p for p, _ in part], self.merger([d for _, d in part])))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.split(t) if t else [] for t in texts]
        self.learn(set().union(*split))
        return [b"".join(map(self.__getitem__, ps)) for ps in split]

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())) if ids else b""


def coder(data: bytes, pattern: str) -> Coder:
    """The worker's coder of a vocabulary; kept from task to task."""
    if data not in _coders:
        _coders[data] = Coder(data, pattern)
    return _coders[data]


def vocabulary(spark: SparkSession, path: str | None = None):
    """A broadcast of the vocabulary file: its size is fixed (under a megabyte) and executors need no copy of the file."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def pieces(batches, width: int):
    """Slices of Arrow batches of about BATCH_BYTES, so that long texts do not pile up in one output batch."""
    for b in batches:
        rows = max(1, int(b.num_rows * BATCH_BYTES / max(b.nbytes * width, 1)))
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids): the ids of each whole text, packed as little-endian unsigned 32-bit integers."""
    held = vocabulary(docs.sparkSession, path)

    def run(batches):
        c = coder(held.value, pattern)
        for b in pieces(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(c.encode(b.column(1).to_pylist()), type=pa.binary())], names=["doc_id", "ids"])

    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``encoded`` (doc_id, ids) with a column ``decoded``, the bytes of the ids."""
    held = vocabulary(encoded.sparkSession, path)

    def run(batches):
        c = coder(held.value, pattern)
        for b in pieces(batches, 2):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.decode(t.as_py()) for t in b.column(1)], type=pa.binary())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def round_trip(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids, decoded, same): encoded and decoded in one worker, and whether the bytes are those of the text."""
    held = vocabulary(docs.sparkSession, path)

    def run(batches):
        c = coder(held.value, pattern)
        for b in pieces(batches, 3):
            texts = b.column(1).to_pylist()
            ids = c.encode(texts)
            decoded = [c.decode(x) for x in ids]
            same = [d == (t or "").encode("utf-8", "surrogatepass") for d, t in zip(decoded, texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, type=pa.binary()), pa.array(decoded, type=pa.binary()), pa.array(same, type=pa.bool_())], names=["doc_id", "ids", "decoded", "same"])

    return keyed(docs, id_col, text_col).mapInArrow(released(run), "doc_id long, ids binary, decoded binary, same boolean")


def n_tokens() -> F.Column:
    return (F.octet_length("ids") / 4).cast("long")
