"""Plain single-machine versions of what the contracts of the operators ask for."""

import hashlib
import re
import zlib
from collections import Counter

import public_tokenizers
import tiktoken
import xxhash

from privaudit.llm.bpe import VOCABULARY, read_ranks

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(spark, sf, name):
    return [r.asDict() for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]


def base_features(text):
    text = text or ""
    words = WORD.findall(text)
    lines, seen, doubles = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            doubles += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count, twice = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            twice.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), doubles, len(twice)


def tokenizer():
    with open(public_tokenizers.path(VOCABULARY), "rb") as f:
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(f.read()), special_tokens={})


def sha(data):
    return hashlib.sha256(data).hexdigest()


def fingerprint(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(text)
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(fps, bits=3):
    """Smallest id reachable for (id, fingerprint) pairs."""
    root = {i: i for i, _ in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for k, (i, a) in enumerate(fps):
        for j, b in fps[:k]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in fps}


def crc(text):
    return zlib.crc32((text or "").encode())


def edit_matches(item, text, limit):
    """Whether ``item`` occurs in ``text`` with at most ``limit`` edits (case and kind of white space aside)."""
    item, text = (re.sub(r"\s", " ", s.lower()) for s in (item, text))
    prev = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        cur = [i]
        for j, b in enumerate(text, 1):
            cur.append(min(prev[j - 1] + (a != b), prev[j] + 1, cur[j - 1] + 1))
        prev = cur
    return min(prev) <= limit


def substring_dedup(texts, length=100):
    """Per text, in order: (bytes, removed, runs, what stays)."""
    seen, out = set(), []
    for b in [(t or "").encode() for t in texts]:
        away = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if s in seen:
                away[i:i + length] = b"\1" * length
            seen.add(s)
        runs = sum(x and (i == 0 or not away[i - 1]) for i, x in enumerate(away))
        out.append((len(b), sum(away), runs, bytes(c for c, x in zip(b, away) if not x)))
    return out
