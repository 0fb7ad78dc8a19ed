"""The FM-index operator against all windows in a dictionary."""

import random

import numpy as np
import pytest

from privaudit.llm import fmindex
from privaudit.llm.queries import QUERIES
from tests.llm import brute

SCHEMA = "doc_id long, text string, block int, shard int, least long, part int"


def plain(rows, window=13):
    """Per row: words, removed, spans, kept."""
    docs = [(fmindex.LAST if i is None else i, brute.WORD.findall(t or "")) for i, t in rows]
    least = {}
    for i, w in docs:
        for k in range(len(w) - window + 1):
            s = tuple(w[k:k + window])
            least[s] = min(least.get(s, i), i)
    out = []
    for (i, w), (raw, _) in zip(docs, rows):
        away = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k:k + window])] < i:
                away[k:k + window] = [True] * window
        spans = []
        for k, x in enumerate(away):
            if x and (k == 0 or not away[k - 1]):
                spans.append([k, k])
            if x:
                spans[-1][1] = k + 1
        out.append((raw, len(w), sum(away), spans, " ".join(x for x, y in zip(w, away) if not y).encode()))
    return out


def same(df, rows, window=13):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = [(r["doc_id"], r["n_words"], r["n_removed"], [[s["start"], s["end"]] for s in r["spans"]], bytes(r["kept"])) for r in fmindex.deduplicate(df, window).collect()]
    assert sorted(got, key=key) == sorted(plain(rows, window), key=key)


def test_whole_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in brute.rows(spark, "/root/testdata/sf0.01", "documents")]
    want = {i: (n, gone, brute.sha(kept)) for i, n, gone, _, kept in plain(rows)}
    assert sum(gone for _, gone, _ in want.values()) > 1000
    assert {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op13_fm_index"](spark, "/root/testdata/sf0.01").collect()} == want


@pytest.mark.parametrize("hot,block,shard", [(64, 1 << 22, 1 << 22), (1, 4000, 3000), (3, 1500, 10_000)])
def test_cuts_do_not_matter(spark, monkeypatch, hot, block, shard):
    r = random.Random(5)
    vocabulary = [f"w{k}é" if k % 7 == 0 else f"w{k}" for k in range(30)]
    passages = [[r.choice(vocabulary) for _ in range(r.choice((12, 13, 14, 40)))] for _ in range(12)]
    rows = []
    for k in range(120):
        words = []
        for _ in range(r.randint(0, 6)):
            words += r.choice(passages) if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randint(1, 25))]
        rows.append((r.choice((k, k, k, 3, None)), r.choice((" ", "\n", " \t")).join(words)))
    rows += [(200 + k, " ".join(passages[0] + [f"own{k}"])) for k in range(30)] + [(300, " ".join(passages[3] * 50)), (301, None), (302, ""), (303, " \n "), (None, None)]
    for name, value in (("HOT", hot), ("BLOCK_BYTES", block), ("SHARD_BYTES", shard), ("PIECE", 100), ("PART_BYTES", 1000)):
        monkeypatch.setattr(fmindex, name, value)
    df = spark.createDataFrame([(*x, 1, 2, 3, 4) for x in rows], SCHEMA)
    same(df, rows)
    same(df, rows, 2)
    same(df.limit(0), [])


def test_long_text_and_repeated_rows(spark):
    r = random.Random(1)
    long = " ".join(r.choice("ab") + str(r.randint(0, 5000)) for _ in range(120_000))
    rows = [(1, long), (2, "x " + long[5000:9000]), (2, "x " + long[5000:9000]), (3, "same " * 4000), (4, "same " * 20), (5, "same " * 12), (6, "a\x00b \x1c c d " * 13)]
    same(spark.createDataFrame([(*x, 1, 2, 3, 4) for x in rows], SCHEMA), rows)


def test_index_finds_what_is_there_and_nothing_else():
    r = np.random.default_rng(2)
    text = r.integers(1, 6, 400)
    text[::23] = 0
    doc = np.repeat(np.arange(len(text) // 20 + 1), 20)[: len(text)]
    index = fmindex.FMIndex(text, doc, 4)
    query = np.append(r.integers(1, 8, 300), 0)  # 6 and 7 are not indexed
    matched, earliest = index.statistics(query, np.array([0]), np.array([300]))
    windows = {}
    for k in range(len(text) - 3):
        windows.setdefault(tuple(text[k:k + 4]), []).append(doc[k])
    for k in range(297):
        want = windows.get(tuple(query[k:k + 4]))
        assert (earliest[k] if matched[k] == 4 else None) == (min(want) if want else None)
        assert matched[k] == max(m for m in range(5) if m == 0 or any((text[j:j + m] == query[k:k + m]).all() for j in range(len(text) - m + 1)))
