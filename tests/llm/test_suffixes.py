import random

import numpy as np
import pytest

from privaudit.llm import suffixes


def brute(rows, length):
    """rows in document order: per row the bytes removed, runs and what stays."""
    texts = [(t or "").encode() for _, t in rows]
    seen, out = set(), []
    for b in texts:
        away = [False] * len(b)
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if s in seen:
                away[i:i + length] = [True] * length
            seen.add(s)
        runs = sum(x and (i == 0 or not away[i - 1]) for i, x in enumerate(away))
        out.append((len(b), sum(away), runs, bytes(c for c, x in zip(b, away) if not x)))
    return out


def compare(spark, rows, length):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffixes.deduplicate(df, length).collect())
    want = sorted((i is None, i or 0, *b) for (i, _), b in zip(rows, brute(rows, length)))
    assert got == want


def passages(seed, n, alphabet="abcé \n", common=6, size=60):
    r = random.Random(seed)
    word = lambda k: "".join(r.choice(alphabet) for _ in range(k))
    shared = [word(r.randint(10, size)) for _ in range(common)]
    return [(i, "".join(r.choice(shared) if r.random() < 0.4 else word(r.randint(1, 40)) for _ in range(r.randint(0, 8)))) for i in range(n)]


@pytest.fixture(params=[False, True], ids=["one bucket", "many buckets"])
def small(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(suffixes, "BLOCK_BYTES", 3000)
        monkeypatch.setattr(suffixes, "BUCKET_BYTES", 2000)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages(spark, small, seed):
    compare(spark, passages(seed, 80), 13)


def test_one_passage_in_most_documents(spark, small):
    r = random.Random(5)
    line = "the one line that a third of all documents share, word for word and more"
    compare(spark, [(i, f"{r.random()} {line} {r.random()}" * r.randint(1, 2)) for i in range(120)], 20)


def test_nulls_ties_and_periodic_texts(spark, small):
    rows = [(1, None), (2, ""), (3, "x" * 500), (4, "ab" * 200 + "x" * 40), (5, "short"), (6, "é" * 70), (6, "é" * 70), (6, "ü" + "é" * 70), (None, "y" * 50), (None, "y" * 60)]
    compare(spark, rows, 16)


def test_pieces_of_a_long_text(monkeypatch):
    r = random.Random(3)
    data = np.frombuffer(bytes(r.choice(b"abcd") for _ in range(5000)), dtype=np.uint8)
    offsets = np.array([0, 700, 700, 5000])
    whole = suffixes.anchors(data, offsets, 40)
    monkeypatch.setattr(suffixes, "PIECE", 333)
    cut = suffixes.anchors(data, offsets, 40)
    assert whole[2].sum() == cut[2].sum() == 661 + 4261
    spread = lambda a: dict(zip(np.concatenate([np.arange(s, s + n) for s, n in zip(a[1], a[2])]).tolist(), np.repeat(a[3], a[2]).tolist()))
    assert spread(whole) == spread(cut)


def test_multikey_sort_groups_equal_rows():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 3, (400, 5)).astype(np.uint64)
    order, group = suffixes.multikey_sort(w)
    rows = [tuple(x) for x in w[order].tolist()]
    assert rows == sorted(rows)
    assert all((group[i] == group[i - 1]) == (rows[i] == rows[i - 1]) for i in range(1, len(rows)))


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, block int")
    assert suffixes.deduplicate(empty).collect() == []
    assert suffixes.without_repeats(empty).collect() == []
    rows = [(1, "a passage that comes twice " * 1 + "and so on", 7, "p"), (2, "a passage that comes twice ", 8, "q"), (3, None, 9, "r")]
    df = spark.createDataFrame(rows, "doc_id long, text string, block int, kept string")
    got = sorted(suffixes.without_repeats(df, 20).collect())
    assert [(r["doc_id"], r["text"], r["block"], r["kept"]) for r in got] == [rows[0], rows[2]]
