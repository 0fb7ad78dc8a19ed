"""The pipeline's near-duplicate stage against the Jaccard similarity of all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from privaudit.llm import jaccard, simhash, tables


def runs(text):
    w = (text or "").lower().split()
    return {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def survivors(rows):
    sets, root = [runs(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return sorted(min(r[0] for r, x in zip(rows, root) if x == k) for k in set(root))


@pytest.mark.parametrize("crowd,block", [(64, 4 << 20), (3, 600)])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, crowd, block):
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", block)
    monkeypatch.setattr(jaccard.candidate_pairs, "__defaults__", (crowd,))
    r = random.Random(1)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        base = r.choices(words, k=r.randint(20, 120))
        for edits in range(6):
            text = list(base)
            for _ in range(edits):
                text[r.randrange(len(text))] = r.choice(words)
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, "two words")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = corpus_pipeline.near_duplicates(spark, df, "")
    assert sorted(x["doc_id"] for x in got.collect()) == survivors(rows) and len(survivors(rows)) < 140


def test_documents_of_the_table_that_differ_in_few_words_go(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where(F.col("doc_id").isin(2, 56, 643, 770, 709, 944))
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [2, 643, 709]


def test_pairs_inside_a_crowd():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    base = r.choices(words, k=90)
    texts = [" ".join(base)]
    for k in range(300):  # near the base, but hardly near each other
        t = list(base)
        t[r.randrange(90)] = f"x{k}"
        texts.append(" ".join(t))
    common = r.choices(words, k=60)
    texts += [" ".join(r.choices(words, k=40) + common) for _ in range(60)] + ["", "two words", "two words"]  # share a passage, not similar
    for order in (texts, texts[::-1]):
        flat, offsets = jaccard.shingle_sets(order)
        pairs = list(jaccard.similar_pairs(flat, offsets, np.zeros(len(order)), 0.8))
        root = list(range(len(order)))
        for i, j in pairs:
            a, b = root[i], root[j]
            root = [a if x == b else x for x in root]
        assert len(order) - len(pairs) == len(set(root)) == len(survivors(list(enumerate(order))))


def test_shingle_sets_are_those_of_the_words():
    texts = [None, "", " \n", "A b", "a B", "one two three four five six one two three four five six", "É é x y z w", "tab\tis space\x0bas well " * 3]
    flat, offsets = jaccard.shingle_sets(texts)
    want = [runs("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\x0b", " ")) for t in texts]
    assert [b - a for a, b in zip(offsets[:-1], offsets[1:])] == [len(w) for w in want]
    assert list(flat[offsets[3]: offsets[4]]) == list(flat[offsets[4]: offsets[5]]) and (flat[offsets[5]: offsets[6]] == jaccard.shingles(texts[5])).all()


def test_rows_with_columns_of_the_stage_and_an_empty_table(spark):
    rows = [(1, "a b c d e f g " * 9, 1, 2), (2, "a b c d e f g " * 9, 3, 4), (2, "a b c d e f g " * 9, 3, 4), (None, "other words " * 90_000, 5, 6), (None, None, 7, 8), (3, "", 9, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `key` long, `row` long")
    got = jaccard.keep_one(df)
    assert got.columns == df.columns and sorted(r["key"] for r in got.collect()) == [1, 5, 9]
    twice = jaccard.keep_one(df.where("doc_id = 2"))
    assert [r["row"] for r in twice.collect()] == [4]
    assert jaccard.keep_one(df.limit(0)).collect() == []


def test_near_fingerprints_decide_too(spark):
    passage, rest = "terms of use apply here " * 100, [" ".join(f"{c}{i}" for i in range(9)) for c in "abc"]
    rows = [(3, passage + rest[0]), (1, passage + rest[1]), (2, rest[2]), (4, passage.upper() + rest[0]), (5, rest[2] + " x")]
    assert len(runs(rows[0][1]) & runs(rows[1][1])) < 0.4 * len(runs(rows[0][1]) | runs(rows[1][1]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.fingerprint(rows[0][1], 5) == simhash.fingerprint(rows[1][1], 5)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, df, "").collect()) == [1, 2]


def test_pairs_of_sets_that_are_linked_already():
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join(base), " ".join(base + ["x"]), " ".join(base + ["y"]), "two words"]
    flat, offsets = jaccard.shingle_sets(texts)
    assert len(list(jaccard.similar_pairs(flat, offsets, np.zeros(4), 0.8))) == 2
    assert len(list(jaccard.similar_pairs(flat, offsets, np.zeros(4), 0.8, np.array([5, 7, 5, 9])))) == 1
    assert list(jaccard.similar_pairs(flat, offsets, np.zeros(4), 0.8, np.array([5, 5, 5, 9]))) == []


def test_signatures_allow_all_similar_sets():
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for n in (0, 1, 3, 30, 190, 200, 390, 800, 2500):
        base = r.choices(words, k=n)
        for edits in (0, 1, n // 100, n // 40, n // 25):
            text = base[: n - r.randrange(1 + n // 9)]
            for _ in range(edits if text else 0):
                text[r.randrange(len(text))] = r.choice(words)
            texts.append(" ".join(text))
    texts.append("one word again " * 30_000 + " ".join(words))
    sets = [set(jaccard.shingles(t).tolist()) for t in texts]
    sigs = jaccard.signatures(*jaccard.shingle_sets(texts))
    i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    ok = jaccard.may_be_similar(sigs.take(i), sigs.take(j), 0.8)
    near = np.array([len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9 for a, b in zip(i, j)])
    assert ok[near].all() and near.sum() > 2 * len(texts) and ok.sum() < 1.5 * near.sum()


def test_texts_that_share_a_few_words_by_chance_are_no_candidates(spark, monkeypatch):
    picked = []

    def spied(df, name):
        out = tables.written(df, name)
        picked.extend(out.collect() if name == "jaccard-picked" else [])
        return out

    monkeypatch.setattr(jaccard, "written", spied)
    texts = [[f"t{k}x{i}" for i in range(80)] for k in range(120)]
    for a, b in zip(texts, texts[1:]):  # a chain: each text shares one run of words with the next
        a[60:66] = b[10:16]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(500, " ".join(texts[7] + ["more"])), (501, " ".join(texts[7])), (501, " ".join(texts[7]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert sorted(r["doc_id"] for r in jaccard.keep_one(df).collect()) == list(range(120))
    assert len(picked) == 2 and sum(r["size"] for r in picked) == len(rows[7][1]) + len(rows[120][1])
