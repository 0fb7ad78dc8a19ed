"""The registered queries on the smallest tables against the plain versions."""

import numpy as np
import pytest

import __spark_entry__ as entry
from tests.llm import brute

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return sorted(brute.rows(spark, DATA, "documents"), key=lambda r: r["doc_id"])


def got(spark, name):
    return [r.asDict() for r in entry.queries()[name](spark, DATA).collect()]


def by_id(rows, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in rows}


def test_quality_rules(spark, docs):
    rows = got(spark, "op1_quality_rules")
    want = {r["doc_id"]: brute.base_features(r["text"]) for r in docs}
    assert by_id(rows, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words") == want and len(rows) == len(docs)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)
    label = {r["doc_id"]: r["quality"] for r in brute.rows(spark, DATA, "labels")}
    judged = [(label[r["doc_id"]], r["kept"]) for r in rows if r["doc_id"] in label and not r["base_failed"]]
    assert all(k for q, k in judged if q == 1) and not any(k for q, k in judged if q == 0)


def test_byte_bpe(spark, docs):
    enc, want = brute.tokenizer(), {}
    for r in docs:
        ids = enc.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), brute.sha(np.array(ids, dtype="<u4").tobytes()), brute.sha((r["text"] or "").encode()))
    assert by_id(got(spark, "op2_byte_bpe"), "n_tokens", "ids_sha256", "decoded_sha256") == want


def test_suffix_array(spark, docs):
    want = {r["doc_id"]: (*b[:3], brute.sha(b[3])) for r, b in zip(docs, brute.substring_dedup([r["text"] for r in docs]))}
    assert by_id(got(spark, "op6_suffix_array"), "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_decontamination(spark, docs):
    items = brute.rows(spark, DATA, "benchmark")
    rows = got(spark, "op7_qgram_decontamination")
    exact = {(r["doc_id"], i["item_id"]) for r in docs for i in items if i["text"] in (r["text"] or "")}
    assert exact and exact == {(r["doc_id"], r["item_id"]) for r in rows if r["distance"] == 0}
    text = {r["doc_id"]: r["text"] for r in docs}
    passage = {i["item_id"]: i["text"] for i in items}
    for r in rows:
        assert brute.edit_matches(passage[r["item_id"]], text[r["doc_id"]][r["start"]:r["end"]], 0.06 * len(passage[r["item_id"]]))


def test_token_counts(spark, docs):
    enc = brute.tokenizer()
    n = [len(enc.encode_ordinary(r["text"] or "")) for r in docs]
    rows = got(spark, "op8_token_counts")
    assert sorted(r["n_tokens"] for r in rows) == sorted(set(n))
    for r in rows:
        c = r["n_tokens"]
        assert (r["n_docs"], r["docs_fit"], r["docs_longer"]) == (n.count(c), sum(x <= c for x in n), sum(x > c for x in n))
        assert (r["tokens_total"], r["tokens_fit"], r["tokens_truncated"]) == (sum(n), sum(x for x in n if x <= c), sum(min(x, c) for x in n))
        assert r["quantile"] == pytest.approx(r["docs_fit"] / len(n))


def test_simhash(spark, docs):
    fps = [(r["doc_id"], brute.fingerprint(r["text"])) for r in docs]
    roots = brute.linked(fps)
    assert by_id(got(spark, "op9_simhash_trie"), "fingerprint", "component_id") == {i: (f"{f:016x}", roots[i]) for i, f in fps}


def test_hilbert_sharding(spark, docs):
    rows = got(spark, "op10_hilbert_sharding")
    assert by_id(rows, "size", "text_crc32") == {r["doc_id"]: (len((r["text"] or "").encode()) + 1, brute.crc(r["text"])) for r in docs}
    slots = [sorted(r["slot"] for r in rows if r["shard"] == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in slots) and max(map(len, slots)) - min(map(len, slots)) <= 1 and sum(map(len, slots)) == len(docs)
    order = [r["h"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    assert order == sorted(order) and {r["law"] for r in rows} == {"rows"} and {r["grown_shard"] for r in rows} == {None}


def test_kneser_ney(spark, docs):
    rows = got(spark, "op5_kneser_ney")
    assert len(rows) == len(docs)
    label = {r["doc_id"]: r for r in brute.rows(spark, DATA, "labels")}
    clean = [r["kept"] for r in rows if r["doc_id"] in label and label[r["doc_id"]]["quality"] == 1]
    assert np.mean(clean) > 0.9
