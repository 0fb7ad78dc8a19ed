"""Nulls, empty and long texts, ties, repeated rows, empty tables and columns with the operators' own names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from privaudit.llm import bpe, decontaminate, hilbert, kneser, lengths, quality, simhash, suffixes, urls, warc
from privaudit.session import scratch_path
from tests.llm import brute
from tests.llm.test_jaccard import survivors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, fp long, block int, votes string, h long, shard int, gram string, `key` string, ids binary, kept boolean"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["the", "of", "and", "to", "is", "house", "river", "walked", "small", "green", "morning", "letter", "found", "under"]) for _ in range(n)) + "."


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "v", 4, 5, "g", "k", b"i", True) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    long = prose(9, 30_000)
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, prose(3, 80), "en", "s"), (4, prose(3, 80), "en", None), (5, prose(3, 80) + " end", None, "s"), (6, long, "en", "s"),
            (7, "\n \t\n", "fr", "s"), (8, "é" * 300, "fr", "t"), (9, "x" * 5000, "en", "s"), (10, prose(10, 60), "de", "s"), (10, prose(10, 60), "de", "s"), (None, prose(11, 70), "de", "s"),
            (None, None, None, None), (11, "0 \x00 \x1c   🙂 �", "en", "s"), (12, "*** ### $$$ " * 30, "en", "s")]
    return rows, frame(spark, rows).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def key(x):
    return tuple((v is None, v if v is not None else 0) for v in x)


def same(got, want):
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want), key=key)


def test_quality(odd, none):
    rows, df = odd
    got = quality.judge(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    same(got, [(r[0], *brute.base_features(r[1])) for r in rows])
    assert quality.judge(none).collect() == [] and quality.keep_good(none).collect() == []
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} <= {3, 4, 5, 6, 10, None}


def test_estimate_finds_the_unreliable_rule():
    rng = np.random.default_rng(4)
    counts = {}
    for _ in range(4000):
        bad = rng.random() < 0.2
        p = "".join("b" if rng.random() < (0.7 if bad else 0.004) else "-" if rng.random() < 0.1 else "g" for _ in range(4)) + ("b" if rng.random() < 0.009 else "g")
        counts[p] = counts.get(p, 0) + 1
    posterior, fire, good = quality.estimate(counts, 5)
    assert good == pytest.approx(0.8, abs=0.03) and fire[:4, 0] == pytest.approx(0.7, abs=0.06) and fire[4, 0] < 0.1
    assert posterior["bbggg"] < 0.1 and posterior["ggggg"] > 0.97
    assert quality.estimate({}, 5)[0] == {}


def test_bpe(odd, none):
    rows, df = odd
    enc = brute.tokenizer()
    got = bpe.decode(bpe.encode(df)).collect()
    same([(r["doc_id"], bytes(r["ids"]), bytes(r["decoded"])) for r in got], [(r[0], np.array(enc.encode_ordinary(r[1] or ""), dtype="<u4").tobytes(), (r[1] or "").encode()) for r in rows])
    assert bpe.decode(bpe.encode(none)).collect() == []


def test_bpe_equals_the_library_on_any_text():
    with open(brute.public_tokenizers.path(bpe.VOCABULARY), "rb") as f:
        c = bpe.Coder(f.read(), brute.public_tokenizers.PATTERN)
    enc, r = brute.tokenizer(), random.Random(2)
    texts = ["".join(r.choice("aAbetTh sthe  \n\t'sllvdé漢字🙂0123½Ⅷ!?|#\x85 \x1c") for _ in range(r.randint(0, 120))) for _ in range(400)]
    texts += ["a" * 3000, "ab" * 900 + " " * 700 + "x", "don't we'll I'VE", *("".join(chr(x) + " a" for x in range(k, k + 64)) for k in range(0, 0x3000, 64))]
    for t, ids in zip(texts, c.encode(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == enc.encode_ordinary(t) and c.decode(ids) == t.encode()
    for n in range(1, 70):  # both forms of the merges
        piece = bytes(r.choice(b"thea ing") for _ in range(n))
        assert np.frombuffer(c.merger([piece])[0], dtype="<u4").tolist() == bpe.merge(piece, c.ranks)


def test_url_filters(spark):
    import datetime as dt
    day = dt.date
    entries = spark.createDataFrame([
        ("hosts", "block", "add", "example.com", day(2024, 1, 5)), ("hosts", "block", "remove", "example.com", day(2024, 3, 1)), ("hosts", "block", "add", "example.com", day(2024, 5, 1)),
        ("ok", "allow", "add", "www.example.com/en", day(2024, 2, 1)), ("x", "block", "add", "twice.org", day(2024, 1, 1)), ("x", "block", "remove", "twice.org", day(2024, 1, 1)),
        ("hosts", "block", "add", None, day(2024, 1, 1)), ("hosts", "block", "add", "example.com", day(2024, 1, 9))], "list string, verdict string, action string, key string, day date")
    urls_ = [(1, "https://www.example.com/en/1", day(2024, 1, 4), "none"), (2, "https://www.example.com/en/1", day(2024, 1, 5), "block"), (3, "https://www.example.com/en/1?q#f", day(2024, 2, 1), "allow"),
             (4, "http://u@EXAMPLE.com:80", day(2024, 2, 29), "block"), (5, "http://example.com/", day(2024, 3, 1), "none"), (6, "http://example.com/", day(2024, 6, 1), "block"),
             (7, None, day(2024, 6, 1), "none"), (8, "http://example.com/", None, "none"), (9, "not a url", day(2024, 6, 1), "none"), (10, "http://twice.org/", day(2024, 1, 2), "none"),
             (11, "http://badexample.com/", day(2024, 6, 1), "none"), (6, "http://example.com/", day(2024, 6, 1), "block")]
    pages = spark.createDataFrame([(i, u, d, "l", "k") for i, u, d, _ in urls_], "page_id long, url string, day date, list string, key string")
    same([(r["page_id"], r["decision"]) for r in urls.decide(pages, entries).collect()], [(i, w) for i, _, _, w in urls_])
    assert urls.decide(pages.limit(0), entries).collect() == []
    assert {r["decision"] for r in urls.decide(pages, entries.limit(0)).collect()} == {"none"}


def test_a_later_entry_changes_the_verdict(spark):
    import datetime as dt
    entries = spark.createDataFrame([("l", v, a, k, dt.date(2024, m, 1)) for v, a, k, m in (
        ("block", "add", "b.com", 1), ("allow", "add", "b.com", 2), ("allow", "add", "b.com", 3), ("block", "add", "b.com", 4), ("allow", "remove", "b.com", 5), ("allow", "add", "b.com", 6),
        (None, "add", "c.com", 1), ("block", "add", "c.com", 2), ("allow", "add", "c.com", 2))], "list string, verdict string, action string, key string, day date")
    rows = [("b.com", m, w) for m, w in ((1, "block"), (2, "allow"), (3, "allow"), (4, "block"), (5, "none"), (6, "allow"))] + [("c.com", 1, "none"), ("c.com", 2, "block")]
    captures = spark.createDataFrame([(f"http://{k}/", dt.date(2024, m, 9), w, f"{k}{m}", "best") for k, m, w in rows], "url string, day date, decision string, __url string, `__best` string")
    got = urls.decide(captures, entries)
    assert got.columns == ["url", "day", "__url", "__best", "decision", "matched_list", "matched_key", "matched_since"]
    same([(r["__url"], r["decision"]) for r in got.collect()], [(f"{k}{m}", w) for k, m, w in rows])
    since = {r["__url"]: r["matched_since"].month for r in got.where("matched_since is not null").collect()}
    assert since["b.com3"] == 2 and since["b.com4"] == 4 and since["b.com6"] == 6


def test_warc(spark):
    rows = [(1, "u1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u3", None), (4, "u4\r\nX: y", ""), (5, "u5", "other"), (None, "u6", "<p>é</p>"), (None, "u7", "alone"), (2, "u8", "<p>é</p>")]
    pages = spark.createDataFrame([(*r, b"p", "h") for r in rows], "page_id long, url string, html string, payload binary, header string")
    folder = scratch_path(spark, "warc-test")
    warc.write_archive(pages, folder)
    got = warc.read_archive(spark, folder).select("page_id", "record_type", "refers_to", "payload_bytes").collect()
    same(got, [(1, "revisit", 2, 8 + 1), (2, "response", None, 9), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 5), (None, "revisit", 2, 9), (None, "response", None, 5), (2, "response", None, 9)])
    assert spark.read.parquet(f"{folder}/payloads").count() == 4
    for r in warc.records(spark, folder).where("page_id in (1, 5)").collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        length = int(head.rpartition(b"Content-Length: ")[2])
        assert rest[length:] == b"\r\n\r\n" and head.startswith(b"WARC/1.1\r\nWARC-Type: ")
        body = rest[:length].partition(b"\r\n\r\n")[2]
        assert body == (b"" if r["page_id"] == 1 else b"other") and bytes(r["payload"]) == ("<p>é</p>".encode() if r["page_id"] == 1 else b"other")
    # parsed from the records' bytes alone; line ends of a url cannot become header lines
    told = {r["page_id"]: (r["target_uri"], r["payload_digest"]) for r in warc.parsed(warc.records(spark, folder).select("record")).where("page_id <> 2").collect()}
    import base64
    import hashlib
    digest = lambda html: base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()
    assert told == {i: ((u or "").replace("\r", "%0D").replace("\n", "%0A"), digest(h)) for i, u, h in rows if i not in (2, None)}
    small = scratch_path(spark, "warc-test")
    warc.write_archive(pages, small, min_bytes=6)
    assert {r["page_id"] for r in warc.read_archive(spark, small).where("record_type = 'revisit'").collect()} == {1, None}
    empty = scratch_path(spark, "warc-test")
    warc.write_archive(pages.limit(0), empty)
    assert warc.read_archive(spark, empty).collect() == []


def test_kneser_ney_probabilities(spark, odd, none):
    import math
    from collections import Counter
    rows, df = odd
    train = [prose(k, 40) for k in range(12)]
    docs = frame(spark, [(i, t, "en", "s") for i, t in enumerate(train)] + [(100, "the *** zzz", "en", "s"), (101, None, None, "s"), (102, "", "en", "s")])
    ids = spark.createDataFrame([(i,) for i in range(12)], "doc_id long")
    n = kneser.ORDER

    def grams_of(t):
        t = kneser.START * (n - 1) + (t or "") + kneser.STOP
        return [t[i:i + n] for i in range(len(t) - n + 1)]

    counts = {n: Counter(g for t in train for g in grams_of(t))}
    seen = {n: set(counts[n]) | {g for t in ("the *** zzz", None, "") for g in grams_of(t)}}
    for k in range(n - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
        seen[k] = {g[1:] for g in seen[k + 1]}
    off = {k: kneser.discounts([sum(c == i for c in counts[k].values()) for i in (1, 2, 3, 4)]) for k in counts}
    cut = lambda k, c: 0.0 if c == 0 else off[k][min(c, 3) - 1]

    def prob(g):
        k = len(g)
        if k == 1:
            total = sum(counts[1].values())
            return max(counts[1][g] - cut(1, counts[1][g]), 0) / total + sum(cut(1, c) for c in counts[1].values()) / total / (len(counts[1]) + 1)
        below = [c for h, c in counts[k].items() if h[:-1] == g[:-1]]
        if not below:
            return prob(g[1:])
        return max(counts[k][g] - cut(k, counts[k][g]), 0) / sum(below) + sum(cut(k, c) for c in below) / sum(below) * prob(g[1:])

    for r in kneser.perplexities(docs, ids).where("doc_id in (0, 5, 100, 101, 102)").collect():
        gs = grams_of(docs.where(F.col("doc_id") == r["doc_id"]).first()["text"])
        assert r["perplexity"] == pytest.approx(math.exp(-sum(math.log(prob(g)) for g in gs) / len(gs)), rel=1e-9) and r["n_chars"] == len(gs) - 1
    labels = spark.createDataFrame([(r[0], 1) for r in rows], "doc_id long, quality int")
    same(kneser.classify(df, labels, F.col("quality") == 1).select("doc_id").collect(), [(r[0],) for r in rows])
    assert {r["kept"] for r in kneser.classify(df, labels.limit(0), F.col("quality") == 1).collect()} == {True}
    assert kneser.classify(none, labels, F.col("quality") == 1).collect() == []


def test_kneser_pieces_agree():
    texts = [prose(1, 300), None, "ab", "\0", prose(2, 50)]
    def counted(size):
        out = {}
        for strings, number, text in kneser.grams(list(texts), 4, size):
            for s, t in zip(strings[number].tolist(), text.tolist()):
                out[s, t] = out.get((s, t), 0) + 1
        return out
    assert counted(1 << 20) == counted(17)
    wide = ["".join(map(chr, range(0x4E00, 0x4E00 + 70_000 - 0x4E00))).replace("\ud800", "")[:20000]]
    assert sum(len(n) for _, n, _ in kneser.grams(["".join(c for c in wide[0] if not 0xD800 <= ord(c) < 0xE000)], 5)) > 15_000


def test_suffixes(odd):
    rows, df = odd
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    got = suffixes.deduplicate(df).collect()
    same([(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got], [(r[0], *b[:3]) for r, b in zip(ordered, brute.substring_dedup([r[1] for r in ordered]))])


def test_decontamination(spark, odd, none):
    _, df = odd
    item = prose(77, 25)
    edited = item[:40] + "X" + item[41:90] + item[92:]
    docs = frame(spark, [(1, f"start {item} end", "en", "s"), (2, prose(1, 40) + " " + edited.upper().replace(" ", "\n", 3) + " tail", "en", "s"), (3, prose(2, 4000) + item, "en", "s"), (4, prose(5, 200), "en", "s"),
                         (None, item, "en", "s"), (5, None, "en", "s"), (6, item + " " + item, "en", "s"), (1, f"start {item} end", "en", "s"), (7, item[: len(item) // 2], "en", "s")])
    bench = spark.createDataFrame([(9, item, "x"), (10, None, "x"), (11, "too short", "x"), (9, item, "x"), (None, prose(300, 30), "x")], "item_id long, text string, doc_id string")
    got = sorted(((r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.matches(docs, bench).collect()), key=key)
    assert got == sorted([(1, 9, 0), (1, 9, 0), (2, 9, 3), (3, 9, 0), (6, 9, 0), (6, 9, 0), (None, 9, 0)], key=key)
    same(decontaminate.without_leaks(docs, bench).select("doc_id").collect(), [(4,), (5,), (7,)])
    assert decontaminate.matches(none, bench).collect() == [] and decontaminate.matches(docs, bench.limit(0)).collect() == []
    assert decontaminate.matches(df, bench).collect() == []


def test_decontamination_in_blocks_of_the_benchmark(spark, monkeypatch):
    items = [prose(200 + k, 30) for k in range(8)]
    docs = frame(spark, [(k, prose(k, 50) + t + prose(k + 50, 20), "en", "s") for k, t in enumerate(items)])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {(k, k) for k in range(8)}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 700)
    monkeypatch.setattr(decontaminate, "PIECE", 500)
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.matches(docs, bench).collect()} == want


def test_token_counts(spark, odd, none):
    rows, df = odd
    enc = brute.tokenizer()
    n = [len(enc.encode_ordinary(r[1] or "")) for r in rows]
    table = lengths.limits(lengths.histogram(lengths.lengths(df))).cache()
    assert {r["n_tokens"]: r["n_docs"] for r in table.collect()} == {c: n.count(c) for c in n}
    for limit in (0, 1, 50, 1023, 1024, 5000, 10**6):
        assert tuple(lengths.at_limit(table, limit).first()) == (sum(x <= limit for x in n), sum(x > limit for x in n), sum(min(x, limit) for x in n))
    assert lengths.quantile(table, 0.5).first()["n_tokens"] == sorted(n)[-(-len(n) // 2) - 1]
    empty = lengths.limits(lengths.histogram(lengths.lengths(none)))
    assert empty.collect() == [] and tuple(lengths.at_limit(empty, 5).first()) == (0, 0, 0)


def test_simhash(odd, none):
    rows, df = odd
    got = simhash.near_duplicates(df).select("doc_id", "fingerprint", "component_id").collect()
    fps = [brute.fingerprint(r[1]) for r in rows]
    root = brute.linked(list(enumerate(fps)))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    same(got, [(r[0], f"{f:016x}", least.get(root[i])) for i, (r, f) in enumerate(zip(rows, fps))])
    assert simhash.near_duplicates(none).collect() == []
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns and kept.groupBy("doc_id").count().where("count > 1").count() == 0
    assert {r["doc_id"] for r in kept.collect()} == {m for m in least.values()} | ({None} if any(root[i] not in least for i in range(len(rows))) else set())


@pytest.mark.parametrize("subtree", [5, 40, 10**6])
def test_trie_links_in_any_cut(spark, subtree):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = base[:40] ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64))
    crowd = base[0] ^ (np.uint64(1) << np.arange(50, dtype=np.uint64))  # many under one prefix
    a = np.unique(np.concatenate((base, near, crowd, np.array([0, 2**64 - 1], dtype=np.uint64))))
    fps = spark.createDataFrame([(int(x),) for x in a.view(np.int64)], "fp long")
    root = brute.linked(list(enumerate(a.tolist())))
    parent = {int(x): int(x) for x in a.view(np.int64)}
    from privaudit.llm.tables import components
    for r in components(simhash.links(fps, 3, subtree)).collect():
        parent[r["node"]] = r["root"]
    groups = {}
    for i, x in enumerate(a.view(np.int64).tolist()):
        groups.setdefault(parent[x], set()).add(root[i])
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(root.values()))


def test_components_of_a_chain_and_a_star(spark):
    from privaudit.llm.tables import components
    edges = [(i, i + 1) for i in range(10, 60)] + [(100, k) for k in range(200, 240)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 10 for i in range(11, 61)}, **{k: 100 for k in range(200, 240)}}


def test_hilbert(spark, odd, none):
    rows, df = odd
    got = hilbert.assign(df).collect()
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in got], [(r[0], len((r[1] or "").encode()) + 1, brute.crc(r[1])) for r in rows])
    sizes = [sorted(r["slot"] for r in got if r["shard"] == s) for s in range(8)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    assert hilbert.assign(none).collect() == []
    # a cell of very many rows is cut into more slices; ranks stay gapless and go along the curve
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"), F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).alias("source"), F.lit("en").alias("lang"))
    cut = sorted((r["shard"], r["slot"], r["h"]) for r in hilbert.assign(many, slice_rows=10).collect())
    assert [(s, k) for s, k, _ in cut] == [(s, k) for s in range(8) for k in range(375)] and [h for *_, h in cut] == sorted(h for *_, h in cut)


@pytest.mark.parametrize("dims,bits", [(2, 1), (2, 4), (3, 3), (3, 4)])
def test_hilbert_curve_visits_neighbours(spark, dims, bits):
    at = {r["h"]: r["cell"] for r in hilbert.curve(spark, dims, bits).collect()}
    assert sorted(at) == list(range(1 << (dims * bits)))
    point = lambda c: [c >> (bits * d) & ((1 << bits) - 1) for d in range(dims)]
    assert all(sum(abs(x - y) for x, y in zip(point(at[h]), point(at[h + 1]))) == 1 for h in range(len(at) - 1))


def test_write_shards(spark, odd):
    _, df = odd
    path = scratch_path(spark, "shards")
    docs = df.where("doc_id is not null").dropDuplicates(["doc_id"]).withColumns({"shard": F.lit("x"), "__id": F.lit("y"), "slot": F.lit(-1)})
    hilbert.write_shards(docs, path)
    got = spark.read.parquet(path)
    assert got.groupBy("shard").count().count() == 8 and set(got.columns) == set(docs.columns)
    assert got.where("`__id` = 'y' and slot = -1").count() == docs.count()


def test_pipeline(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in brute.rows(spark, sf, "documents")}
    items = [i["text"] for i in brute.rows(spark, sf, "benchmark")]
    kept = {r["doc_id"] for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).where("kept").collect()}
    one = survivors([(i, docs[i]) for i in sorted(kept)])
    cut = {i: b[3].decode("utf-8", "ignore") for i, b in zip(one, brute.substring_dedup([docs[i] for i in one])) if b[3]}
    clean = {i: t for i, t in cut.items() if not any(x in t for x in items)}
    enc = brute.tokenizer()
    rows = corpus_pipeline.run(spark, sf).collect()
    assert all(r["round_trip"] for r in rows)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in rows}
    want = {}
    for i, t in clean.items():
        ids = enc.encode_ordinary(t)
        want[i] = (len(ids), brute.sha(np.array(ids, dtype="<u4").tobytes()), brute.sha(t.encode()))
    assert got == want
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).columns == spark.read.parquet(f"{sf}/documents.parquet").columns


def test_stages_keep_columns_with_names_of_their_own(spark):
    text = prose(3, 80)
    df = spark.createDataFrame([(1, text, "k", 1, "v", 2.0), (2, "!!", "k", 1, "v", 2.0)], "doc_id long, text string, `__key` string, `row` long, votes string, posterior double")
    assert [tuple(r) for r in quality.keep_good(df).collect()] == [(1, text, "k", 1, "v", 2.0)]
    item = spark.createDataFrame([(1, text[:90])], "item_id long, text string")
    out = decontaminate.without_leaks(df, item)
    assert out.columns == df.columns and [r["doc_id"] for r in out.collect()] == [2]
