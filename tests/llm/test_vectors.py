"""Centroid clustering and whitening against plain versions."""

import hashlib

import numpy as np
import pytest

from privaudit.llm import centroids, whitening
from privaudit.llm.queries import QUERIES
from tests.llm import brute

SCHEMA = "vec_id long, embedding array<float>, cluster int, v string, slot long, h string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", 2, "h") for i, v in rows], SCHEMA)


def lloyd(rows, k, rounds, dims, scale=64):
    """Plain Lloyd rounds; rows: (id, integer components)."""
    drawn = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in rows)[:k]
    c = [list(v) for _, v in drawn]
    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, m)), n) for n, m in enumerate(c))
    for _ in range(rounds):
        of = [near(v)[1] for _, v in rows]
        c = [[sum(col) // len(col) for col in zip(*own)] if (own := [v for (_, v), n in zip(rows, of) if n == k_]) else m for k_, m in enumerate(c)]
    out = [(i, *near(v)[::-1]) for i, v in rows]
    total = {n: sum(d for _, m, d in out if m == n) for n in range(k)}
    return [(i, n, d, total[n], sum(total.values()), tuple(c[n])) for i, n, d in out]


def usable(rows, dims):
    return [(i, tuple(int(np.floor(64 * float(np.float32(x)))) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]


def test_clustering_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in brute.rows(spark, "/root/testdata/sf0.001", "embeddings")]
    want = [(i, n, d, t, s, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, n, d, t, s, c in lloyd(usable(rows, 64), 16, 3, 64)]
    assert sorted(map(tuple, QUERIES["op11_centroid_clustering"](spark, "/root/testdata/sf0.001").collect())) == sorted(want)


def test_clustering_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 0.0]), (2, [0.5, 0.5]), (3, [0.5, 0.5]), (3, [0.5, 0.5]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, None), (7, [1.0]), (8, [None, 1.0]), (None, [9.0, -9.0]), (9, [-3.25, 7.7]), (10, [2.0, 2.0, 2.0]), (11, [])]
    for k in (1, 2, 3, 20):
        got = centroids.cluster(frame(spark, rows), k=k, dims=2).collect()
        want = lloyd(usable(rows, 2), min(k, 6), 3, 2)
        assert sorted(((r[0] is None, *(x for x in r[:5] if x is not None), tuple(r[5])) for r in got)) == sorted(((w[0] is None, *(x for x in w if x is not None)) for w in want))
    assert centroids.cluster(frame(spark, []), dims=2).collect() == []
    assert centroids.cluster(frame(spark, rows[6:7]), dims=2).collect() == []
    far = centroids.cluster(frame(spark, [(1, [3e38, -3e38]), (2, [0.0, 0.0])]), k=1, rounds=0, dims=2).collect()
    assert {r["vec_id"] for r in far} == {1, 2} and all(r["distance"] >= 0 for r in far)


@pytest.mark.parametrize("dims,k", [(64, 16), (3, 40), (1, 5)])
def test_search_finds_the_nearest_and_skips_most(dims, k):
    rng = np.random.default_rng(7)
    c = rng.integers(-40, 40, (k, dims))
    c[k // 2] = c[1]  # a tie
    x = np.concatenate((c + rng.integers(-3, 4, (k, dims)), rng.integers(-60, 60, (300, dims)), c))
    number, distance, measured = centroids.Search(c).nearest(x)
    d = ((x[:, None] - c) ** 2).sum(axis=2)
    assert (number == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()
    assert measured < d.size * (0.95 if dims == 64 else 0.6)
    assert len(centroids.Search(c).nearest(x[:0])[0]) == 0


def whitened(rows, components=8):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in v] for _, v in rows])
    n, s = len(x), x.sum(axis=0)
    m = (n * x - s) / n
    lam, q = np.linalg.eigh(m.T @ m / n)
    lam, q = lam[::-1], q[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), m @ q[:, :components], lam[:components], lam.sum()


def test_whitening_of_the_table(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in brute.rows(spark, "/root/testdata/sf0.001", "embeddings")]
    n, deviation, projected, lam, trace = whitened(rows)
    got = QUERIES["op12_embedding_whitening"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 8 * n and len({(r["vec_id"], r["component"]) for r in got}) == 8 * n
    place, sign = {i: k for k, (i, _) in enumerate(rows)}, {}
    for r in got:
        i, c = place[r["vec_id"]], r["component"] - 1
        want = projected[i, c] / np.sqrt(lam[c])
        sign.setdefault(c, 1 if r["whitened"] * want > 0 else -1)
        assert r["whitened"] == pytest.approx(sign[c] * want, abs=1e-9)
        assert (r["n"], r["deviation"]) == (n, deviation[i]) and r["explained"] == pytest.approx(lam[c] / trace, rel=1e-10) and r["identity_error"] < 1e-9


@pytest.mark.parametrize("block_rows", [1, 7, 4096])
def test_rank_one_updates_give_the_spectrum(block_rows):
    rng = np.random.default_rng(3)
    x = rng.integers(-500, 500, (150, 12)).astype(float) + 1e5
    x[:, 3], x[:, 5], x[40:60] = x[:, 4], 7.0, x[40]  # equal and constant dimensions, repeated rows
    parts = [whitening.Spectrum(12) for _ in range(3)]
    for p, own in zip(parts, np.array_split(x, 3)):
        for c in range(0, len(own), block_rows):
            p.add(own[c: c + block_rows])
    parts[0].combine(whitening.Spectrum.unpack(parts[1].pack(), 12))
    parts[0].combine(parts[2])
    s, centred = parts[0], x - x.mean(axis=0)
    size = np.linalg.norm(centred) ** 2
    assert s.n == 150 and s.mean == pytest.approx(x.mean(axis=0))
    assert abs((s.q * s.lam) @ s.q.T - centred.T @ centred).max() < 1e-12 * size and abs(s.q.T @ s.q - np.eye(12)).max() < 1e-12
    assert abs(s.lam - np.linalg.eigvalsh(centred.T @ centred)).max() < 1e-12 * size


def test_whitening_edges(spark, monkeypatch):
    nan = float("nan")
    rows = [(1, [0.1, 0.2, 0.3]), (2, [0.4, 0.2, -0.3]), (2, [0.4, 0.2, -0.3]), (None, [0.9, 0.2, 0.0]), (3, None), (4, [nan, 0.0, 0.0]), (5, [None, 0.0, 0.0]), (6, [1.0, 2.0])]
    monkeypatch.setattr(whitening, "FAN", 2)
    got = whitening.whiten(frame(spark, rows).repartition(5)).collect()
    n, deviation, projected, lam, trace = whitened([rows[k] for k in (0, 1, 2, 3)], 3)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in got) == sorted((i is None, i or 0, c) for i in (1, 2, 2, None) for c in (1, 2, 3))
    assert {r["component"] for r in got if r["whitened"] is None} == {3} and max(r["identity_error"] for r in got) < 1e-9
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(rows[k][0], int(deviation[k])) for k in (0, 1, 3)}
    assert whitening.whiten(frame(spark, [])).collect() == [] and whitening.whiten(frame(spark, rows[4:7])).collect() == []
    alone = whitening.whiten(frame(spark, [(1, [0.1, 0.2])])).collect()
    assert [(r["whitened"], r["deviation"], r["identity_error"]) for r in alone] == [(None, 0, None)] * 2
    same = whitening.whiten(frame(spark, [(k, [0.5, 0.5]) for k in range(9)])).collect()
    assert len(same) == 18 and {r["whitened"] for r in same} == {None}
