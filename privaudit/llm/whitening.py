"""Embedding whitening by incremental eigendecomposition.

1. A partition keeps count, mean and the eigendecomposition of its scatter matrix, and adds vectors by centred rank-one
   updates: the new eigenvalues are the roots of the secular equation 1 + rho sum z_i^2 / (d_i - t) = 0, found between the
   old ones; small z and equal eigenvalues are deflated, and eigenvectors come from z as recomputed from the roots, which
   keeps them orthogonal. A block of vectors is first reduced to at most d rows of the same scatter (QR), then the shift of
   the mean is one more update; in blocks of one vector that shift is the textbook update per vector.
2. Spectra of partitions are combined in a tree: each eigenpair of one is a rank-one update of the other.
3. Rayleigh-Ritz refinement: with the combined eigenvectors as basis, one more scan adds up the projected covariance, which
   is nearly diagonal; its own eigenvectors correct the basis to the accuracy of the covariance itself.

Vectors are whitened as integers floor(scale * c) + shift, so count, sums and deviations are exact. Nothing but d by d
matrices (one per partition, combined by Spark) and the final one on the driver is gathered.

Null vectors and those with null or non-finite entries are left out. The number of dimensions is that of most vectors
(the larger of equals); others are left out as well. Null ids are carried along, repeated rows count and come back as
often; other columns are ignored; an empty table gives an empty result. Along a direction in which vectors do not vary
(eigenvalue 0) whitened is null, and identity_error is taken over the others. A deviation beyond a long is null; integers
are limited to 2^40 either way.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.llm.tables import finite_vectors, written

EPS = np.finfo(float).eps
#: Vectors reduced at once, spectra combined in one task, and vectors projected at once.
BLOCK_ROWS, FAN, CHUNK = 4096, 64, 1 << 13
LIMIT = 1 << 40
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> np.ndarray:
    """Matrix of d_i - t_j for the roots t_j of 1 + rho sum z_i^2 / (d_i - t), d ascending and distinct, no z zero.

    Each root is held as its distance from the nearer end of its interval, so that differences lose no digits. Steps fit the
    two poles beside the root ("middle way") and fall back to halving the bracket.
    """
    k, w = len(d), rho * z * z
    width = np.diff(np.append(d, d[-1] + w.sum()))
    at = d + width / 2
    f = 1 + (w / (d - at[:, None])).sum(axis=1)
    upper = f < 0
    upper[-1] = False
    origin = np.where(upper, np.append(d[1:], 0.0), d)
    delta = d - origin[:, None]
    lo, hi = np.where(upper, -width / 2, 0.0), np.where(upper, 0.0, width / 2)
    lo[-1], hi[-1] = 0.0, width[-1]
    t = (lo + hi) / 2
    below, i = np.tri(k, dtype=bool), np.arange(k)
    j = np.minimum(i + 1, k - 1)
    for _ in range(120):
        gap = delta - t[:, None]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            part = w / gap
            f = 1 + part.sum(axis=1)
            slope = part / gap
            lo, hi = np.where(f < 0, t, lo), np.where(f >= 0, t, hi)
            done = (np.abs(f) <= 4 * EPS * (1 + np.abs(part).sum(axis=1))) | (hi - lo <= 2 * EPS * np.abs(t))
            if done.all():
                break
            left, right = np.where(below, slope, 0).sum(axis=1), np.where(below, 0, slope).sum(axis=1)
            gi, gj = gap[i, i], gap[i, j]
            c, a, b = f - gi * left - gj * right, (gi + gj) * f - gi * gj * (left + right), gi * gj * f
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            one = f - left * gi  # beyond the last pole: a single pole
            step[-1] = gi[-1] + left[-1] * gi[-1] ** 2 / one[-1] if one[-1] > 0 else np.nan
            new = t + step
        bad = ~((new > lo) & (new < hi))
        new[bad] = ((lo + hi) / 2)[bad]
        t = np.where(done, t, new)
    return delta - t[:, None]


def rank_one(lam: np.ndarray, q: np.ndarray, v: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (ascending) and eigenvectors of q diag(lam) q' + rho v v'; rho > 0."""
    z = q.T @ v
    size = np.sqrt(z @ z)
    if not size or not rho:
        return lam, q
    rho, z = rho * size * size, z / size
    tol = 8 * EPS * max(np.abs(lam).max(), rho)
    lam, q = lam.copy(), q.copy()
    # deflation: no share in the update, or an eigenvalue so close to the one before that a rotation frees one of them
    last = -1
    for i in np.flatnonzero(rho * np.abs(z) > tol).tolist():
        if last >= 0:
            tau = np.hypot(z[i], z[last])
            c, s, apart = z[i] / tau, -z[last] / tau, lam[i] - lam[last]
            if abs(apart * c * s) <= tol:
                z[i], z[last] = tau, 0.0
                q[:, last], q[:, i] = c * q[:, last] + s * q[:, i], c * q[:, i] - s * q[:, last]
                lam[last], lam[i] = lam[last] * c * c + lam[i] * s * s, lam[last] * s * s + lam[i] * c * c
        last = i
    live = np.flatnonzero(rho * np.abs(z) > tol)
    live = live[np.argsort(lam[live], kind="stable")]
    d, zl = lam[live], z[live]
    if len(live) == 1:
        lam[live] = d + rho * zl * zl
    elif len(live):
        gap = secular_roots(d, zl, rho)  # row: root, column: old eigenvalue
        ratio = d[:, None] - d
        np.fill_diagonal(ratio, rho)
        exact = np.sqrt(np.abs(np.prod(-gap / ratio, axis=0))) * np.sign(zl)
        u = exact[:, None] / gap.T
        u /= np.sqrt((u * u).sum(axis=0))
        lam[live] = d - gap[np.arange(len(d)), np.arange(len(d))]
        q[:, live] = q[:, live] @ u
    order = np.argsort(lam, kind="stable")
    return lam[order], q[:, order]


class Spectrum:
    """Count, mean and eigendecomposition of the scatter about the mean."""

    def __init__(self, dims: int):
        self.n, self.mean, self.lam, self.q = 0.0, np.zeros(dims), np.zeros(dims), np.eye(dims)

    def update(self, n: float, mean: np.ndarray, rows: np.ndarray) -> None:
        """Add n vectors with this mean, whose scatter is that of ``rows``."""
        for r in rows:
            if r.any():
                self.lam, self.q = rank_one(self.lam, self.q, r)
        if self.n and n:
            self.lam, self.q = rank_one(self.lam, self.q, mean - self.mean, self.n * n / (self.n + n))
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n)) if n else self.mean
        self.n += n

    def add(self, x: np.ndarray) -> None:
        """Add the rows of ``x``."""
        if len(x):
            mean = x.mean(axis=0)
            rows = x - mean
            self.update(float(len(x)), mean, np.linalg.qr(rows, mode="r") if len(x) > 1 else rows[:0])

    def combine(self, other: Spectrum) -> None:
        self.update(other.n, other.mean, np.sqrt(np.maximum(other.lam, 0))[:, None] * other.q.T)

    def pack(self) -> bytes:
        return np.concatenate(([self.n], self.mean, self.lam, self.q.reshape(-1))).tobytes()

    @classmethod
    def unpack(cls, data: bytes, dims: int) -> Spectrum:
        x, out = np.frombuffer(data), cls(dims)
        out.n, out.mean, out.lam, out.q = float(x[0]), x[1: dims + 1], x[dims + 1: 2 * dims + 1], x[2 * dims + 1:].reshape(dims, dims)
        return out


def integers(batch: pa.RecordBatch, dims: int, scale: int, shift: int) -> np.ndarray:
    x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.clip(np.floor(scale * x), -LIMIT, LIMIT).astype(np.int64) + shift


def _gathered(parts: DataFrame, fold) -> bytes | None:
    """The one matrix that ``fold`` makes of the matrices (slot, data) of all partitions, FAN of them in a task at a time."""
    parts = written(parts, "whitening")
    top = parts.agg(F.max("slot")).first()[0]

    def run(rows):
        order = np.argsort(rows.column("slot").to_numpy(), kind="stable")
        body = rows.column("data").take(pa.array(order)).to_pylist()
        return pa.table({"slot": pa.array([rows.column("slot")[int(order[0])].as_py() // FAN], type=pa.int64()), "data": pa.array([fold(body)], type=pa.binary())})

    while top is not None and top > 0:
        parts, top = parts.groupBy(F.expr(f"slot div {FAN}")).applyInArrow(run, "slot long, data binary"), top // FAN
    rows = parts.collect()  # one row of d by d numbers
    return bytes(rows[0]["data"]) if rows else None


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, shift: int = 100_000, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per vector and component (1 is the largest): n, deviation (the sum over dimensions of (n x - S)^2), whitened,
    explained (share of the variance) and identity_error (largest entry of whitened's covariance minus the identity)."""
    spark = vectors.sparkSession
    finite = finite_vectors(vectors, id_col, vec_col)
    most = finite.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None or most["d"] < 1:
        return spark.createDataFrame([], SCHEMA)
    dims, n = most["d"], most["count"]
    usable = finite.where(F.size("v") == dims)
    placed = usable.select("vec_id", "v", F.spark_partition_id().cast("long").alias("slot"))

    def sums(batches):
        total = [0] * dims
        for b in batches:
            for c in range(0, b.num_rows, CHUNK):
                total = [a + int(s) for a, s in zip(total, integers(b.slice(c, CHUNK), dims, scale, shift).sum(axis=0))]
        yield pa.RecordBatch.from_pydict({"dim": pa.array(range(dims), type=pa.int32()), "s": pa.array([str(t) for t in total])})

    added = usable.mapInArrow(sums, "dim int, s string").groupBy("dim").agg(F.sum(F.col("s").cast("decimal(38, 0)")).alias("s")).collect()  # one row per dimension
    total = [int(s) for _, s in sorted((r["dim"], r["s"]) for r in added)]
    mean = np.array([s / n for s in total])

    def spectra(batches):
        own, held, slot = Spectrum(dims), [], None
        for b in batches:
            if b.num_rows:
                slot = b.column(2)[0].as_py()
                held.append(integers(b, dims, scale, shift).astype(float))
            if sum(map(len, held)) >= block_rows:
                x = np.concatenate(held)
                whole = len(x) - len(x) % block_rows
                for c in range(0, whole, block_rows):
                    own.add(x[c: c + block_rows])
                held = [x[whole:]]
        if held:
            own.add(np.concatenate(held))
        if own.n:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], type=pa.int64()), "data": pa.array([own.pack()], type=pa.binary())})

    def combined(body):
        out = Spectrum.unpack(body[0], dims)
        for x in body[1:]:
            out.combine(Spectrum.unpack(x, dims))
        return out.pack()

    basis = Spectrum.unpack(_gathered(placed.mapInArrow(spectra, "slot long, data binary"), combined), dims).q

    def centred(x):
        """x - S / n, of the exact numerator where it fits."""
        return (n * x - np.array(total)) / n if n < (1 << 20) and np.abs(x).max(initial=0) < (1 << 42) and max(map(abs, total)) < (1 << 62) else x - mean

    def projected(batches):
        gram, slot = np.zeros((dims, dims)), None
        for b in batches:
            for c in range(0, b.num_rows, CHUNK):
                slot = b.column(2)[0].as_py()
                p = centred(integers(b.slice(c, CHUNK), dims, scale, shift)) @ basis
                gram += p.T @ p
        if slot is not None:
            yield pa.RecordBatch.from_pydict({"slot": pa.array([slot], type=pa.int64()), "data": pa.array([gram.tobytes()], type=pa.binary())})

    gram = np.frombuffer(_gathered(placed.mapInArrow(projected, "slot long, data binary"), lambda body: sum(np.frombuffer(x) for x in body).tobytes())).reshape(dims, dims) / n
    lam, turn = np.linalg.eigh((gram + gram.T) / 2)
    top = np.argsort(-lam, kind="stable")[: min(components, dims)]
    trace, axes = max(float(np.trace(gram)), 0.0), basis @ turn[:, top]
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(top))] < 0, -1.0, 1.0)
    lam = np.maximum(lam[top], 0.0)
    live = lam > dims * EPS * 16 * trace
    onto = axes / np.sqrt(np.where(live, lam, 1.0))

    def spread(batches):
        g, s = np.zeros((len(top), len(top))), np.zeros(len(top))
        for b in batches:
            for c in range(0, b.num_rows, CHUNK):
                y = centred(integers(b.slice(c, CHUNK), dims, scale, shift)) @ onto
                g, s = g + y.T @ y, s + y.sum(axis=0)
        i, j = np.indices(g.shape).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.append(i, np.arange(len(top))), type=pa.int32()), "j": pa.array(np.append(j, np.full(len(top), -1)), type=pa.int32()), "x": pa.array(np.append(g.reshape(-1), s))})

    parts = {(r["i"], r["j"]): r["x"] for r in usable.mapInArrow(spread, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()}  # components squared
    ok = np.flatnonzero(live).tolist()
    error = max((abs(parts[i, j] / n - parts[i, -1] / n * parts[j, -1] / n - (i == j)) for i in ok for j in ok), default=None)

    def rows(batches):
        k = len(top)
        for b in batches:
            for c in range(0, b.num_rows, CHUNK):
                part = b.slice(c, CHUNK)
                x = integers(part, dims, scale, shift)
                rough = (((x - mean) * n) ** 2).sum(axis=1)
                exact = (n * x.astype(object) - np.array(total, dtype=object) if n > (1 << 20) or np.abs(x).max() >= (1 << 42) else n * x - np.array(total))
                with np.errstate(over="ignore"):
                    deviation = (exact * exact).sum(axis=1)
                fits = rough < 9.2e18
                m = part.num_rows
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1), m).astype(np.int32)), pa.array(np.full(m * k, n, dtype=np.int64)),
                    pa.array(np.repeat(np.where(fits, deviation, 0).astype(np.int64), k), mask=np.repeat(~fits, k)), pa.array((centred(x) @ onto).reshape(-1), mask=np.tile(~live, m)),
                    pa.array(np.tile(lam / trace, m) if trace else np.zeros(m * k), mask=np.full(m * k, not trace)), pa.array([error] * (m * k), type=pa.float64())], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return usable.mapInArrow(rows, SCHEMA)
