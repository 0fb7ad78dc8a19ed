"""Centroid clustering by equal-average equal-variance search: Lloyd rounds on integer vectors whose nearest centroid is
found without measuring the distance to all of them.

Centroids are sorted by the mean of their components. A vector looks its mean up in that order and scans outward, always
taking the side whose mean is closer. With d components, means m and deviations s (s^2: the sum of squares about the mean),

    |x - c|^2 >= d (m_x - m_c)^2                     (equal average: ends the scan, as means only get farther)
    |x - c|^2 >= d (m_x - m_c)^2 + (s_x - s_c)^2     (equal variance: skips one centroid)

What neither rejects is measured in integers, so distances and ties are exact. Bounds are floating-point numbers lowered
by more than their rounding error.

Spark has the vectors: a round is one scan in which every partition assigns its vectors and returns a sum per centroid and
component; these are added by Spark, and the driver holds k centroids, never vectors. The input is scanned once per round
and not stored, so ``vectors`` should be a table, not a costly plan.

Vectors that are null, have another number of components, or hold null or non-finite entries are left out. A null id is
carried along; repeated rows are vectors of their own; fewer vectors than k give fewer centroids; an empty table gives an
empty result; other columns are ignored. Integers beyond LIMIT either way are set to it, so that distances fit a long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privaudit.llm.tables import finite_vectors, written

#: Largest size of a component: (2 * LIMIT)^2 * 64 is below 2^63.
LIMIT = 1 << 27
FAR = np.iinfo(np.int64).max
SCHEMA = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>"


def integers(batch: pa.RecordBatch, dims: int, scale: int) -> np.ndarray:
    """floor(scale * x) of the vectors of a batch (vec_id, v) as rows."""
    column = batch.column(1)
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.clip(np.floor(scale * x), -LIMIT, LIMIT).astype(np.int64)


class Search:
    """Centroids in the order of their means."""

    def __init__(self, centroids: np.ndarray):
        order = np.argsort(centroids.sum(axis=1), kind="stable")
        self.number, self.at = order.astype(np.int64), centroids[order]
        self.mean, self.dev = self.moments(self.at)

    @staticmethod
    def moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean = x.sum(axis=1) / x.shape[1]
        return mean, np.sqrt(((x - mean[:, None]) ** 2).sum(axis=1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Number of the nearest centroid (smallest of equals) and squared distance of each row, and distances measured."""
        k, (n, dims) = len(self.at), x.shape
        mean, dev = self.moments(x) if n else (np.zeros(0),) * 2
        right = np.searchsorted(self.mean, mean)
        left = right - 1
        best, who, measured = np.full(n, FAR), np.full(n, k), 0
        scan = np.arange(n)
        while len(scan):
            a, b, m = left[scan], right[scan], mean[scan]
            below = np.where(a >= 0, m - self.mean[np.maximum(a, 0)], np.inf)
            above = np.where(b < k, self.mean[np.minimum(b, k - 1)] - m, np.inf)
            lower = below <= above
            gap, c = np.where(lower, below, above), np.where(lower, a, b)
            # the means alone: nothing farther out can be nearer
            ends = ~np.isfinite(gap)
            c = np.clip(c, 0, k - 1)
            slack = 1e-12 * (1 + np.abs(m) + np.abs(self.mean[c]) + dev[scan] + self.dev[c])
            bound = dims * np.maximum(gap - slack, 0) ** 2
            ends |= bound * (1 - 1e-12) > best[scan]
            scan, c, lower, bound, slack = (v[~ends] for v in (scan, c, lower, bound, slack))
            left[scan[lower]] -= 1
            right[scan[~lower]] += 1
            # means and deviations: this one is skipped
            bound = bound + np.maximum(np.abs(dev[scan] - self.dev[c]) - slack, 0) ** 2
            near = bound * (1 - 1e-12) <= best[scan]
            i, c = scan[near], c[near]
            distance = ((x[i] - self.at[c]) ** 2).sum(axis=1)
            measured += len(i)
            better = (distance < best[i]) | ((distance == best[i]) & (self.number[c] < who[i]))
            best[i[better]], who[i[better]] = distance[better], self.number[c[better]]
        return who, best, measured


def first_centroids(usable: DataFrame, k: int, dims: int, scale: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of "1:<id>", in that order; equal hashes by their components."""
    drawn = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = usable.select("v", drawn.alias("h")).orderBy("h", "v").limit(k).collect()
    batch = pa.RecordBatch.from_arrays([pa.nulls(len(rows)), pa.array([r["v"] for r in rows], type=pa.list_(pa.float64()))], names=["vec_id", "v"])
    return integers(batch, dims, scale)


def assign(usable: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> DataFrame:
    """Rows (vec_id, cluster, distance)."""
    def run(batches):
        search = Search(centroids)
        for b in batches:
            who, best, _ = search.nearest(integers(b, dims, scale))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(who.astype(np.int32)), pa.array(best)], names=["vec_id", "cluster", "distance"])

    return usable.mapInArrow(run, "vec_id long, cluster int, distance long")


def moved(usable: DataFrame, centroids: np.ndarray, dims: int, scale: int) -> np.ndarray:
    """Each centroid replaced by floor(sum / count) of the vectors that are nearest to it; one without vectors stays."""
    def run(batches):
        search, total = Search(centroids), np.zeros((len(centroids), dims + 1), dtype=np.int64)  # the last column counts
        for b in batches:
            x = integers(b, dims, scale)
            who, _, _ = search.nearest(x)
            order = np.argsort(who, kind="stable")
            found, first = np.unique(who[order], return_index=True)
            if len(found):
                total[found, :dims] += np.add.reduceat(x[order], first, axis=0)
                total[found, dims] += np.diff(np.append(first, len(who)))
        c, dim = np.nonzero(np.broadcast_to(total[:, dims:] > 0, total.shape))
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(dim.astype(np.int32)), pa.array(total[c, dim])], names=["cluster", "dim", "total"])

    sums = usable.mapInArrow(run, "cluster int, dim int, total long").groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38, 0)")).alias("total"))
    found = {(r["cluster"], r["dim"]): int(r["total"]) for r in sums.collect()}  # at most k * (dims + 1) rows
    out = centroids.copy()
    for c in {c for c, _ in found}:
        out[c] = [found[c, i] // found[c, dims] for i in range(dims)]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """One row per usable vector: vec_id, cluster, distance (squared), the distances summed over its cluster and over all
    vectors, and the cluster's centroid."""
    spark = vectors.sparkSession
    usable = finite_vectors(vectors, id_col, vec_col).where(F.size("v") == dims)
    centroids = first_centroids(usable, k, dims, scale)
    if not len(centroids):
        return spark.createDataFrame([], SCHEMA)
    for _ in range(rounds):
        centroids = moved(usable, centroids, dims, scale)
    assigned = written(assign(usable, centroids, dims, scale), "centroids")
    inertia = {r["cluster"]: int(r["d"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38, 0)")).alias("d")).collect()}  # at most k rows
    total = sum(inertia.values())
    of_cluster = spark.createDataFrame([(c, d, total, centroids[c].tolist()) for c, d in sorted(inertia.items())], "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return assigned.join(F.broadcast(of_cluster), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
