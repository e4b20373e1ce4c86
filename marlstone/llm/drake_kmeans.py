"""Centroid clustering (k-means) with Drake's adaptive bounds, exact in integers.

For every vector the state holds an upper bound on the distance to its centroid, lower bounds on the distances to its `bounds` next
nearest centroids, and one lower bound on all others.  When centroids move, bounds move by as much; a vector whose upper bound stays
below all its lower bounds keeps its centroid without a distance computed.  Otherwise its own distance is made exact, then those stored
centroids are measured whose bound does not exceed it, and where the remainder's bound does not either, the order cannot be certified
and all centroids are rescanned.  Bounds are rounded outwards, comparisons that decide are between exact integers, and a bound that is
equal certifies nothing, so ties go to the smaller number as in a full scan.

The state travels with the vectors as a table in the shared folder, one for each round, the one before removed: no vector is shuffled,
equal vectors gather nowhere, and a lost executor repeats its part of one round.  The driver holds the centroids and their sums, so
clusters times components numbers.

Defined results: vectors with another number of components, a null or non-finite one, or one beyond 2**19 in size (whose squared distances
no long holds) are left out; with fewer vectors than clusters each is a seed; null vec_id hashes as an empty text; rows with one vec_id
are clustered each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove_dir, shared_dir

SCALE, LARGEST = 256, 1 << 27
EXACT = 1 << 22  # squared distances of 64 components up to this size are exact in doubles
BOUNDS = 8
_STATE = "vec_id {key}, v array<int>, cluster int, distance long, upper double, near array<int>, lower array<double>, rest double, measured int"


def integer_vectors(embeddings: DataFrame, width: int = 64) -> DataFrame:
    """vec_id and v, floor(256 * x) of each component, of the vectors that are kept."""
    rows = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    fits = (F.size("x") == width) & F.forall("x", lambda x: F.coalesce(F.abs(x) < LARGEST // SCALE, F.lit(False)) & ~F.coalesce(F.isnan(x), F.lit(False)))
    return rows.where(fits).select("vec_id", F.transform("x", lambda x: F.floor(x * SCALE).cast("int")).alias("v"))


def hashed_seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest hash of salt and vec_id, equal ids by their components."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = vectors.orderBy(digest, "v").limit(k).select("v").collect()
    return np.array([r[0] for r in rows], np.int64) if rows else np.empty((0, 0), np.int64)


class Centers:
    """The centroids of a round and how far each has moved since the one before."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at, self.real, self.norm = at, at.astype(float), (at**2).sum(1)
        self.largest = int(np.abs(at).max(initial=0))
        moved = np.sqrt(((at - before) ** 2).sum(1).astype(float)) if before is not None else np.zeros(len(at))
        self.moved = np.where(moved > 0, np.nextafter(moved, np.inf), 0)

    def to_all(self, x: np.ndarray) -> np.ndarray:
        """Exact squared distances of each vector to each centroid."""
        if max(self.largest, int(np.abs(x).max(initial=0))) <= EXACT:
            return ((x**2).sum(1)[:, None] - 2 * (x.astype(float) @ self.real.T).astype(np.int64)) + self.norm
        return np.stack([((x - c) ** 2).sum(1) for c in self.at], 1)

    def to(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Exact squared distance of each vector to one centroid."""
        return ((x - self.at[which]) ** 2).sum(1)


def above(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squared.astype(float)), np.inf)


def below(squared: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(squared.astype(float)), -np.inf)


class State:
    """Clusters and bounds of a batch of vectors."""

    def __init__(self, x: np.ndarray, cluster, upper, near, lower, rest):
        self.x, self.cluster, self.upper, self.near, self.lower, self.rest = x, cluster, upper, near, lower, rest
        self.measured = np.zeros(len(x), np.int32)

    @classmethod
    def fresh(cls, x: np.ndarray, centers: Centers, bounds: int) -> State:
        n, b = len(x), min(bounds, len(centers.at) - 1)
        s = cls(x, np.zeros(n, np.int32), np.zeros(n), np.zeros((n, b), np.int32), np.zeros((n, b)), np.zeros(n))
        s.rescan(np.arange(n), centers)
        return s

    def rescan(self, rows: np.ndarray, centers: Centers) -> None:
        """Distances to all centroids: the nearest, the next nearest in order, and a bound on the rest."""
        if not len(rows):
            return
        d, b = centers.to_all(self.x[rows]), self.near.shape[1]
        order = np.argsort(d, axis=1, kind="stable")  # equal distances by number
        d = np.take_along_axis(d, order, 1)
        self.cluster[rows], self.upper[rows] = order[:, 0], above(d[:, 0])
        self.near[rows], self.lower[rows] = order[:, 1 : b + 1], below(d[:, 1 : b + 1])
        self.rest[rows] = below(d[:, b + 1]) if d.shape[1] > b + 1 else np.inf
        self.measured[rows] += d.shape[1]

    def move(self, centers: Centers) -> None:
        """Bounds after the centroids have moved, then the nearest centroid of each vector, exactly."""
        moved = centers.moved
        if not moved.any():
            return
        self.upper = np.nextafter(self.upper + moved[self.cluster], np.inf)
        self.lower = np.nextafter(self.lower - moved[self.near], -np.inf)
        self.rest = np.nextafter(self.rest - moved.max(), -np.inf)
        least = np.minimum(self.lower.min(1, initial=np.inf), self.rest)
        rows = np.flatnonzero(self.upper >= least)
        own = centers.to(self.x[rows], self.cluster[rows])
        self.upper[rows] = above(own)
        self.measured[rows] += 1
        open_ = self.upper[rows] >= least[rows]
        rows, own = rows[open_], own[open_]
        lost = self.upper[rows] >= self.rest[rows]
        self.rescan(rows[lost], centers)
        self.reorder(rows[~lost], own[~lost], centers)

    def reorder(self, rows: np.ndarray, own: np.ndarray, centers: Centers) -> None:
        """Measure the stored centroids that may be nearer than a vector's own, and keep the best."""
        if not len(rows):
            return
        home = self.cluster[rows].copy()
        best, best_d, best_at, limit = home.copy(), own.copy(), np.full(len(rows), -1), self.upper[rows]
        for j in range(self.near.shape[1]):
            at = np.flatnonzero(self.lower[rows, j] <= limit)
            if not len(at):
                continue
            who = self.near[rows[at], j]
            d = centers.to(self.x[rows[at]], who)
            self.lower[rows[at], j] = below(d)
            self.measured[rows[at]] += 1
            wins = (d < best_d[at]) | ((d == best_d[at]) & (who < best[at]))
            best[at[wins]], best_d[at[wins]], best_at[at[wins]] = who[wins], d[wins], j
        new = np.flatnonzero(best_at >= 0)
        self.near[rows[new], best_at[new]] = home[new]
        self.lower[rows[new], best_at[new]] = below(own[new])
        self.cluster[rows], self.upper[rows] = best, above(best_d)
        order = np.argsort(self.lower[rows], axis=1, kind="stable")
        self.near[rows] = np.take_along_axis(self.near[rows], order, 1)
        self.lower[rows] = np.take_along_axis(self.lower[rows], order, 1)


def _lists(a: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(np.ascontiguousarray(a).ravel(), kind))


def _matrix(c: pa.Array, n: int) -> np.ndarray:
    values = c.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(n, len(values) // n).copy()


def _assigned(rows: DataFrame, centers: Centers, bounds: int, key: str) -> DataFrame:
    """The state of all vectors under these centroids: from the one before where rows hold it, by a full scan otherwise."""

    def run(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            x = _matrix(b["v"], n).astype(np.int64)
            if "upper" in b.schema.names:
                s = State(x, *(b[c].to_numpy().copy() for c in ("cluster", "upper")), _matrix(b["near"], n), _matrix(b["lower"], n), b["rest"].to_numpy().copy())
                s.move(centers)
            else:
                s = State.fresh(x, centers, bounds)
            yield pa.RecordBatch.from_arrays(
                [b["vec_id"], b["v"], pa.array(s.cluster, pa.int32()), pa.array(centers.to(x, s.cluster)), pa.array(s.upper), _lists(s.near, pa.int32()), _lists(s.lower, pa.float64()), pa.array(s.rest), pa.array(s.measured)],
                names=["vec_id", "v", "cluster", "distance", "upper", "near", "lower", "rest", "measured"],
            )

    return rows.mapInArrow(run, _STATE.format(key=key))


def _means(state: DataFrame, at: np.ndarray) -> np.ndarray:
    """The exact floor of the mean of each cluster's vectors; a cluster without vectors stays."""
    sums = state.groupBy("cluster").agg(F.count("*").alias("n"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(at.shape[1])]).collect()
    out = at.copy()
    for r in sums:
        out[r[0]] = [s // r[1] for s in r[2:]]
    return out


def drake_kmeans(vectors: DataFrame, seeds: np.ndarray, rounds: int = 5, bounds: int = BOUNDS) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance, measured) after the rounds and a last assignment, and the centroids.

    vectors has vec_id and v of integers; distance is squared; measured counts the distances computed in the last assignment.
    """
    spark, key = vectors.sparkSession, vectors.schema["vec_id"].dataType.simpleString()
    rows, before, path = vectors, None, None
    at = seeds
    for turn in range(rounds + 1):
        if turn:
            moved = _means(rows, at)
            if (moved == at).all():
                break
            at, before = moved, at
        old, path = path, shared_dir(spark, f"drake-{turn}")
        state = _assigned(rows, Centers(at, before), bounds, key)
        state.write.parquet(path)
        rows = spark.read.schema(state.schema).parquet(path)
        if old:
            remove_dir(spark, old)
    return rows.select("vec_id", "v", "cluster", "distance", "measured"), at


def cluster_report(vectors: DataFrame, k: int = 40, salt: str = "2:", rounds: int = 5, bounds: int = BOUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector."""
    seeds = hashed_seeds(vectors, k, salt)
    if not len(seeds):
        empty = ", ".join(f"cast(null as {t}) as {c}" for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string")))
        return vectors.limit(0).selectExpr("vec_id", *empty.split(", "))
    state, at = drake_kmeans(vectors, seeds, rounds, bounds)
    sums = {r[0]: r[1] for r in state.groupBy("cluster").agg(F.sum("distance")).collect()}
    total, digests = sum(sums.values()), [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at.tolist()]
    of_cluster = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("cluster") + 1)
    return state.select("vec_id", "cluster", "distance", of_cluster([sums.get(i, 0) for i in range(len(at))]).cast("long").alias("cluster_inertia"), F.lit(total).cast("long").alias("inertia"), of_cluster(digests).alias("centroid_sha256"))
