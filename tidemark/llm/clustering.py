"""Centroid clustering of integer vectors, with centroids filtered by an n-simplex projection.

A few pivots, taken among the first centroids, form a simplex. A vector's cached
distances to them fix its apex over that simplex: coordinates in the pivots'
space and a height above it. For two apexes the Euclidean distance bounds the
distance of their vectors from below, and from above once one height is negated.
Pivots stay, so a vector's apex is made once and kept with it; in each round the
centroids get theirs, and only centroids whose lower bound is not above the least
upper bound (or the exact distance of the likeliest) are compared exactly, in integers. The bounds allow for rounding
(``SLACK`` of the largest squared norm in play), so the filter never drops a nearest centroid.

Each task adds up its vectors by cluster; Spark merges these sums. The driver
holds the centroids and no vector besides the first ones.

Defined cases: vectors of another length, or with a null or non-finite
component, are left out, and so are those beyond ``LARGEST`` in an integer
component, whose squared distances no long holds; with fewer vectors than
clusters each vector starts a centroid; null vec_ids start one last; equal
vectors, and repeated rows, count each; ties go to the smaller number; an empty
table gives an empty one; other columns than vec_id and embedding are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

DIMENSIONS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
SEED = 2
PIVOTS = 32
LARGEST = 2**27
AT_ONCE = 4096  # vectors that a task compares at once
SLACK = 1e-9
#: A pivot has to stand at least this share of the largest distance above the others' space.
LEAST_HEIGHT = 1e-3


def kept_vectors(df: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the integer vector, of every row whose vector is whole."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    whole = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("e")).filter((F.size("e") == dimensions) & ~F.exists("e", bad))
    scaled = whole.select("vec_id", F.transform("e", lambda x: x * scale).alias("e")).filter(~F.exists("e", lambda x: (x < -LARGEST) | (x >= LARGEST + 1)))
    return scaled.select("vec_id", F.transform("e", lambda x: F.floor(x).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, clusters: int = CLUSTERS, seed: int = SEED) -> np.ndarray:
    """The vectors whose ids have the smallest hashes, in that order."""
    named = vectors.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return np.array([r.v for r in named.orderBy(F.col("h").asc_nulls_last(), "v").limit(clusters).collect()], np.int64)


def squared_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of two sets of integer vectors."""
    return np.stack([np.square(a - y).sum(1) for y in b], 1) if len(b) else np.zeros((len(a), 0), np.int64)


@dataclass
class Simplex:
    """Pivots and, row by row, the coordinates of each within the space of those before it and its height."""

    pivots: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, candidates: np.ndarray, most: int = PIVOTS) -> Simplex:
        """The first candidates that stand clear of the space of the pivots before."""
        found = cls(candidates[:1], np.zeros((min(len(candidates), 1), 0)))
        span = float(squared_distances(candidates, candidates).max(initial=0))
        for x in candidates[1:]:
            if len(found.pivots) == most:
                break
            apex = found.apexes(squared_distances(x[None], found.pivots))[0]
            if apex[-1] > LEAST_HEIGHT * np.sqrt(span):
                base = np.zeros((len(found.base) + 1, len(found.base)))
                base[:-1, :-1], base[-1] = found.base, apex
                found = cls(np.vstack([found.pivots, x]), base)
        return found

    def apexes(self, squared: np.ndarray) -> np.ndarray:
        """Apex of each row of squared distances to the pivots: coordinates, then the height over the pivots' space.

        A pivot's own coordinates are a lower triangle, so each further distance fixes one more coordinate.
        """
        n = len(self.pivots)
        out = np.zeros((len(squared), n))
        first = squared[:, 0].astype(float)
        for k in range(1, n):
            p = self.base[k]
            known = out[:, : k - 1] @ p[: k - 1]
            out[:, k - 1] = ((first - squared[:, k] + p @ p) / 2 - known) / p[k - 1]
        out[:, n - 1] = np.sqrt(np.maximum(first - np.square(out[:, : n - 1]).sum(1), 0))
        return out


def bounds(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared lower and upper bounds of the distances of two sets of apexes."""
    flat = np.square(a[:, None, :-1] - b[None, :, :-1]).sum(2)
    return flat + np.square(a[:, None, -1] - b[None, :, -1]), flat + np.square(a[:, None, -1] + b[None, :, -1])


def nearest(vectors: np.ndarray, apexes: np.ndarray, centroids: np.ndarray, their_apexes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, exact squared distance) of each vector's nearest centroid; the smaller number of equally near ones."""
    lower, upper = bounds(apexes, their_apexes)
    slack = SLACK * (np.square(apexes).sum(1)[:, None] + np.square(their_apexes).sum(1)[None])
    likely = lower.argmin(1)  # its exact distance is a tighter upper bound
    most = np.minimum((upper + slack).min(1), np.square(vectors - centroids[likely]).sum(1))
    rows, numbers = np.nonzero(lower - slack <= most[:, None])
    exact = np.square(vectors[rows] - centroids[numbers]).sum(1)
    order = np.lexsort((numbers, exact, rows))
    best = order[np.unique(rows[order], return_index=True)[1]]
    return numbers[best], exact[best]


def _vectors(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def with_apexes(vectors: DataFrame, simplex: Simplex, dimensions: int = DIMENSIONS) -> DataFrame:
    """vectors with apex, from their distances to the pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _vectors(batch["v"], dimensions).astype(np.int64)
            apex = simplex.apexes(squared_distances(v, simplex.pivots))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * apex.shape[1]), pa.array(apex.ravel()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], lists], names=["vec_id", "v", "apex"])

    return vectors.select("vec_id", "v").mapInArrow(run, "vec_id long, v array<int>, apex array<double>")


def _assigned(batches: Iterator[pa.RecordBatch], simplex: Simplex, centroids: np.ndarray) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(vec_ids, vectors, clusters, distances) for slices of the batches."""
    theirs = simplex.apexes(squared_distances(centroids, simplex.pivots))
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(at, AT_ONCE)
            v = _vectors(part["v"], centroids.shape[1]).astype(np.int64)
            yield part["vec_id"], v, *nearest(v, _vectors(part["apex"], theirs.shape[1]), centroids, theirs)


def moved(kept: DataFrame, simplex: Simplex, centroids: np.ndarray) -> np.ndarray:
    """Each centroid as the floor of its vectors' mean; one without vectors as it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), np.int64)
        for _, v, clusters, _ in _assigned(batches, simplex, centroids):
            np.add.at(sums, clusters, v)
            np.add.at(counts, clusters, 1)
        for k in np.flatnonzero(counts):
            yield pa.RecordBatch.from_pydict({"cluster": pa.array([k], pa.int32()), "n": pa.array([counts[k]]), "total": pa.array([sums[k]])})

    partial = kept.mapInArrow(run, "cluster int, n long, total array<long>")  # a row for each cluster and task at most
    dimensions = range(centroids.shape[1])
    out = centroids.copy()
    for r in partial.groupBy("cluster").agg(F.sum("n"), *[F.sum(F.col("total")[d]) for d in dimensions]).collect():
        out[r[0]] = [total // r[1] for total in r[2:]]
    return out


def clustered(df: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector of df (vec_id, embedding)."""
    spark = df.sparkSession
    vectors = written(kept_vectors(df), "vectors")
    centroids = first_centroids(vectors, clusters)
    schema = "vec_id long, cluster int, distance long"
    if not len(centroids):
        return spark.createDataFrame([], f"{schema}, cluster_inertia long, inertia long, centroid_sha256 string")
    simplex = Simplex.of(centroids)
    kept = written(with_apexes(vectors, simplex), "apexes")
    for _ in range(rounds):
        centroids = moved(kept, simplex, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, numbers, distances in _assigned(batches, simplex, centroids):
            yield pa.RecordBatch.from_arrays([ids, pa.array(numbers.astype(np.int32)), pa.array(distances)], names=["vec_id", "cluster", "distance"])

    out = written(kept.mapInArrow(run, schema), "assigned")
    inertia = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    total = out.agg(F.sum("distance").alias("inertia"))
    digests = spark.createDataFrame([(k, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for k, c in enumerate(centroids.tolist())], "cluster int, centroid_sha256 string")
    # a row for each cluster, and one
    return out.join(F.broadcast(inertia), "cluster").join(F.broadcast(digests), "cluster").crossJoin(F.broadcast(total)).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
