"""Clustering against plain integer k-means, and the bounds of the projection."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import clustering as C

SCHEMA = "vec_id long, embedding array<float>"


def plain(rows, clusters=C.CLUSTERS, rounds=C.ROUNDS):
    """Every centroid against every vector, in Python integers."""
    kept = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and np.isfinite(np.float32(x)) and abs(x) < 2**19 for x in e)]
    named = lambda i: (i is None, hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "")
    centroids = [v for _, v in sorted(kept, key=lambda r: (named(r[0]), r[1]))[:clusters]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        groups = [[v for (_, v), k in zip(kept, own, strict=True) if k == c] for c in range(len(centroids))]
        centroids = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, centroids, strict=True)]
    found = [(i, *near(v)) for i, v in kept]
    inertia = lambda c: sum(d for _, d, k in found if c in (k, None))
    return sorted((i if i is not None else -1, k, d, inertia(k), inertia(None), hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, d, k in found)


def clustered(spark, rows, **kwargs):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"cluster": F.lit("x"), "v": F.lit(1), "apex": F.lit(2)})
    return sorted((r[0] if r[0] is not None else -1, *r[1:]) for r in C.clustered(df, **kwargs).collect())


def test_odd_vectors(spark):
    rnd = np.random.default_rng(5)
    point = lambda: (rnd.integers(-2, 3, 64) / 256).tolist()  # noqa: E731  many ties
    rows = [(k, point()) for k in range(150)] + [(k, point()) for k in range(5)] + [(500 + k, [0.25] * 64) for k in range(80)] + [(None, point()), (None, None)]
    rows += [(600, [0.0] * 63), (601, [0.0] * 65), (602, [None] + [0.0] * 63), (603, [float("nan")] * 64), (604, [float("inf")] + [0.0] * 63), (605, []), (606, [1e30] + [0.0] * 63), (607, [-0.001] * 64), (608, [1000.7] * 64), (609, [524287.99] * 64)]
    assert clustered(spark, rows) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.5] * 64)], [(k, [0.5] * 64) for k in range(60)], [(k, [float(k)] * 64) for k in range(60)]])
def test_degenerate_tables(spark, rows):
    assert clustered(spark, rows) == plain(rows)


def test_bounds_hold_and_filter():
    """Bounds of random integer vectors hold; on clustered ones the filter leaves few centroids for exact comparison."""
    rnd = np.random.default_rng(7)
    middles = rnd.integers(-300, 300, (40, 64))
    v = middles[rnd.integers(0, 40, 3000)] + rnd.integers(-20, 20, (3000, 64))
    centroids = v[:40]
    simplex = C.Simplex.of(centroids)
    assert len(simplex.pivots) == C.PIVOTS
    apexes, theirs = (simplex.apexes(C.squared_distances(x, simplex.pivots)) for x in (v, centroids))
    lower, upper = C.bounds(apexes, theirs)
    exact = C.squared_distances(v, centroids)
    assert (lower <= exact + 1e-3).all() and (exact <= upper + 1e-3).all()
    assert (lower <= upper.min(1)[:, None]).mean() < 0.6
    assert (lower <= np.minimum(upper.min(1), exact[np.arange(len(v)), lower.argmin(1)])[:, None]).mean() < 0.2
    numbers, distances = C.nearest(v, apexes, centroids, theirs)
    assert (numbers == exact.argmin(1)).all() and (distances == exact.min(1)).all()
