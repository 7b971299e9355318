"""Shallot clustering against plain loops, bounds against all distances, and awkward vectors."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainspark.llm import queries, shallot


def brute_force(rows: list[tuple[int, list[float]]], k: int = 16, dims: int = 64, scale: int = 64, rounds: int = 3, seed: str = "1") -> dict[int, tuple]:
    """The same from plain loops, for tests: id -> (cluster, distance, cluster inertia, inertia, digest)."""
    kept = {i: [math.floor(scale * x) for x in v] for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)}
    at = [kept[i] for i in sorted(kept, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())[:k]]
    far = lambda x, c: sum((p - q) ** 2 for p, q in zip(x, c, strict=True))
    nearest = lambda: {i: min((far(x, c), j) for j, c in enumerate(at)) for i, x in kept.items()}
    for _ in range(rounds):
        found = nearest()
        for j in range(len(at)):
            own = [kept[i] for i, (_, c) in found.items() if c == j]
            at[j] = [sum(x) // len(own) for x in zip(*own, strict=True)] if own else at[j]
    found = nearest()
    cost = [sum(d for d, c in found.values() if c == j) for j in range(len(at))]
    return {i: (c, d, cost[c], sum(cost), hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, (d, c) in found.items()}


def as_dict(found):
    return {r.vec_id: (r.cluster, r.distance, r.cluster_inertia, r.inertia, r.digest) for r in found.withColumn("digest", shallot.digest(F.col("centroid"))).collect()}


def test_query_equals_plain_loops_and_sql(spark, sf_dir, duck):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {r.vec_id: tuple(r)[1:] for r in queries.op11_shallot_kmeans(spark, sf_dir).collect()}
    assert got == brute_force(rows)
    assert got == {r[0]: tuple(r[1:]) for r in duck.sql(queries.oracle_sql()["op11_shallot_kmeans"]).fetchall()}


def test_ties_and_repeated_vectors(spark):
    """Small whole components give many equal distances; the smaller number wins."""
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-2, 3, 4) / 64).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    assert as_dict(shallot.cluster(frame, k=12, dims=4)) == brute_force(rows, k=12, dims=4)
    assert as_dict(shallot.cluster(frame, k=1, dims=4)) == brute_force(rows, k=1, dims=4)


def test_search_is_exact_and_skips_most_distances():
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (40, 6))
    x = (centres[rng.integers(0, 40, 3000)] + rng.integers(-90, 90, (3000, 6))).astype(np.int64)
    now = shallot.Centroids(centres)
    state = shallot.first_bounds(x, now)
    total = 0
    for _ in range(5):
        before = now.at
        now = shallot.Centroids(before + rng.integers(-60, 60, before.shape), before)
        *state, compared = shallot.search(x, *state, now)
        d = ((x[:, None] - now.at[None]) ** 2).sum(2)
        assert (d.argmin(1) == state[0]).all()
        real = np.sqrt(d.astype(float))
        assert (state[2] >= real[np.arange(len(x)), state[0]]).all()
        real[np.arange(len(x)), state[0]] = np.inf
        assert (state[3] <= real.min(1)).all()
        total += compared
    assert total < 5 * len(x) * 4  # of 40 centroids


def test_awkward_vectors(spark):
    v = lambda *x: [float(a) for a in x]
    far = float(shallot.limit(2))
    rows = [(1, v(0, 0), "a"), (1, v(0, 0), "b"), (None, v(1, 1), "c"), (2, None, "d"), (3, v(1), "e"), (4, v(1, math.nan), "f"), (5, v(1, math.inf), "g"), (6, [1.0, None], "h"), (7, v(far, 0), "i"), (8, v(0, 3), "j")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string")
    got = shallot.cluster(frame, k=16, dims=2, carry=("cluster",)).collect()
    by = sorted((r.vec_id or 0, r.distance) for r in got if r.cluster is not None)
    assert by == [(0, 0), (1, 0), (1, 0), (8, 0)]  # fewer vectors than centroids
    assert [r.vec_id for r in got if r.cluster is None] == [7]
    other = spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string")
    assert sorted(r.v for r in shallot.cluster(other, k=2, dims=2, carry=("v",)).collect()) == ["a", "b", "c", "i", "j"]
    assert shallot.cluster(frame.where("false"), k=3, dims=2).collect() == []
    one = shallot.cluster(frame.where("vec_id = 8"), k=3, dims=2).first()
    assert (one.cluster, one.distance, one.centroid) == (0, 0, [0, 192])


@pytest.mark.parametrize("dims", [1, 2, 64, 1000])
def test_limit_keeps_distances_in_a_long(dims):
    assert dims * (2 * shallot.limit(dims)) ** 2 <= 1 << 62
