"""Exact neighbours and density clusters against brute force, their cost, and awkward rows."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainspark.operators import density, graph, neighbours, outliers, sampling
from grainspark.operators import pivots as index


def brute_knn(rows, k, other=None, keep_self=False):
    """{key: [(key, distance)]} over rows of (key, group, vector)."""
    out = {}
    for key, g, v in rows:
        found = sorted((math.dist(v, w), y) for y, h, w in (other or rows) if h == g and len(w) == len(v) and (keep_self or y != key))
        out[key] = [(y, d) for d, y in found[:k]]
    return out


def found_knn(found):
    out = defaultdict(list)
    for r in found.orderBy("a_key", "rank").collect():
        out[r.a_key].append((r.b_key, r.distance))
    return out


def same(got, want):
    for key, near in want.items():
        assert [x for x, _ in got.get(key, [])] == [x for x, _ in near], key
        assert np.allclose([d for _, d in got.get(key, [])], [d for _, d in near])


def clustered(n, seed=0, groups=("a",), copies=True):
    """Whole coordinates, so that ties and copies are many."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(-40, 40, (8, 3))
    rows = [(f"k{i:04d}", groups[i % len(groups)], [float(x) for x in centres[rng.integers(0, 8)] + rng.integers(-3, 4, 3)]) for i in range(n)]
    return rows + [(f"c{i:04d}", groups[0], rows[0][2]) for i in range(n // 4 if copies else 0)]


@pytest.mark.parametrize("block", [7, 4096])
def test_knn_with_ties_copies_and_groups(spark, block, monkeypatch):
    monkeypatch.setattr(index, "CELL_ROWS", 10)
    rows = clustered(300, groups=("a", "b"))
    df = spark.createDataFrame(rows, "id string, g string, v array<double>").repartition(5)
    same(found_knn(neighbours.knn_join(df, df, 4, "id", "v", within="g", block=block)), brute_knn(rows, 4))


def test_knn_of_other_rows_and_of_oneself(spark):
    rows, other = clustered(80, 1), [(f"o{i}", g, v) for i, (_, g, v) in enumerate(clustered(120, 2))]
    a, b = (spark.createDataFrame(x, "id string, g string, v array<double>") for x in (rows, other))
    same(found_knn(neighbours.knn_join(a, b, 3, "id", "v")), brute_knn(rows, 3, other))
    same(found_knn(neighbours.knn_join(a, a, 3, "id", "v", keep_self=True)), brute_knn(rows, 3, keep_self=True))


def test_knn_of_awkward_rows(spark):
    rows = [("a", "x", [1.0, 2.0]), ("b", "x", [1.0, 2.5]), ("c", "x", None), ("d", "x", [1.0, math.nan]), ("e", "x", []), ("f", "x", [1.0, math.inf]), ("g", "x", [1.0]), ("h", None, [1.0, 2.0]), ("i", "x", [0.0, 2.0]), ("j", "x", [-0.0, 2.0]), ("k", "lone", [5.0, 5.0])]
    df = spark.createDataFrame(rows, "id string, g string, v array<double>")
    got = found_knn(neighbours.knn_join(df, df, 2, "id", "v", within="g"))
    assert {k: [x for x, _ in v] for k, v in got.items()} == {"a": ["b", "i"], "b": ["a", "i"], "i": ["j", "a"], "j": ["i", "a"]}
    assert neighbours.knn_join(df.where("false"), df, 2, "id", "v").collect() == []
    assert neighbours.knn_join(df, df.where("false"), 2, "id", "v").collect() == []


def test_index_skips_most_distances(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 10, (40, 6))
    rows = [(str(i), [float(x) for x in centres[i % 40] + rng.normal(0, 0.3, 6)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id string, v array<double>").repartition(4)
    cost = neighbours.knn_candidates(df, df, 3, "id", "v").agg(F.sum("compared")).first()[0]
    assert cost < 3000**2 / 25


def test_cost_and_recall_on_embeddings(spark):
    """Vectors about equally far from each other: cells cannot be skipped, but few distances are computed to their end."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    n = df.count()
    found = neighbours.knn_candidates(df, df, 3, "id", "embedding")
    assert found.agg(F.sum("compared")).first()[0] < n * n / 4
    pairs = lambda x: {(r.a_key, r.b_key) for r in x.collect()}
    exact, near = pairs(neighbours.knn_join(df, df, 3, "id", "embedding")), pairs(neighbours.knn_join(df, df, 3, "id", "embedding", exact=False))
    assert len(exact) == 3 * n and len(exact & near) >= 0.9 * len(exact)


def test_approximate_neighbours_in_resampling_and_outliers(spark):
    rng = np.random.default_rng(4)
    rows = [(f"r{i}", i % 7 == 0, [float(x) for x in rng.normal(3 * (i % 7 == 0), 1, 3)]) for i in range(140)]
    df = spark.createDataFrame(rows, "id string, label boolean, v array<double>")
    assert sampling.smote(df, "label", "id", "v", exact=False).where("synthetic").count() == 100
    assert 0 < sampling.smote_enn(df, "label", "id", "v", exact=False).count() <= 240
    parts = df.where("NOT label"), df.where("label")
    a, b = ({r.id: r.lof for r in outliers.lof(*parts, "id", "v", k=5, exact=e).collect()} for e in (True, False))
    assert a.keys() == b.keys() and np.corrcoef([a[k] for k in a], [b[k] for k in a])[0, 1] > 0.9


def test_pairs_within_a_distance(spark):
    rows = clustered(150, 5)
    df = spark.createDataFrame(rows, "id string, g string, v array<double>")
    got = {(r.u, r.v): r.distance for r in neighbours.epsilon_pairs(df, "id", "v", 3.0).collect()}
    want = {(a, b): math.dist(v, w) for a, _, v in rows for b, _, w in rows if a < b and math.dist(v, w) <= 3.0}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p]) for p in want)


def brute_dbscan(rows, eps, least):
    """{key: (core, cluster)} over rows of (key, vector)."""
    d = np.array([[math.dist(v, w) for _, w in rows] for _, v in rows])
    names = [k for k, _ in rows]
    core = (d <= eps).sum(1) >= least
    label = {}
    for s in sorted(range(len(rows)), key=lambda i: names[i]):
        todo = [s] if core[s] and s not in label else []
        while todo:
            i = todo.pop()
            if i not in label:
                label[i] = names[s]
                todo += [j for j in range(len(rows)) if core[j] and d[i, j] <= eps]
    out = {}
    for i, k in enumerate(names):
        near = min(((d[i, j], names[j], j) for j in range(len(rows)) if core[j] and d[i, j] <= eps), default=None)
        out[k] = (bool(core[i]), label[i] if core[i] else label[near[2]] if near else None)
    return out


@pytest.mark.parametrize("one_task", [0, 1 << 20])
def test_clusters_of_every_eps(spark, monkeypatch, one_task):
    monkeypatch.setattr(density, "ONE_TASK", one_task)
    monkeypatch.setattr(index, "CELL_ROWS", 20)
    rows = [(k, v) for k, _, v in clustered(120, 6)]
    df = spark.createDataFrame(rows, "id string, v array<double>").repartition(3)
    eps = [0.5, 1.0, 2.0, 3.0, 30.0] if one_task else [1.0, 3.0]
    found = density.Density(df, "id", "v", eps, 4)
    noise = found.noise()
    for k, e in enumerate(eps):
        want = brute_dbscan(rows, e, 4)
        assert {r.id: (r.core, r.cluster) for r in found.clusters(e).collect()} == want
        assert noise[k] == sum(c is None for _, c in want.values())


def test_search_takes_the_least_eps_of_the_best_clusters(spark):
    rng = np.random.default_rng(11)
    rows = [(f"{side}-{i}", [10.0 * side + float(x) for x in rng.uniform(0, 0.3, 2)]) for side in range(3) for i in range(12)] + [("null", None)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    found, eps, scores = neighbours.dbscan_search(df, "id", "v", min_points=2)
    assert (scores, eps) == ({}, 0.5) and found.where("id = 'null' AND NOT core AND cluster IS NULL").count() == 1  # noise at every eps
    found, eps, scores = neighbours.dbscan_search(df.where("v IS NOT NULL"), "id", "v", min_points=2)
    assert len(scores) > 5 and eps == min(e for e in scores if scores[e] == max(scores.values()))
    assert {(r.id.split("-")[0], r.cluster) for r in found.collect()} == {(str(s), f"{s}-0") for s in range(3)}
    assert neighbours.dbscan(df.where("false"), "id", "v", 1.0, 2).collect() == []


def test_forest_connects_the_same_nodes_at_each_level():
    rng = np.random.default_rng(2)
    u, v, k = rng.integers(0, 60, 300), rng.integers(0, 60, 300), rng.integers(0, 5, 300)
    a, b, c = density.forest(u, v, k)
    assert len(a) < 60
    for level in range(5):
        assert (graph.merge_level(60, u[k <= level], v[k <= level]) == graph.merge_level(60, a[c <= level], b[c <= level])).all()


def test_lists_of_cells_to_visit_stay_small(spark, monkeypatch):
    """Where no cell can be left out, a task makes rows x cells visits, each with its vector: neither may be many."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(str(i), rng.normal(size=8).tolist()) for i in range(4000)], "id string, v array<double>")
    stored = index.durable(index.distinct_points(index.points(df, "id", "v"), 4))
    found = index.PivotIndex(stored, "keys array<string>")
    pivots = len(found.facts.first()["pivots"])
    assert pivots <= 32
    monkeypatch.setattr(index, "DEALT", 40_000)
    visits = found.visits(stored.select("g", "vid", "v", F.lit(1e9).alias("t2")), "all")
    sizes = [r["n"] for r in visits.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 4000 * pivots
    slots = index._with_group(stored.select("g", "vid", "v"), found.facts, lambda a, _: index.pa.table({"g": a["g"].slice(0, 1), "n": [a.num_rows]}), "g string, n long")
    assert max(r["n"] for r in slots.collect()) * pivots < 80_000


def test_pairs_by_products_are_those_of_exact_sums():
    rng = np.random.default_rng(8)
    for scale, shift in ((1.0, 0.0), (1e-3, 1e6)):
        q, b = (rng.integers(-3, 4, (n, 5)) * scale + shift for n in (90, 200))
        centre = np.full(5, shift)
        far = lambda x: np.sqrt(((x - centre) ** 2).sum(1))
        with np.errstate(over="ignore", invalid="ignore"):
            d2 = sum((q[:, None, c] - b[None, :, c]) ** 2 for c in range(5))
            t2 = np.sort(d2, 1)[:, 6]
            whole, few = ([p for x in index.close_pairs(q, far(q), t2, b, far(b), k) for p in zip(*x, strict=True)] for k in (None, 3))
        want = {(i, j): d2[i, j] for i in range(90) for j in np.flatnonzero(d2[i] <= t2[i])}
        assert {(i, j): d for i, j, d in whole} == want
        nearest = {(i, j) for i in range(90) for j in np.flatnonzero(d2[i] <= np.sort(d2[i])[2])}
        assert nearest <= {(i, j) for i, j, _ in few}


def test_a_vector_is_dealt_once_for_a_bundle_of_cells(spark):
    """Where no cell can be left out, what is dealt is queries x bundles, and every query still meets every row."""
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(str(i), rng.normal(size=8).tolist()) for i in range(4000)], "id string, v array<double>")
    stored = index.durable(index.distinct_points(index.points(df, "id", "v"), 4))
    found = index.PivotIndex(stored, "keys array<string>")
    errands = index.durable(found.errands(stored.select("g", "vid", "v", F.lit(1e9).alias("t2")), "all"))
    assert errands.count() == 4000
    names = "queries long, met long"

    def kernel(a, b):
        met = sum(len(i) for i, _, _ in index.meetings(a, b, index.numbers(a, "t2")))
        return index.pa.table({"queries": [a.num_rows], "met": [met]})

    dealt, met = found.search(errands, kernel, names).agg(F.sum("queries"), F.sum("met")).first()
    assert dealt == 4000 * 4 and met == 4000**2


def test_points_for_resampling_are_made_once(spark, monkeypatch):
    seen, smote = spark.sparkContext.accumulator(0), sampling.smote

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def counted(*args):
        made = smote(*args)
        return made.mapInArrow(count, made.schema)

    monkeypatch.setattr(sampling, "smote", counted)
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(f"r{i}", i % 7 == 0, rng.normal(3 * (i % 7 == 0), 1, 3).tolist()) for i in range(70)], "id string, label boolean, v array<double>")
    assert 0 < sampling.smote_enn(df, "label", "id", "v").count() <= 120
    assert seen.value == 120
