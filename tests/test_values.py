"""Fitted models by value: planted clusters, tables whose fit has a closed form, and trees with one right answer."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainspark.operators import clusters, frames, models

CENTRES = np.array([[0.0, 0.0], [10.0, 0.0], [0.0, 10.0]])


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(21)
    rows = [(c, [float(x) for x in CENTRES[c] + rng.normal(0, 0.5, 2)]) for c in range(3) for _ in range(80)]
    return rows, clusters.with_vector(spark.createDataFrame(rows, "c int, v array<double>"), "v").cache()


def partition(df):
    found = {}
    for r in df.groupBy("c", "prediction").count().collect():
        found.setdefault(r.c, []).append((r.prediction, r["count"]))
    return found


@pytest.mark.parametrize("best", [clusters.kmeans_best_k, clusters.hierarchical_best_k])
def test_centres_of_planted_clusters(planted, best):
    rows, df = planted
    model, scores = best(df, range(2, 6))
    means = sorted(tuple(np.mean([v for k, v in rows if k == c], 0)) for c in range(3))
    assert max(scores, key=scores.get) == 3 and np.allclose(sorted(map(tuple, model.clusterCenters())), means, atol=1e-9)
    found = partition(model.transform(df))
    assert all(len(v) == 1 and v[0][1] == 80 for v in found.values()) and len({v[0][0] for v in found.values()}) == 3


def test_mixture_of_planted_clusters(planted):
    rows, df = planted
    model, scores = clusters.gmm_best_k(df, range(2, 5))
    assert min(scores, key=lambda k: scores[k][0]) == 3 and np.allclose(model.weights, 1 / 3, atol=1e-3)
    for g in model.gaussians:
        own = np.array([v for c, v in rows if np.linalg.norm(CENTRES[c] - g.mean.toArray()) < 2])
        assert len(own) == 80 and np.allclose(g.mean.toArray(), own.mean(0), atol=1e-3) and np.allclose(g.cov.toArray(), np.cov(own.T, bias=True), atol=1e-3)


def table(spark):
    """x is 0 or 1; class 2 has odds 1:3 at 0 and 4:1 at 1; y says nothing."""
    rows = [(x, float(i % 2), c) for x, c, n in ((0.0, 1, 30), (0.0, 2, 10), (1.0, 1, 8), (1.0, 2, 32)) for i in range(n)]
    return models.with_vector(spark.createDataFrame(rows, "x double, y double, type int"), ["x", "y"])


def test_logistic_equals_the_table_s_odds(spark):
    df = table(spark)
    out = models.logistic(df, "type", [1, 2], maxIter=200, tol=1e-12).transform(df)
    got = {r.x: r.p for r in out.groupBy("x").agg(F.avg(F.col("probabilities")[1]).alias("p")).collect()}
    assert np.isclose(got[0.0], 10 / 40, atol=1e-4) and np.isclose(got[1.0], 32 / 40, atol=1e-4)


def test_weights_shift_the_odds(spark):
    df = table(spark).withColumn("w", F.when(F.col("type") == 2, 3.0).otherwise(1.0))
    out = models.logistic(df, "type", [1, 2], weight="w", maxIter=200, tol=1e-12).transform(df)
    got = {r.x: r.p for r in out.groupBy("x").agg(F.avg(F.col("probabilities")[1]).alias("p")).collect()}
    assert np.isclose(got[0.0], 30 / 60, atol=1e-4) and np.isclose(got[1.0], 96 / 104, atol=1e-4)


def test_one_tree_without_sampling_gives_the_table_s_shares(spark):
    df = table(spark)
    out = models.random_forest(df, "type", [1, 2], numTrees=1, maxDepth=1, featureSubsetStrategy="all", bootstrap=False).transform(df)
    got = {r.x: r.p for r in out.groupBy("x").agg(F.avg(F.col("probabilities")[1]).alias("p"), F.stddev_pop(F.col("probabilities")[1]).alias("s")).collect()}
    assert np.isclose(got[0.0], 0.25) and np.isclose(got[1.0], 0.8)


def test_trees_find_a_cut_of_three_classes(spark):
    rows = [(float(i), float(i * 7 % 10), 1 + (i >= 40) + (i >= 80)) for i in range(120)]
    df = models.with_vector(spark.createDataFrame(rows, "x double, y double, type int"), ["x", "y"])
    for kind, params in (("boosted", {"maxIter": 4, "maxDepth": 2}), ("forest", {"numTrees": 5, "maxDepth": 3, "featureSubsetStrategy": "all"})):
        fitted = models.KINDS[kind](df, "type", [1, 2, 3], **params)
        out = models.vote(df, {kind: fitted}, [1, 2, 3])
        wrong = {r.x for r in out.where("predicted <> type").collect()}
        assert wrong <= {39.0, 40.0, 79.0, 80.0}  # a binned cut may lie a row off
        each = fitted.models.values() if kind == "boosted" else [fitted.model]
        assert all(m.featureImportances.toArray()[0] > 0.95 for m in each)


def test_phases_of_planted_levels(spark):
    rng = np.random.default_rng(22)
    levels = {(y, x): (200 if 3 <= y < 6 and 3 <= x < 8 else 90 if x >= 9 else 20) + int(rng.integers(-3, 4)) for y in range(12) for x in range(14)}
    rows = [(k, y, x, v) for k in (1, 2) for (y, x), v in levels.items()]
    df = spark.createDataFrame(rows, "crop long, by int, bx int, v int")
    got = {(r.crop, r.v): (r.phase, r.background) for r in frames.segment_phases(df, ring=1, exact=True).collect()}
    assert set(got) == {(k, v) for k in (1, 2) for v in levels.values()}
    for (_, v), (phase, background) in got.items():
        assert phase == (v > 50) + (v > 150)
    border = np.mean([v for (y, x), v in levels.items() if y in (0, 11) or x in (0, 13)])
    nearest = min(range(3), key=lambda p: abs(np.mean([v for v in levels.values() if (v > 50) + (v > 150) == p]) - border))
    assert all(b == (p == nearest) for p, b in got.values())


def test_rows_go_to_the_models_of_their_groups(spark):
    """Two groups whose labels are each other's opposite, and one that only the combined model serves."""
    rows = [(g, float(i), (1 + (i >= 30)) if g == "a" else (2 - (i >= 30))) for g in ("a", "b") for i in range(60)]
    df = models.with_vector(spark.createDataFrame(rows, "g string, x double, type int"), ["x"])
    by = {r.g: r.model for r in models.routes(df.select("g").union(spark.createDataFrame([("c",)], "g string")), "g", ["a", "b", "combined"]).collect()}
    assert by == {"a": "a", "b": "b", "c": "combined"}
    for g in ("a", "b"):
        own = df.where(F.col("g") == g)
        fitted = models.random_forest(own, "type", [1, 2], numTrees=3, maxDepth=2, featureSubsetStrategy="all")
        assert models.vote(own, {"f": fitted}, [1, 2]).where("predicted <> type").count() <= 2
