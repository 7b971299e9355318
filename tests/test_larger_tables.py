"""What showed on larger tables and on several executors only."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainspark.functions.durable import durable
from grainspark.operators import clusters, distributions, frames, models, outliers, quantiles, ranking, sampling, stats
from grainspark.plans import learning, tables

#: A frame whose deviation differs in the last bit by the formula of the update, and with it a grey level.
FRAME = [207, 73, 121, 172, 138, 123, 171, 150, 144, 167, 127, 120, 171, 140, 112, 172, 112, 123, 153, 128, 112, 112, 117, 101, 103, 105, 66, 59, 140, 125, 171, 143, 83, 119, 128, 125, 148, 164, 123, 98, 63, 137, 93, 135, 152, 140, 108, 68, 137, 126, 141, 111, 140, 99, 124, 138, 147, 122, 89, 77, 132, 138, 83, 145]


def deviation(values) -> float:
    n = mean = square = 0.0
    for x in values:
        n += 1.0
        new = mean + (x - mean) / n
        square, mean = square + (x - new) * (x - mean), new
    return math.sqrt(square / n)


@pytest.mark.parametrize("parts", [1, 7])
def test_z_score_of_the_reference_takes_deviations_in_pixel_order(spark, parts):
    rows = [(k, i // 8, i % 8, v // (k + 1)) for k in range(2) for i, v in enumerate(FRAME)]
    pixels = spark.createDataFrame(rows, "frame_id long, y int, x int, v int").repartition(parts, "x")
    got = {(r.frame_id, r.y, r.x): r.v for r in frames.normalise_frames(pixels, 0, "z_score", ordered=True).collect()}
    r_mean, r_std = sum(FRAME) / 64, deviation(FRAME)
    for k in range(2):
        values = [v // (k + 1) for v in FRAME]
        mean, std = sum(values) / 64, deviation(values)
        want = [int(max(0.0, min(255.0, (v - mean) / std * r_std + r_mean))) for v in values]
        assert [got[k, i // 8, i % 8] for i in range(64)] == want


def test_peak_spread_of_shifted_frames_takes_deviations_in_pixel_order(spark):
    rows = [(k, i // 8, i % 8, v + k) for k in range(40) for i, v in enumerate(FRAME)]
    pixels = spark.createDataFrame(rows, "frame_id long, y int, x int, v int")
    got = {(r.frame_id, r.y, r.x): r.v for r in frames.normalise_frames(pixels, 0, "peak_spread_align", ordered=True).collect()}
    peaks = {r.frame_id: r.peak for r in frames.histogram_peak(pixels).collect()}
    for k in range(40):
        ratio = deviation(FRAME) / deviation([v + k for v in FRAME])
        want = [int(max(0.0, min(255.0, peaks[0] + ((v + k + (peaks[0] - peaks[k])) - peaks[0]) * ratio))) for v in FRAME]
        assert [got[k, i // 8, i % 8] for i in range(64)] == want


def test_ordered_deviation_of_odd_frames(spark):
    rows = [(0, 0, 0, 5), (1, 0, 0, None), (2, 0, 1, 3), (2, 0, 0, None), (2, 1, 0, 9)]
    got = {r.frame_id: r.std for r in frames.ordered_deviation(spark.createDataFrame(rows, "frame_id long, y int, x int, v int")).collect()}
    assert got == {0: 0.0, 1: None, 2: 3.0}


def test_running_sums_with_marks_that_differ_whenever_they_are_computed(spark, monkeypatch):
    """As a sketch's marks do where its parts arrive in another order, on several executors."""
    monkeypatch.setattr(distributions.F, "percentile_approx", lambda c, at, accuracy: F.array(F.max(c) * F.rand(), F.max(c) * F.rand()))
    counts = spark.range(0, 3000, 1, 7).selectExpr("id % 2 AS g", "double(id div 2) AS value", "id % 3 AS na", "id % 5 AS nb")
    got = {(r.g, r.value): (r.ba, r.bb, r.ta, r.tb) for r in distributions.below(counts, ["g"]).collect()}
    for g in (0, 1):
        own = range(g, 3000, 2)
        ba = bb = 0
        for i in own:
            assert got[g, float(i // 2)] == (ba, bb, sum(k % 3 for k in own), sum(k % 5 for k in own))
            ba, bb = ba + i % 3, bb + i % 5


def test_what_asks_for_means_alone_counts_no_values(spark, sf_dir, monkeypatch):
    def never(*args):
        raise AssertionError("values are counted")

    monkeypatch.setattr(distributions, "below", never)
    for name in ("d22_effect_pivot", "d23_feature_problem_rank", "e2_top_effects"):
        assert learning.QUERIES[name](spark, sf_dir).count() > 0


def test_effects_without_tests_have_the_rows_of_those_with_tests(spark):
    rows = [(k % 3 if k % 7 else None, k % 2 if k % 5 else None, float(k) if k % 11 else None) for k in range(60)]
    df = spark.createDataFrame(rows, "t int, p int, x double")
    both = [sorted(tuple(r) for r in distributions.error_feature_effects(df, ["x"], "t", "p", tests).drop("mw_p").collect()) for tests in (True, False)]
    assert both[0] == both[1]


def test_predictions_are_joined_where_row_ids_repeat(spark, sf_dir, tmp_path):
    assert learning.has_row_keys(spark, sf_dir)
    for name in ("lineitem", "orders", "part", "supplier", "nation"):
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        (table.union(table.limit(1)) if name == "lineitem" else table).write.parquet(f"{tmp_path}/{name}.parquet")
    assert not learning.has_row_keys(spark, str(tmp_path))
    one, twice = (learning.scored(spark, d).groupBy("row_id").count().groupBy("count").count().collect() for d in (sf_dir, str(tmp_path)))
    assert {r[0] for r in one} == {1} and {r[0]: r[1] for r in twice}[4] == 1


def test_confusions_read_their_table_once(spark):
    rows = [(k % 3 if k % 7 else None, k % 2 if k % 5 else None, float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "t int, p int, x double").where("x >= 0")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = {(r.true_class, r.predicted_class): (r.mean_confused, r.n, r.mean_right) for r in distributions.confusion_feature_effects(df.mapInArrow(count, df.schema), ["x"], "t", "p").collect()}
    assert seen.value == 60

    def mean(t, p):
        own = [x for a, b, x in rows if (a, b) == (t, p)]
        return sum(own) / len(own), len(own)

    assert got == {(t, p): (*mean(t, p), mean(t, t)[0]) for t, p in ((0, 1), (1, 0))}


def test_ranks_of_predictions_store_what_is_returned_only(spark, sf_dir, monkeypatch):
    stored = []
    monkeypatch.setattr(ranking, "durable", lambda df: stored.append(set(df.columns)) or durable(df))
    assert tables.QUERIES["e1_rank_predictions"](spark, sf_dir).count() == 6000
    assert {"experiment", "row_id", "confidence", "__part"} in stored and max(map(len, stored)) == 4


@pytest.fixture
def stored_tables(monkeypatch):
    """The columns of each table that is stored by the modules named."""
    found = []

    def keep(df):
        found.append(df.columns)
        return durable(df)

    for module in (quantiles, stats):
        monkeypatch.setattr(module, "durable", keep)
    return found


def test_distances_of_counted_rows_are_selected_exactly(spark):
    rng = np.random.default_rng(7)
    x, n = rng.normal(size=(500, 2)), rng.integers(1, 50, 500)
    counted = spark.createDataFrame([(*map(float, v), int(k)) for v, k in zip(x, n, strict=True)], "a double, b double, __n long").repartition(3)
    means, inverses = np.array([[0.0, 0.0], [1.0, -1.0]]), np.array([np.eye(2), [[2.0, 0.5], [0.5, 1.0]]])
    for rank in (1, int(n.sum()) // 2, int(n.sum())):
        got = outliers._limits(counted, ["a", "b"], means, inverses, rank)
        for k in range(2):
            d2 = outliers._squared(x, means[k], inverses[k])
            assert got[k] == np.sort(np.repeat(d2, n))[rank - 1]


def test_concentration_steps_read_equal_rows_once(spark, monkeypatch):
    seen, sums = [], outliers._sums
    monkeypatch.setattr(outliers, "_sums", lambda counted, *a: seen.append((counted.count(), counted.rdd.getNumPartitions())) or sums(counted, *a))
    df = spark.range(4000).selectExpr("id % 10 * 1.0D AS a", "id % 7 * id % 3 * 1.0D AS b").repartition(8)
    outliers.robust_covariance(df, ["a", "b"])
    assert set(seen) == {(df.distinct().count(), 1)}


def test_mixtures_read_equal_rows_once_in_few_tasks(spark, monkeypatch):
    seen, fit = [], clusters.GaussianMixture.fit
    monkeypatch.setattr(clusters.GaussianMixture, "fit", lambda self, df: seen.append((df.count(), df.rdd.getNumPartitions())) or fit(self, df))
    df = clusters.with_vector(spark.range(2000).selectExpr("id % 20 * 1.0D AS a", "id % 20 % 3 * 1.0D AS b").repartition(8), ["a", "b"])
    model, _ = clusters.gmm_best_k(df, [2], max_iter=3)
    assert seen == [(20, 1)]
    assert sum(model.weights) == pytest.approx(1.0)


def test_sketches_of_quantiles_are_stored(spark, stored_tables):
    df = spark.range(300).selectExpr("id % 3 AS g", "cast(id AS double) AS value", "'wide' AS more")
    stats.box_stats(df, "value", ["g"])
    assert stored_tables == [["g", "value"], ["g", "n", "__m"], ["g", "q1", "median", "q3"]]


@pytest.mark.parametrize("query", [learning.i6, learning.k3, learning.k4])
def test_queries_of_many_passes_join_the_particle_tables_once(spark, query):
    assert not [f for f in query(spark, "/root/testdata/sf0.001").inputFiles() if "lineitem" in f]


@pytest.fixture
def particle_reads(monkeypatch):
    """What each table stored and each result of a model query reads, as often as it is stored."""
    found = []

    def keep(df):
        found.append((df.columns, [f for f in df.inputFiles() if "lineitem" in f]))
        return durable(df)

    for module in (models, learning):
        monkeypatch.setattr(module, "durable", keep)
    return found


@pytest.mark.parametrize("query", [learning.j12, learning.a11])
def test_fits_and_their_results_join_the_particle_tables_once(spark, particle_reads, query):
    out = query(spark, "/root/testdata/sf0.001")
    assert [bool(lines) for _, lines in particle_reads].count(True) == 1
    assert not [f for f in out.inputFiles() if "lineitem" in f]
    assert not any("row_id" in columns for columns, _ in particle_reads)


def test_folds_deal_neither_keys_nor_hashes_as_text(spark):
    df = spark.range(50).selectExpr("concat('key-', id) AS key", "id % 2 AS c", "id * 1.0D AS x")
    plan = sampling.stratified_folds(df, "c", "key", 3).drop("key")._jdf.queryExecution().optimizedPlan().toString()
    window = plan.split("Window [row_number()")[1].splitlines()[1]  # what the window's rows consist of
    assert "__h" in window and "key#" not in window.split("[")[1].split("]")[0]


def test_searches_store_one_table_of_rows_and_a_matrix_for_each_fold(spark, particle_reads):
    learning.j6(spark, "/root/testdata/sf0.001")
    assert sum("features" in columns for columns, _ in particle_reads) == 2
    assert sum("Area" in columns for columns, _ in particle_reads) == 1


@pytest.mark.parametrize("query", [learning.j5, learning.j6, learning.j8])
def test_rows_of_folds_are_stored_once_and_not_dealt(spark, monkeypatch, query):
    """Nor are the particle tables joined again for the count, and a matrix is stored by columns."""
    kinds, reads = [], []

    def keep(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        kinds.extend(t for c, t in df.dtypes if c == "features")
        reads.append(any("lineitem" in f for f in df.inputFiles()))
        assert "Window" not in plan
        return durable(df)

    monkeypatch.setattr(models, "durable", keep)
    out = query(spark, "/root/testdata/sf0.001")
    assert reads.count(True) == 1 and not [f for f in out.inputFiles() if "lineitem" in f]
    assert len(kinds) == 2 and all(t.startswith("struct<") for t in kinds)


@pytest.mark.parametrize("k", [2, 3, 5])
def test_folds_by_stretches_of_the_hash_order(spark, monkeypatch, k):
    monkeypatch.setattr(sampling, "LAST", 10)
    df = spark.range(1, 400, 1, 5).selectExpr("id AS key", "CASE WHEN id % 9 = 0 THEN NULL ELSE id % 3 % 2 END AS c").union(spark.createDataFrame([(1000, 7)], "key long, c long"))
    found = sampling.ClassHashes(df, ["c"], "key", 42)
    rows = df.withColumn("fold", sampling.hash_folds(found, k, sampling.hash_order("key", 42))).withColumn("h", sampling.hash_order("key", 42)).collect()
    for c in (None, 0, 1, 7):
        own = sorted((r.h, r.fold) for r in rows if r.c == c)
        n = len(own)
        assert [fold for _, fold in own] == [next(f for f in range(k) if (n * (f + 1)) // k > i) for i in range(n)]
