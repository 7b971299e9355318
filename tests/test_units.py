"""Hand-made rows for the edges that the provided tables do not have."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainspark.functions import parse
from grainspark.functions.durable import durable, release
from grainspark.operators import distributions, features, frames, graph, models, neighbours, outliers, ranking, relational, sampling, stats
from grainspark.operators.quantiles import quantiles
from grainspark.plans.training import Config, run_pipeline
from grainspark.sources import catalog, fixtures, tables
from grainspark.streaming.work import finished, run_pending, watch_inventory


def one(df, column):
    return [r[column] for r in df.collect()]


def test_frame_times(spark):
    df = spark.createDataFrame([("a_20250704183005267_1_AfterFPN.bmp",), ("a_2025070418300526_1.bmp",), ("x_20251399000000000_1.bmp",), (None,)], "n string")
    got = one(df.select(parse.frame_ts(F.col("n")).alias("t")), "t")
    assert got == [dt.datetime(2025, 7, 4, 18, 30, 5, 267000), None, None, None]


def test_chemistry_and_groups(spark):
    df = spark.createDataFrame([("2`5+100mM-0628-5-mix",), ("3mM-x",), ("1+2+3mM",), ("plain",), ("13mM",)], "f string")
    c = parse.chemistry(F.col("f"))
    rows = df.select(c["Na2CO3_mM"].alias("a"), c["CaCl_mM"].alias("b"), parse.replicate(F.col("f")).alias("r"), parse.concentration(F.col("f")).alias("g"), parse.concentration(F.col("f"), "val").alias("v")).collect()
    assert [(r.a, r.b, r.r) for r in rows] == [(2.5, 100.0, 5), (3.0, 3.0, None), (None, None, None), (None, None, None), (13.0, 13.0, None)]
    assert [r.g for r in rows] == ["3mM"] * 5
    assert rows[4].v == "3mM" and rows[3].v is None


def test_schema_rules(spark):
    df = parse.normalise_schema(spark.createDataFrame([(1, 2.0, "x")], "`NO.` int, Aera double, s string"))
    assert set(df.columns) == {"ID", "Area", "s", "Gray_ave", "overall_mean_gray"}
    assert parse.feature_columns(df) == ["Area", "Gray_ave", "overall_mean_gray"]


def test_stars_and_boxes(spark):
    assert one(spark.createDataFrame([(0.0001,), (0.005,), (0.04,), (0.5,), (None,)], "p double").select(parse.p_stars(F.col("p")).alias("s")), "s") == ["***", "**", "*", "ns", None]
    box = parse.bbox_window(spark.createDataFrame([("[2.5, 3.5, 4, 2]",)], "BoundingBox string"), border=1, height=5, width=5).first()
    assert (box.x0, box.y0, box.x1, box.y1) == (0, 2, 5, 5)


def test_three_hours(spark):
    start = dt.datetime(2025, 1, 1)
    rows = [("few", start + dt.timedelta(hours=i)) for i in range(19)] + [("many", start + dt.timedelta(minutes=10 * i)) for i in range(20)]
    kept = relational.limit_first_hours(spark.createDataFrame(rows, "folder string, ts timestamp_ntz")).groupBy("folder").count().collect()
    assert {r[0]: r[1] for r in kept} == {"few": 19, "many": 19}


def test_missing_is_null_or_nan(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert relational.drop_unlabelled(df, "x").count() == 2
    assert sorted(one(stats.impute_median(df, ["x"]), "x")) == [1.0, 2.0, 2.0, 3.0]
    r = stats.missing_report(df, ["x"]).first()
    assert (r.n_missing, r.median) == (2, 2.0)


def test_constant_column(spark):
    df = spark.createDataFrame([(2.0, 1), (2.0, 2)], "x double, c int")
    assert stats.low_variance(df, ["x"]).first().dropped
    assert one(stats.apply_scaler(df, stats.fit_scaler(df, ["x"]), ["x"]), "x") == [0.0, 0.0]
    assert {r.n for r in stats.histogram(df, "x", 5).collect()} == {2}
    assert features.clip(F.lit(1.0), 0.0, 1.0) is not None


def test_features_need_their_columns(spark):
    with pytest.raises(ValueError):
        features.engineer_features(spark.createDataFrame([(1.0,)], "Area double"))


def test_reports_cover_absent_classes(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (3, 2)], "t int, p int")
    by = {r["class"]: r for r in stats.classification_report(df, "t", "p").collect()}
    assert by["2"].support == 0 and by["2"].recall == 0.0 and by["3"].precision == 0.0
    assert by["1"].precision == 1.0 and by["1"].recall == 0.5
    assert stats.confusion_matrix(df, "t", "p", [1, 2, 3]).count() == 9


def test_split_is_a_partition_of_rows(spark):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).alias("c"))
    split = sampling.stratified_split(df, "c", "k")
    again = sampling.stratified_split(df.repartition(7), "c", "k")
    assert split.where("part = 'test'").count() == 7 + 7 + 7
    assert split.exceptAll(again.select(split.columns)).count() == 0
    assert {r[1] for r in sampling.undersample(df, "c", "k").groupBy("c").count().collect()} == {33}
    shares = sampling.stratified_split_approx(df, "c", "k").where("part = 'test'").count()
    assert 5 <= shares <= 40


def test_smote_points_lie_between_neighbours(spark):
    rows = [(f"a{i}", 0, [float(i), 0.0]) for i in range(12)] + [(f"b{i}", 1, [float(i), 10.0]) for i in range(5)]
    df = spark.createDataFrame(rows, "id string, label int, v array<double>")
    made = sampling.smote(df, "label", "id", "v").where("synthetic").collect()
    assert len(made) == 7 and all(r.label == 1 and r.v[1] == 10.0 and 0 <= r.v[0] <= 4 for r in made)
    with pytest.raises(ValueError):
        sampling.smote(df.where("label = 0 OR id IN ('b0', 'b1')"), "label", "id", "v")


def test_knn_blocks_do_not_matter(spark):
    df = spark.createDataFrame([(f"k{i}", [float(i * i % 17), float(i % 5)]) for i in range(40)], "id string, v array<double>")
    a = {tuple(r) for r in neighbours.knn_join(df, df, 3, "id", "v").collect()}
    b = {tuple(r) for r in neighbours.knn_join(df, df, 3, "id", "v", block=7).collect()}
    assert a == b and len(a) == 120


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, j) for j in range(101, 140)] + [(200, 200)]
    found = graph.least_labels(spark.range(210).withColumnRenamed("id", "node"), spark.createDataFrame(edges, "u long, v long"))
    labels = {r.node: r.label for r in found.collect()}
    assert {labels[i] for i in range(61)} == {0} and {labels[i] for i in range(100, 140)} == {100}
    assert labels[200] == 200 and len(labels) == 210


def test_rank_over_everything(spark):
    df = spark.range(500).select((F.col("id") * 37 % 101).alias("x"), "id")
    got = ranking.global_rank(df, [F.desc("x"), F.col("id")], 5).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 501))
    assert [(-r.x, r.id) for r in got] == sorted((-r.x, r.id) for r in got)


def test_rank_tests_agree_with_counting(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 4.0, 6.0, 7.0]
    df = spark.createDataFrame([("a", x) for x in a] + [("b", x) for x in b], "d string, x double")
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    r = distributions.mann_whitney(df, ["x"], "d", [("a", "b")]).first()
    assert r.u == u and 0 < r.mw_p < 1
    ks = distributions.ks_2samp(df, ["x"], "d", [("a", "b")]).first().ks
    assert math.isclose(ks, max(abs(sum(x <= v for x in a) / 4 - sum(x <= v for x in b) / 5) for v in a + b))


def test_chi_square_quantiles():
    assert math.isclose(outliers.chi2_quantile(0.9, 2), -2 * math.log(0.1), rel_tol=1e-9)
    assert math.isclose(outliers.chi2_quantile(0.95, 10), 18.307038, rel_tol=1e-6)


def test_soft_vote_ties(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.5, 0.5])], "a array<double>, b array<double>")
    r = models.soft_vote(df, ["a", "b"], [3, 7]).first()
    assert r.predicted == 3 and r.confidence == 0.5


def frame(spark, values, i=0):
    return spark.createDataFrame([(i, y, x, v) for y, row in enumerate(values) for x, v in enumerate(row)], "frame_id long, y int, x int, v int")


def test_peaks_at_the_ends(spark):
    assert frames.histogram_peak(frame(spark, [[0, 0, 5]])).first().peak == 0
    assert frames.histogram_peak(frame(spark, [[255, 255, 5]])).first().peak == 254
    assert frames.histogram_peak(frame(spark, [[9, 9, 4, 4]])).first().peak == 3


def test_flat_frames(spark):
    both = frame(spark, [[7, 7], [7, 7]]).unionByName(frame(spark, [[1, 2], [3, 4]], 1))
    for method in frames.METHODS:
        assert frames.normalise_frames(both, 1, method).count() == 8
    with pytest.raises(ValueError):
        frames.normalise_frames(both, 1, "other")
    flat = frames.denoise(frame(spark, [[9] * 12] * 12), 12, 12).select("v").distinct().collect()
    assert [r.v for r in flat] == [9]


def test_tiles_cover_and_stitch(spark):
    p = frame(spark, [[(y * 31 + x * 7) % 256 for x in range(13)] for y in range(11)])
    tiles = frames.tile(p, 11, 13, 6, 2)
    assert frames.stitch(tiles).exceptAll(p).count() == 0 and frames.stitch(tiles).count() == 143


def test_largest_object(spark):
    on = ["##...", "#....", "..###", "..#.#", "..###"]
    rows = [(1, y, x, c == "#") for y, row in enumerate(on) for x, c in enumerate(row)]
    best = frames.largest_object(spark.createDataFrame(rows, "crop long, y int, x int, on boolean"), 5, 5, fill_below=3)
    assert {(r.y, r.x) for r in best.collect()} == {(y, x) for y in (2, 3, 4) for x in (2, 3, 4)}


def test_tables_and_catalogues(spark, tmp_path):
    a = spark.createDataFrame([(1, 2.0)], "type int, Area double")
    tables.write_table(a, str(tmp_path / "one.parquet"))
    tables.write_table(spark.createDataFrame([(3,)], "type int"), str(tmp_path / "two.parquet"))
    both = tables.load_tables(spark, [str(tmp_path / "one.parquet"), str(tmp_path / "two.parquet")])
    assert both.count() == 2 and both.where("Area IS NULL").count() == 1
    listed = tables.list_frames(spark, str(tmp_path), glob="*.parquet", pattern="PART-")
    assert listed.count() >= 2 and "content" not in listed.columns
    with pytest.raises(ValueError):
        catalog.resolve_prediction_columns(a)
    bad = spark.createDataFrame([("f", "no-time.bmp"), ("f", "f_20250704183005267_1_AfterFPN.bmp")], "folder string, filename string")
    good, rejects = catalog.build_series(bad)
    assert good.count() == 1 and rejects.count() == 1


def test_stream_handles_each_file_once(spark, tmp_path):
    seen = []
    done = spark.createDataFrame([("a", 5, "gray")], "path string, done_mtime long, done_mode string")
    for k, rows in enumerate([[("a", 1)], [("b", 1)]]):
        spark.createDataFrame(rows, "path string, mtime long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = watch_inventory(spark, str(tmp_path / "in"), "path string, mtime long", lambda: done, lambda df, n: seen.extend(r.path for r in df.collect()), str(tmp_path / "cp"))
        q.awaitTermination(60)
        assert seen == ["b"][:k]


def test_bundles_and_pipeline(spark, sf_dir, tmp_path):
    df = fixtures.particles(spark, sf_dir).where("experiment = '3mM-1'")
    done = run_pipeline(df, Config(fixtures.FEATURES, kinds={"logistic": {"maxIter": 2, "regParam": 0.1}, "forest": {"numTrees": 2, "maxDepth": 2}}, selected=5, skip=("balance",)))
    assert {r.step: r.status for r in done.steps.collect()} == {"balance": "skipped", "train": "ok", "predict": "ok", "report": "ok"}
    tables.save_bundle(done.bundle, str(tmp_path / "m"), spark)
    again = tables.load_bundle(spark, str(tmp_path / "m"))
    a, b = (models.predict(df, x).select("row_id", "predicted") for x in (done.bundle, again))
    assert a.exceptAll(b).count() == 0


def test_plans_stay_on_the_jvm(spark, sf_dir):
    from grainspark.plans import registry

    for name in ("worst_classes", "d6_profile", "h1_ks_2samp", "l5_peak_align", "f2_balance_experiments"):
        plan = registry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan


def test_quantiles_are_those_of_all_values(spark):
    rng = np.random.default_rng(5)
    groups = {"a": rng.normal(size=5000), "hot": np.where(rng.random(40_000) < 0.6, 3.0, rng.random(40_000)), "one": np.array([7.0]), None: rng.integers(0, 4, 300).astype(float)}
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("a", float("nan")), ("a", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, value double").repartition(5)
    at = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    for accuracy in (200, 20_000):
        got = {r.g: (r.n, r.q) for r in quantiles(df, ["g"], at, accuracy=accuracy).collect()}
        assert got["none"] == (0, [None] * 6) and len(got) == 5
        for g, values in groups.items():
            assert got[g][0] == len(values) and np.allclose(got[g][1], np.quantile(values, at), rtol=1e-12)
    alone = quantiles(df, [], [0.5]).first()
    assert alone.n == sum(map(len, groups.values())) and np.isclose(alone.q[0], np.median(np.concatenate(list(groups.values()))))


def test_class_ranks_of_a_hot_class(spark):
    rows = [(f"k{i}", "hot" if i % 10 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, "key string, c string")
    ranked = sampling.with_class_rank(df, ["c"], "key", 42).collect()
    for c in ("hot", None):
        own = sorted((hashlib.md5(f"{r.key}|42".encode()).hexdigest(), r.key, r["__r"], r["__n"]) for r in ranked if r.c == c)
        assert [x[2] for x in own] == list(range(1, len(own) + 1)) and {x[3] for x in own} == {len(own)}


def test_rank_tests_of_a_skewed_feature(spark):
    """Nearly all values lie in a sliver of the range; the cells follow the values."""
    rng = np.random.default_rng(6)
    a, b = np.append(rng.lognormal(0, 2, 900), 1e9), np.append(rng.lognormal(0.3, 2, 700), 5e8)
    df = spark.createDataFrame([("x", float(v)) for v in a] + [("y", float(v)) for v in b], "d string, f double")
    got = distributions.drift_report(df, ["f"], "d", [("x", "y")]).first()
    every = np.sort(np.concatenate([a, b]))
    below = [np.searchsorted(np.sort(s), every, side="right") / len(s) for s in (a, b)]
    wins = sum((x > b).sum() + 0.5 * (x == b).sum() for x in a)
    assert np.isclose(got.ks, np.abs(below[0] - below[1]).max()) and np.isclose(got.median_difference, np.median(a) - np.median(b))
    assert np.isclose(distributions.mann_whitney(df, ["f"], "d", [("x", "y")]).first().u, wins)


def test_dbscan_search_finds_the_scale_of_two_groups(spark):
    rng = np.random.default_rng(7)
    rows = [(f"{side}{i}", [float(side) + float(x) for x in rng.normal(0, 0.05, 2)]) for side in (0, 5) for i in range(30)]
    df = spark.createDataFrame(rows, "id string, v array<double>")
    found, eps, scores = neighbours.dbscan_search(df, "id", "v")
    labels = {r.id: r.cluster for r in found.collect()}
    assert eps in scores and len(set(labels.values())) == 2 and len({labels[f"0{i}"] for i in range(30)}) == 1
    for e in (0.1, 0.3):
        pairs = neighbours.epsilon_pairs(df, "id", "v", 2.0)
        plain = neighbours.dbscan(df, "id", "v", e, 3).where("cluster IS NULL").count()
        assert neighbours.noise_counts(df.select(F.col("id").alias("u")), pairs, [0.1, 0.3], 3)[[0.1, 0.3].index(e)] == plain


def test_approximate_neighbours_recall(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (20, 8))
    df = spark.createDataFrame([(str(i), [float(x) for x in centres[i % 20] + rng.normal(0, 0.05, 8)]) for i in range(400)], "id string, v array<double>")
    exact = {(r.a_key, r.b_key) for r in neighbours.knn_join(df, df, 3, "id", "v").collect()}
    near = {(r.a_key, r.b_key) for r in neighbours.knn_join_approx(df, df, 3, "id", "v", radius=0.6).collect()}
    assert len(exact) == 1200 and len(exact & near) / len(exact) >= 0.9


def test_neighbours_within_uneven_classes(spark):
    rng = np.random.default_rng(9)
    rows = [(str(i), "big" if i < 50 else "small", [float(x) for x in rng.normal(size=3)]) for i in range(56)]
    df = spark.createDataFrame(rows, "id string, c string, v array<double>")
    got = {r.a_key: (r.b_key, r.distance) for r in neighbours.knn_join(df, df, 1, "id", "v", within="c", block=7).collect()}
    for i, c, v in rows:
        want = min((float(np.linalg.norm(np.array(v) - np.array(w))), j) for j, d, w in rows if d == c and j != i)
        assert got[i][0] == want[1] and np.isclose(got[i][1], want[0])


def test_denoise_of_other_depths_and_colour(spark):
    rng = np.random.default_rng(10)
    rows = [(f, y, x, int(1000 * f + 40 * rng.integers(0, 256))) for f in (1, 2) for y in range(6) for x in range(7)]
    deep = spark.createDataFrame(rows, "frame_id long, y int, x int, v int")
    got = frames.denoise(deep, 6, 7, h=40.0, search=4, rescale=True)
    low = {f: min(v for g, _, _, v in rows if g == f) for f in (1, 2)}
    high = {f: max(v for g, _, _, v in rows if g == f) for f in (1, 2)}
    eight = spark.createDataFrame([(f, y, x, int((v - low[f]) * 255 // (high[f] - low[f]))) for f, y, x, v in rows], "frame_id long, y int, x int, v int")
    want = {(r.frame_id, r.y, r.x): int(r.v / 255 * (high[r.frame_id] - low[r.frame_id]) + low[r.frame_id]) for r in frames.denoise(eight, 6, 7, h=40.0, search=4).collect()}
    assert {(r.frame_id, r.y, r.x): r.v for r in got.collect()} == want
    colour = spark.createDataFrame([(1, y, x, 200, 30, 90, y) for y in range(5) for x in range(5)], "frame_id long, y int, x int, r int, g int, b int, a int")
    done = frames.denoise_colour(colour, 5, 5, search=4).collect()
    assert len(done) == 25 and all(abs(r.r - 200) <= 1 and abs(r.g - 30) <= 1 and abs(r.b - 90) <= 1 and r.a == r.y for r in done)


def test_starting_means_know_all_pixels(spark):
    """A value that fills nearly the whole crop must not be counted as a thousand pixels."""
    rows = [(1, i % 100, i // 100, 10 if i < 9000 else 100 if i < 9600 else 200) for i in range(10_000)]
    crops = spark.createDataFrame(rows, "crop int, bx int, by int, v int")
    got = {r.v: (r.phase, r.background) for r in frames.segment_phases(crops, "crop", 3, ring=2).collect()}
    assert got[10] == (0, True) and len({p for p, _ in got.values()}) >= 1


def test_released_tables_are_gone(spark):
    import os

    kept, gone = durable(spark.range(5).toDF("u")), durable(spark.range(3).toDF("u"))
    path = gone.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(path.replace("///", "/"))
    release(gone, spark.range(2).toDF("u"))
    assert not os.path.exists(path.replace("///", "/")) and kept.count() == 5


def test_density_counts_every_value(spark):
    rng = np.random.default_rng(12)
    values = {"a": [*rng.normal(5, 2, 300), 5.0, 5.0], None: [*rng.exponential(1, 40)], "few": [1.0] * 5, "flat": [2.0] * 9}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("a", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {(r.g, r.k): (r.x, r.density) for r in stats.kde(df, "v", ["g"], points=21).collect()}
    near = {(r.g, r.k): r.density for r in stats.kde(df, "v", ["g"], points=21, cells=500).collect()}
    assert {g for g, _ in got} == {"a", None} and got.keys() == near.keys()
    for g in ("a", None):
        v = np.array(values[g])
        h = len(v) ** -0.2 * v.std(ddof=1)
        for k, x in enumerate(np.linspace(v.min(), v.max(), 21)):
            want = np.exp(-0.5 * ((x - v) / h) ** 2).sum() / (len(v) * h * np.sqrt(2 * np.pi))
            assert np.isclose(got[g, k][0], x) and np.isclose(got[g, k][1], want, rtol=1e-12)
            assert abs(near[g, k] - want) <= 0.121 * (v.max() - v.min()) / 500 / h**2


def test_first_rows_of_classes_are_those_of_a_sort(spark, monkeypatch):
    rng = np.random.default_rng(13)
    rows = [(None if i % 50 == 0 else "big" if i % 3 else "small", bool(i % 2), f"k{i}") for i in range(2000)] + [("twins", True, "same")] * 4
    df = spark.createDataFrame(rows, "c string, d boolean, k string").repartition(5)
    found = sampling.ClassHashes(df, ["c", "d"], "k", 7)
    assert found.sizes == {n: sum((c, d) == v for c, d, _ in rows) for n, v in found.values.items()} and len(found.sizes) == 6
    wanted = {n: int(rng.integers(0, k + 1)) for n, k in found.sizes.items()} | {n: 2 for n, v in found.values.items() if v[0] == "twins"}
    for digits, last in ((1, 0), (3, 100_000)):
        monkeypatch.setattr(sampling, "DIGITS", digits)
        monkeypatch.setattr(sampling, "LAST", last)
        got = {}
        for r in df.where(sampling.ClassHashes(df, ["c", "d"], "k", 7).first(wanted)).collect():
            got.setdefault((r.c, r.d), set()).add(r.k)
        for name, v in found.values.items():
            keys = sorted((k for c, d, k in rows if (c, d) == v), key=lambda k: hashlib.md5(f"{k}|7".encode()).hexdigest())
            want = set(keys[: wanted[name]]) if v[0] != "twins" else set()  # rows of one key do not all fit, and stay out together
            assert got.get(v, set()) == want


def test_splits_need_no_window_over_rows(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("c"), F.col("id").alias("k"))
    for out in (sampling.stratified_split(df, "c", "k"), sampling.undersample(df, "c", "k")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "Window" not in plan and "Join" not in plan and "Sort" not in plan


def flood(pixels):
    """Least pixel of each pixel's 4-connected object."""
    out = {}
    for p in sorted(pixels):
        todo = [p] if p not in out else []
        while todo:
            y, x = todo.pop()
            if (y, x) in pixels and (y, x) not in out:
                out[y, x] = p
                todo += [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return out


@pytest.mark.parametrize("tile", [3, 8, 512])
def test_objects_from_runs_in_tiles(spark, tile):
    rng = np.random.default_rng(14)
    shapes = {k: {(y, x) for y in range(17) for x in range(19) if rng.random() < share} for k, share in enumerate((0.35, 0.6, 0.85, 0.02))}
    rows = [(k, y, x, (y, x) in s) for k, s in shapes.items() for y in range(17) for x in range(19)]
    mask = spark.createDataFrame(rows, "crop long, y int, x int, on boolean").repartition(4)
    got = {}
    for r in frames.largest_object(mask, 17, 19, fill_below=4, tile=tile).collect():
        got.setdefault(r.crop, set()).add((r.y, r.x))
    for k, s in shapes.items():
        holes = flood({(y, x) for y in range(17) for x in range(19)} - s)
        sizes = {}
        for o in holes.values():
            sizes[o] = sizes.get(o, 0) + 1
        objects = flood(s | {p for p, o in holes.items() if sizes[o] < 4})
        count = {}
        for o in objects.values():
            count[o] = count.get(o, 0) + 1
        best = min(count, key=lambda o: (-count[o], o))
        assert got[k] == {p for p, o in objects.items() if o == best}


def test_runs_meet_without_pixels_as_nodes():
    y, x0, x1 = np.array([0, 0, 1, 2, 2]), np.array([5, 0, 2, 4, 0]), np.array([9, 2, 5, 4, 0])
    found = frames.tile_runs(y, x0, x1)
    assert [tuple(map(int, r)) for r in zip(*found, strict=True)] == [(0, 0, 2, 0, 0), (0, 5, 9, 0, 0), (1, 2, 5, 0, 0), (2, 0, 0, 2, 0), (2, 4, 4, 0, 0)]


def test_a_replayed_batch_does_its_work_once(spark, tmp_path):
    before = spark.createDataFrame([("old", 5, "gray"), ("stale", 1, "gray")], "path string, done_mtime long, done_mode string")
    place = [str(tmp_path / n) for n in ("in", "sink", "state")]

    def arrive(rows):
        spark.createDataFrame(rows, "path string, mtime long").coalesce(1).write.mode("append").parquet(place[0])

    def work():
        run_pending(spark, place[0], "path string, mtime long", before, place[1], place[2], files_per_batch=1).awaitTermination(120)
        return sorted((r.path, r.done_mtime, r.reason, r.batch) for r in finished(spark, place[1]).collect())

    arrive([("old", 5), ("stale", 2), ("a", 1)])
    first = work()
    assert first == [("a", 1, "new", 0), ("stale", 2, "newer", 0)] and work() == first
    arrive([("a", 1), ("stale", 3), ("b", 1)])
    second = work()
    assert second == sorted([*first, ("b", 1, "new", 1), ("stale", 3, "newer", 1)])
    (tmp_path / "state" / "commits" / "1").unlink()  # the second batch ended without being committed
    for c in (tmp_path / "state" / "commits").glob(".1*"):
        c.unlink()
    assert work() == second


def test_samples_of_trees_are_the_least_hashes(spark):
    rows = [(f"k{i}", float(i), float(-i)) for i in range(700)] + [("none", None, 1.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(6)
    got = {}
    for r in outliers.tree_samples(df, ["a", "b"], "k", 5, 40, 3).collect():
        got.setdefault(r.tree, set()).add(r.k)
    h = {r.k: r.h for r in df.select("k", F.xxhash64("k", F.lit(3)).alias("h")).collect()}
    keys = [k for k, *_ in rows[:-1]]
    order = outliers._tree_hashes(np.array([h[k] for k in keys], np.int64), 5, 3)
    assert got == {t: {keys[i] for i in np.argsort(order[:, t])[:40]} for t in range(5)}
    few = outliers.tree_samples(df.where("a < 7"), ["a", "b"], "k", 3, 40).groupBy("tree").count().collect()
    assert {(r.tree, r["count"]) for r in few} == {(0, 7), (1, 7), (2, 7)}
    assert outliers.tree_samples(df.where("false"), ["a", "b"], "k", 3, 40).collect() == []


def test_robust_covariance_finds_the_least_determinant(spark):
    from itertools import combinations

    rng = np.random.default_rng(15)
    x = np.concatenate([rng.normal(0, 1, (9, 2)), rng.normal(8, 0.5, (3, 2))])
    df = spark.createDataFrame([(f"k{i}", float(a), float(b)) for i, (a, b) in enumerate(x)], "k string, a double, b double").repartition(3)
    h = (12 + 2 + 1) // 2
    best = min(float(np.linalg.det(np.cov(x[list(c)].T, bias=True) + 1e-6 * np.eye(2))) for c in combinations(range(12), h))
    mean, cov, det = outliers.robust_covariance(df, ["a", "b"], starts=40, kept=40, key="k")
    assert np.isclose(det, best, rtol=1e-6) and np.abs(mean).max() < 1.5 and (np.linalg.eigvalsh(cov) > 0).all()


def test_robust_covariance_resists_planted_outliers(spark):
    rng = np.random.default_rng(16)
    true = np.array([[2.0, 0.8], [0.8, 1.0]])
    x = np.concatenate([rng.multivariate_normal([1, -1], true, 1400), rng.normal(12, 0.3, (600, 2))])  # 30 of 100
    df = spark.createDataFrame([(f"k{i}", float(a), float(b)) for i, (a, b) in enumerate(x)], "k string, a double, b double").repartition(4)
    mean, cov, _ = outliers.robust_covariance(df, ["a", "b"], key="k")
    assert np.allclose(mean, [1, -1], atol=0.25) and np.linalg.det(cov) < 6 * np.linalg.det(true)
    out = outliers.robust_envelope(df, df, ["a", "b"], contamination=0.3, key="k")
    flagged = {r.k for r in out.where("envelope_outlier").collect()}
    assert len(flagged & {f"k{i}" for i in range(1400, 2000)}) > 590
    with pytest.raises(ValueError):
        outliers.robust_covariance(df.limit(3), ["a", "b"], key="k")


def test_running_sums_keep_to_one_set_of_cells(spark):
    """A sketch's marks change with the order its parts arrive in, so the plan, which needs them twice, must not compute them."""
    df = spark.range(1000).select(F.lit("x").alias("k"), F.col("id").cast("double").alias("value"), F.lit(1).cast("long").alias("na"), F.lit(2).cast("long").alias("nb"))
    found = distributions.below(df, ["k"])
    assert "percentile_approx" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted((r["value"], r["ba"], r["bb"]) for r in found.collect()) == [(float(v), v, 2 * v) for v in range(1000)]


def test_fitting_leaves_no_tables(spark, sf_dir):
    """The tables of a fit's passes go once it is done."""
    from pathlib import Path

    from grainspark.functions.durable import shared_folder

    folder = Path(shared_folder(spark).removeprefix("file:"))
    df = fixtures.particles(spark, sf_dir).where("l_orderkey % 50 = 0")
    before = set(folder.glob("table-*"))
    models.fit_matrix(df, "type", ["Area", "Circularity"], 3)
    assert set(folder.glob("table-*")) == before
