"""Queries over particle tables and predictions: catalogues, parsing, joins, profiles and evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from grainspark.functions import parse
from grainspark.functions.durable import shared_folder
from grainspark.operators import ranking, relational, stats
from grainspark.plans.base import Query
from grainspark.plans.sqlviews import BOXES, FILES, FRAMES, PARTICLES, PIXELS, PREDICTIONS, SERIES, with_views
from grainspark.sources import catalog, tables
from grainspark.sources import fixtures as fx
from grainspark.streaming import work

LONG_COLS = ["Area", "Circularity", "Gray_kur", "dis"]
PAIRS = [("train", "test"), ("train", "val"), ("test", "val")]


def unpivot_sql(source: str, keys: str, cols: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT {keys}{', ' if keys else ''}'{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {source}" for c in cols)


def done_files(spark, sf_dir):
    base = fx.files(spark, sf_dir).where("doc_id % 3 = 0")
    return base.selectExpr("path", "mtime + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END AS done_mtime", "CASE WHEN doc_id % 5 = 0 THEN 'channel' ELSE 'gray' END AS done_mode")


DONE_SQL = "done AS (SELECT path, mtime + CASE WHEN doc_id % 2 = 0 THEN 1 ELSE -1 END AS done_mtime, CASE WHEN doc_id % 5 = 0 THEN 'channel' ELSE 'gray' END AS done_mode FROM files WHERE doc_id % 3 = 0)"


def labelled(spark, sf_dir):
    return fx.particles(spark, sf_dir).withColumn("type", F.when(F.col("l_suppkey") % 41 != 0, F.col("type")))


LABELLED = PARTICLES + ", labelled AS (SELECT * EXCLUDE (type), CASE WHEN l_suppkey % 41 <> 0 THEN type END AS type FROM particles)"


def folder_of(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def a4(spark, sf_dir):
    """The files of a written table, one folder for each experiment, found again by their paths."""
    root = folder_of(spark)
    tables.write_table(fx.particles(spark, sf_dir).select("experiment", "row_id"), root, partition_by=("experiment",))
    found = tables.list_frames(spark, root, "*.parquet", "PART-")
    none = tables.list_frames(spark, root, "*.parquet", "PART-", ignore_case=False)
    by = found.groupBy(F.regexp_extract("path", "experiment=([^/]+)/", 1).alias("experiment")).agg((F.count("*") > 0).alias("found"), (F.min("length") > 0).alias("has_bytes"))
    return by.crossJoin(none.agg(F.count("*").alias("n_case_sensitive")))


def a10(spark, sf_dir):
    """A table written in two formats and read back."""
    df, out = fx.predictions(spark, sf_dir).select("row_id", "split", "enhanced", "confidence"), None
    for fmt in ("parquet", "csv"):
        root = folder_of(spark)
        tables.write_table(df, root, fmt, ("split",), **({"header": "true"} if fmt == "csv" else {}))
        back = spark.read.format(fmt).options(header="true", inferSchema="true").load(root)
        one = back.groupBy("split").agg(F.count("*").alias("n"), F.sum("enhanced").alias("enhanced"), F.avg("confidence").alias("confidence")).withColumn("format", F.lit(fmt))
        out = one if out is None else out.unionByName(one)
    return out


def b4(spark, sf_dir):
    series = fx.frames(spark, sf_dir).unionByName(fx.frames(spark, sf_dir).withColumn("folder", F.concat(F.lit("run-"), F.col("frame_id") % 3)))
    return catalog.attach_chemistry(series).withColumn("replicate", F.coalesce("replicate", F.lit(-1))).groupBy("folder", "Na2CO3_mM", "CaCl_mM", "replicate", "status").agg(F.count("*").alias("n"))


def d5_top(spark, sf_dir):
    scores = stats.anova_f(fx.particles(spark, sf_dir), "experiment", LONG_COLS + ["MeanIntensity", "Perimeter"]).withColumn("f", F.round("f", 4))
    return stats.compare_top(scores, ["Area", "Circularity", "dis", "Perimeter"], (2, 4, 9))


def a5(spark, sf_dir):
    return catalog.work_counts(catalog.pending_work(fx.files(spark, sf_dir), done_files(spark, sf_dir)))


def a5_stream(spark, sf_dir):
    """The inventory comes as files of a stream, in two calls; the second takes only what the first has not seen."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    rows = fx.files(spark, sf_dir).select("path", F.col("mtime").cast("long").alias("mtime"), "doc_id")
    for half in range(2):
        rows.where(F.col("doc_id") % 2 == half).drop("doc_id").write.mode("append").parquet(f"{folder}/inventory")
        work.run_pending(spark, f"{folder}/inventory", "path string, mtime long", done_files(spark, sf_dir), f"{folder}/sink", f"{folder}/state", files_per_batch=4).awaitTermination()
    return work.finished(spark, f"{folder}/sink").select("path", F.col("done_mtime").alias("mtime"), "reason")


def a6(spark, sf_dir):
    return catalog.build_series(fx.frames(spark, sf_dir).drop("ts"))[0]


def a12(spark, sf_dir):
    base = fx.table(spark, sf_dir, "supplier")
    registry = base.selectExpr("concat('g', s_nationkey) AS grp", "element_at(array('model', 'scaler', 'selector', 'metadata'), cast(s_suppkey % 4 as int) + 1) AS artefact")
    groups = fx.table(spark, sf_dir, "nation").selectExpr("concat('g', n_nationkey) AS grp")
    return catalog.models_present(registry, groups, "grp", "artefact", ("model", "scaler", "selector"))


def b2(spark, sf_dir):
    f = fx.frames(spark, sf_dir).select("folder").distinct()
    c = parse.chemistry(F.col("folder"))
    return f.select("folder", c["Na2CO3_mM"].alias("na"), c["CaCl_mM"].alias("ca"), parse.replicate(F.col("folder")).alias("replicate"))


def b6(spark, sf_dir):
    df = parse.normalise_schema(fx.particles(spark, sf_dir).withColumnRenamed("Area", "Aera").withColumnRenamed("row_id", "NO."))
    return df.groupBy("experiment").agg(F.count("ID").alias("n"), F.avg("Area").alias("area"), F.avg("Gray_ave").alias("grey"))


def b8(spark, sf_dir):
    df = fx.particles(spark, sf_dir)
    coded = parse.encode_labels(df, parse.label_codes(df.where("type <> 2"), "type"), "type", unknown=0)
    back = parse.decode_labels(F.col("type_code"), {0: 1, 1: 2, 2: 3, 3: 4})
    return coded.groupBy("type", "type_code", back.alias("decoded")).agg(F.count("*").alias("n"))


def b10(spark, sf_dir):
    f = fx.files(spark, sf_dir)
    return f.select("doc_id", parse.derive_name(F.col("path"), add="_nlm_filtered").alias("added"), parse.derive_name(F.col("path"), remove="_nlm_filtered", extension=".tif").alias("removed"))


def b12(spark, sf_dir):
    p = fx.pixels(spark, sf_dir).withColumns({"r": F.col("v"), "g": 255 - F.col("v"), "b": (F.col("v") * 7) % 256})
    p = p.withColumn("gray", parse.to_gray(F.col("r"), F.col("g"), F.col("b"))).withColumn("four", parse.channel(4, F.col("r"), F.col("g"), F.col("b"), F.lit(None).cast("int")))
    return p.groupBy("frame_id").agg(F.sum("gray").alias("gray"), F.sum("four").alias("four"))


def c2(spark, sf_dir):
    df = fx.particles(spark, sf_dir)
    seen, unseen = relational.keep_seen_labels(df.where("split = 'val'"), df.where("split = 'train' AND type <> 4"), "type")
    return seen.groupBy(F.lit("seen").alias("kind"), "type").agg(F.count("*").alias("n")).unionByName(unseen.groupBy(F.lit("unseen").alias("kind"), "type").agg(F.count("*").alias("n")))


def c4(spark, sf_dir):
    df = fx.particles(spark, sf_dir)
    return relational.holdout_by_source(df, df.where("split = 'train'")).groupBy("source_file").agg(F.count("*").alias("n"))


def c7(spark, sf_dir):
    raw = fx.frames(spark, sf_dir)
    filtered = raw.select("folder", parse.derive_name(F.col("filename"), add="_nlm_filtered", extension=".tiff").alias("filename")).where("filename NOT LIKE '%\\\\_7\\\\_AfterFPN%'")
    return relational.pair_frames(raw, filtered)


def c9(spark, sf_dir):
    window = parse.bbox_window(fx.boxes(spark, sf_dir), border=1, height=8, width=8)
    crop = relational.crop_pixels(window, fx.pixels(spark, sf_dir), side=4)
    return crop.groupBy("frame_id").agg(F.count("*").alias("n"), F.sum("v").alias("v"), F.sum(F.col("bx") * F.col("by")).alias("moment"))


def c11(spark, sf_dir):
    return relational.dataset_shares(relational.with_combined(fx.particles(spark, sf_dir).withColumnRenamed("experiment", "dataset")))


def d3(spark, sf_dir):
    df = fx.particles(spark, sf_dir).withColumn("flat", F.lit(3.0))
    return stats.low_variance(df, [*LONG_COLS, "flat"])


def d2(spark, sf_dir):
    df = fx.particles(spark, sf_dir)
    filled = stats.impute_median(df, ["Gray_kur"]).groupBy("experiment").agg(F.count("Gray_kur").alias("n"), F.avg("Gray_kur").alias("mean"))
    report = stats.missing_report(df, LONG_COLS)
    return report.select(F.concat(F.lit("feature:"), "feature").alias("what"), F.col("n_missing").alias("n"), F.col("median").alias("value")).unionByName(filled.select(F.concat(F.lit("filled:"), "experiment").alias("what"), "n", F.col("mean").alias("value")))


def d4(spark, sf_dir):
    df = fx.particles(spark, sf_dir)
    scaled = stats.apply_scaler(df, stats.fit_scaler(df.where("split = 'train'"), LONG_COLS), LONG_COLS)
    return scaled.groupBy("split").agg(*(F.avg(c).alias(c) for c in LONG_COLS))


def predictions_with_split(spark, sf_dir):
    return fx.predictions(spark, sf_dir)


def e1(spark, sf_dir):
    # Only what is returned is stored and dealt.
    return ranking.rank_predictions(fx.predictions(spark, sf_dir).select("experiment", "row_id", "confidence"), "confidence", "row_id", "experiment")


def d16(spark, sf_dir):
    return stats.scoreboard(fx.predictions(spark, sf_dir), "type", "enhanced", "confidence")


def d16_bands(spark, sf_dir):
    p = fx.predictions(spark, sf_dir)
    acc = p.where("split <> 'train'").groupBy("experiment", "split").agg(F.avg(stats.right("type", "original")).alias("accuracy"))
    train = p.where("split = 'train' AND experiment <> '6mM-12'").groupBy("experiment").agg(F.avg(stats.right("type", "enhanced")).alias("train_accuracy"))
    return stats.accuracy_bands(acc, train, "experiment")


REPORT_SQL = """WITH e AS (
  SELECT {by} {true} AS c, 1 AS t, 0 AS p, CASE WHEN {true} = {pred} THEN 1 ELSE 0 END AS h FROM predictions
  UNION ALL SELECT {by} {pred}, 0, 1, 0 FROM predictions
), per AS (
  SELECT {by} c, sum(t) AS support, sum(p) AS predicted, sum(h) AS hits FROM e GROUP BY {by} c
), r AS (
  SELECT *, coalesce(hits::DOUBLE / nullif(predicted, 0), 0) AS precision, coalesce(hits::DOUBLE / nullif(support, 0), 0) AS recall FROM per
), s AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM r)"""


def hist_sql(view: str, col: str, by: str, bins: int) -> str:
    return f"""WITH r AS (SELECT {by}, min({col})::DOUBLE AS lo, max({col})::DOUBLE AS hi, count({col}) AS m FROM {view} GROUP BY {by}),
  b AS (SELECT {by}, lo, hi, m, coalesce(least(CAST(floor(({col} - lo) / nullif((hi - lo) / {bins}, 0)) AS INTEGER), {bins - 1}), 0) AS bin FROM {view} JOIN r USING ({by}) WHERE {col} IS NOT NULL)
SELECT {by}, bin, lo + bin * ((hi - lo) / {bins}) AS "left", count(*) AS n, count(*) / (m * ((hi - lo) / {bins})) AS density FROM b GROUP BY {by}, bin, lo, hi, m"""


QUERIES = {
    "a1_load_tables": Query(
        lambda s, d: fx.particles(s, d).select("row_id", "source_file", "Area").unionByName(fx.boxes(s, d).select(F.concat(F.lit("box-"), "frame_id").alias("row_id"), F.lit("boxes").alias("source_file")), allowMissingColumns=True).groupBy("source_file").agg(F.count("*").alias("n"), F.count("Area").alias("n_area")),
        "source_file n# n_area#",
        with_views("SELECT source_file, count(*) AS n, count(Area) AS n_area FROM (SELECT source_file, Area FROM particles UNION ALL SELECT 'boxes', NULL FROM boxes) GROUP BY source_file", PARTICLES, BOXES),
    ),
    "a2_experiment_catalog": Query(
        lambda s, d: catalog.experiment_catalog(fx.particles(s, d).where("NOT (experiment = '6mM-12' AND split = 'val')")).withColumn("classes", F.concat_ws(",", "classes")),
        "experiment split samples# classes missing",
        with_views("""WITH p AS (SELECT * FROM particles WHERE NOT (experiment = '6mM-12' AND split = 'val')),
          g AS (SELECT experiment, unnest(['train', 'test', 'val']) AS split FROM (SELECT DISTINCT experiment FROM p)),
          c AS (SELECT experiment, split, count(*) AS n, list_sort(list(DISTINCT type)) AS k FROM p GROUP BY ALL)
          SELECT experiment, split, coalesce(n, 0) AS samples, CASE WHEN split = 'train' THEN array_to_string(k, ',') ELSE '' END AS classes, n IS NULL AS missing FROM g LEFT JOIN c USING (experiment, split)""", PARTICLES),
    ),
    "a3_dataset_catalog": Query(
        lambda s, d: catalog.dataset_catalog(labelled(s, d).select("source_file", "type", "Area").unionByName(fx.boxes(s, d).selectExpr("'~boxes' AS source_file", "cast(1 as int) AS type", "1D AS Area"))).withColumn("classes", F.concat_ws(",", "classes")),
        "source_file samples# has_target classes n_columns#",
        with_views("SELECT source_file, count(*) AS samples, count(type) > 0 AS has_target, array_to_string(list_sort(list(DISTINCT type) FILTER (WHERE type IS NOT NULL)), ',') AS classes, 3 AS n_columns FROM labelled GROUP BY source_file", LABELLED),
    ),
    "a4_list_frames": Query(a4, "experiment found has_bytes n_case_sensitive#", with_views("SELECT DISTINCT experiment, true AS found, true AS has_bytes, 0 AS n_case_sensitive FROM particles", PARTICLES)),
    "a10_write_table": Query(a10, "format split n# enhanced# confidence*", with_views("SELECT format, split, count(*) AS n, sum(enhanced) AS enhanced, avg(confidence) AS confidence FROM predictions, (SELECT unnest(['parquet', 'csv']) AS format) GROUP BY ALL", PREDICTIONS)),
    "b4_attach_chemistry": Query(b4, "folder Na2CO3_mM* CaCl_mM* replicate# status n#", with_views("""SELECT folder, CASE WHEN folder LIKE '2`5%' THEN 2.5 ELSE 3 END AS Na2CO3_mM, CASE WHEN folder LIKE '2`5%' THEN 100 ELSE 3 END AS CaCl_mM, CAST(regexp_extract(folder, '(\\d+)-mix', 1) AS INTEGER) AS replicate, 'updated' AS status, count(*) AS n FROM frames GROUP BY ALL
          UNION ALL SELECT concat('run-', frame_id % 3), NULL, NULL, -1, 'unchanged', count(*) FROM frames GROUP BY ALL""", FRAMES)),
    "d5_compare_top": Query(d5_top, "k# rank# feature f~ status", with_views(f"""WITH u AS ({unpivot_sql('particles', 'experiment', LONG_COLS + ['MeanIntensity', 'Perimeter'])}), g AS (SELECT feature, experiment, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM u WHERE value IS NOT NULL GROUP BY ALL),
          o AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS m FROM g GROUP BY feature),
          f AS (SELECT feature, (sum(g.n * (g.m - o.m) * (g.m - o.m)) / (max(o.k) - 1)) / (sum(g.v * g.n) / (max(o.n) - max(o.k))) AS f FROM g JOIN o USING (feature) GROUP BY feature),
          r AS (SELECT *, row_number() OVER (ORDER BY f DESC, feature) AS rank FROM f)
          SELECT k, rank, feature, f, CASE WHEN feature IN ('Area', 'Circularity', 'dis', 'Perimeter') THEN 'orig' ELSE 'NEW' END AS status FROM r, (SELECT unnest([2, 4]) AS k) WHERE rank <= k""", PARTICLES)),
    "a5_pending_work": Query(a5, "reason n#", with_views(f"""WITH {DONE_SQL} SELECT reason, count(*) AS n FROM (
          SELECT CASE WHEN done_mtime IS NULL THEN 'new' WHEN mtime > done_mtime THEN 'newer' WHEN done_mode <> 'gray' THEN 'mode' ELSE 'skipped' END AS reason FROM files LEFT JOIN done USING (path)) GROUP BY reason""", FILES)),
    "a5_pending_stream": Query(a5_stream, "path mtime# reason", with_views(f"""WITH {DONE_SQL} SELECT * FROM (
          SELECT files.path, mtime, CASE WHEN done_mtime IS NULL THEN 'new' WHEN mtime > done_mtime THEN 'newer' WHEN done_mode <> 'gray' THEN 'mode' END AS reason FROM files LEFT JOIN done USING (path)) WHERE reason IS NOT NULL""", FILES)),
    "a6_build_series": Query(a6, "folder frame_id ts idx# rel_s*", with_views("SELECT folder, frame_id, ts, row_number() OVER (PARTITION BY folder ORDER BY ts, filename) - 1 AS idx, date_diff('microsecond', min(ts) OVER (PARTITION BY folder), ts) / 1e6 AS rel_s FROM frames", FRAMES)),
    "a7_series_metadata": Query(
        lambda s, d: catalog.series_metadata(fx.frames(s, d)),
        "folder num_images# earliest latest total_duration_seconds* Na2CO3_mM* CaCl_mM* replicate#",
        with_views("""SELECT folder, count(*) AS num_images, min(ts) AS earliest, max(ts) AS latest, date_diff('microsecond', min(ts), max(ts)) / 1e6 AS total_duration_seconds,
          CASE WHEN folder LIKE '2`5%' THEN 2.5 ELSE 3 END AS Na2CO3_mM, CASE WHEN folder LIKE '2`5%' THEN 100 ELSE 3 END AS CaCl_mM, CAST(regexp_extract(folder, '(\\d+)-mix', 1) AS INTEGER) AS replicate FROM frames GROUP BY folder""", FRAMES),
    ),
    "a8_storage_inventory": Query(
        lambda s, d: catalog.storage_inventory(fx.files(s, d)), "kind n# bytes# reduction_percent*",
        with_views("""WITH k AS (SELECT CASE WHEN path LIKE '%\\_nlm\\_filtered.tiff' ESCAPE '\\' THEN 'filtered' WHEN path LIKE '%.tiff' THEN 'converted' WHEN path LIKE '%.bmp' THEN 'raw' ELSE 'other' END AS kind, length FROM files),
          b AS (SELECT kind, count(*) AS n, sum(length) AS bytes FROM k GROUP BY kind)
          SELECT kind, n, bytes, 100 * (1 - bytes / (SELECT bytes FROM b WHERE kind = 'raw')) AS reduction_percent FROM b""", FILES),
    ),
    "a9_audit_frames": Query(
        lambda s, d: catalog.audit_frames(fx.files(s, d), fx.files(s, d).where("doc_id % 7 <> 0")).groupBy("status").agg(F.count("*").alias("n")), "status n#",
        with_views("SELECT CASE WHEN path LIKE '%.\\_%' ESCAPE '\\' THEN 'stray' WHEN doc_id % 7 = 0 THEN 'missing_part' ELSE 'ok' END AS status, count(*) AS n FROM files GROUP BY 1", FILES).replace("'%.\\_%'", "'%.\\_%'"),
    ),
    "a12_models_present": Query(a12, "grp n_present# complete", """
        WITH r AS (SELECT concat('g', s_nationkey) AS grp, ['model', 'scaler', 'selector', 'metadata'][CAST(s_suppkey % 4 AS INTEGER) + 1] AS a FROM supplier),
          h AS (SELECT grp, count(DISTINCT a) AS n FROM r WHERE a <> 'metadata' GROUP BY grp)
        SELECT concat('g', n_nationkey) AS grp, coalesce(n, 0) AS n_present, coalesce(n, 0) = 3 AS complete FROM nation LEFT JOIN h ON h.grp = concat('g', n_nationkey)"""),
    "a13_resolve_columns": Query(
        lambda s, d: catalog.resolve_prediction_columns(fx.predictions(s, d).select("row_id", "enhanced", "original", "confidence", F.col("type").alias("true_label"))).groupBy("predicted", "type").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence")), "predicted type n# confidence*",
        with_views("SELECT enhanced AS predicted, type, count(*) AS n, avg(confidence) AS confidence FROM predictions GROUP BY ALL", PREDICTIONS),
    ),
    "b1_frame_ts": Query(lambda s, d: fx.frames(s, d).select("frame_id", parse.frame_ts(F.col("filename")).alias("ts")), "frame_id ts", with_views("SELECT frame_id, ts FROM frames", FRAMES)),
    "b2_chemistry": Query(b2, "folder na* ca* replicate#", with_views("SELECT DISTINCT folder, CASE WHEN folder LIKE '2`5%' THEN 2.5 ELSE 3 END AS na, CASE WHEN folder LIKE '2`5%' THEN 100 ELSE 3 END AS ca, CAST(regexp_extract(folder, '(\\d+)-mix', 1) AS INTEGER) AS replicate FROM frames", FRAMES)),
    "b5_concentration": Query(
        lambda s, d: fx.particles(s, d).withColumns({"train_group": parse.concentration(F.concat(F.lit("1"), "experiment")), "val_group": parse.concentration(F.concat(F.substring("source_file", 5, 99), F.col("l_linenumber") % 8), "val")}).groupBy("experiment", "train_group", "val_group").agg(F.count("*").alias("n")), "experiment train_group val_group n#",
        with_views("""SELECT experiment, CASE WHEN contains(experiment, '3mM') THEN '3mM' WHEN contains(experiment, '6mM') THEN '6mM' ELSE '3mM' END AS train_group,
          CASE WHEN contains(x, '3mm') OR contains(x, 'val3') THEN '3mM' WHEN contains(x, '6mm') OR contains(x, 'val6') THEN '6mM' END AS val_group, count(*) AS n
          FROM (SELECT *, lower(concat(substr(source_file, 5, 99), l_linenumber % 8)) AS x FROM particles) GROUP BY ALL""", PARTICLES),
    ),
    "b6_normalise_schema": Query(b6, "experiment n# area* grey*", with_views("SELECT experiment, count(*) AS n, avg(Area) AS area, avg(MeanIntensity) AS grey FROM particles GROUP BY experiment", PARTICLES)),
    "b7_feature_columns": Query(
        lambda s, d: s.createDataFrame([(g, n) for g, names in parse.feature_groups(parse.feature_columns(fx.particles(s, d), (*parse.NOT_FEATURES, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))).items() for n in names], "grp string, feature string").crossJoin(fx.particles(s, d).agg(F.count("*").alias("n"))), "grp feature n#",
        with_views("""WITH f AS (SELECT column_name AS feature FROM (SELECT unnest(['Area', 'Major', 'Minor', 'ConvexArea', 'Circularity', 'Extent', 'Perimeter', 'MeanIntensity', 'Gray_var', 'Gray_skew', 'Gray_skew_abs', 'Gray_kur', 'dis', 'Eccentricity', 'Major_Minor_ratio', 'dis_normal', 'normalized_local_mean_gray']) AS column_name)),
          g AS (SELECT feature, CASE WHEN feature IN ({shape}) THEN 'shape' WHEN feature IN ({intensity}) THEN 'intensity' ELSE 'other' END AS grp FROM f)
          SELECT grp, feature, (SELECT count(*) FROM particles) AS n FROM g""".format(shape=", ".join(f"'{x}'" for x in parse.SHAPE), intensity=", ".join(f"'{x}'" for x in parse.INTENSITY)), PARTICLES),
    ),
    "b8_encode_labels": Query(b8, "type type_code# decoded# n#", with_views("SELECT type, c AS type_code, c + 1 AS decoded, count(*) AS n FROM (SELECT type, CASE type WHEN 1 THEN 0 WHEN 3 THEN 1 WHEN 4 THEN 2 ELSE 0 END AS c FROM particles) GROUP BY ALL", PARTICLES)),
    "b9_bbox_window": Query(
        lambda s, d: parse.bbox_window(fx.boxes(s, d), border=1, height=8, width=8), "frame_id x0# y0# x1# y1#",
        with_views("SELECT vec_id AS frame_id, greatest(vec_id % 5 - 1, 0) AS x0, greatest(vec_id % 4 - 1, 0) AS y0, least(vec_id % 5 - 1 + 1 + vec_id % 4 + 2, 8) AS x1, least(vec_id % 4 - 1 + 1 + vec_id % 3 + 2, 8) AS y1 FROM embeddings", BOXES),
    ),
    "b10_derive_name": Query(b10, "doc_id added removed", with_views("""SELECT doc_id, replace(concat(regexp_replace(path, '\\.[^./]*$', ''), '_nlm_filtered', regexp_extract(path, '(\\.[^./]*)$', 1)), '/', '_') AS added,
          replace(concat(replace(regexp_replace(path, '\\.[^./]*$', ''), '_nlm_filtered', ''), '.tif'), '/', '_') AS removed FROM files""", FILES)),
    "b11_p_stars": Query(
        lambda s, d: fx.predictions(s, d).groupBy(parse.p_stars((F.col("confidence") - 0.3) / 3).alias("stars")).agg(F.count("*").alias("n")), "stars n#",
        with_views("SELECT CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS stars, count(*) AS n FROM (SELECT (confidence - 0.3::DOUBLE) / 3 AS p FROM predictions) GROUP BY 1", PREDICTIONS),
    ),
    "b12_grayscale": Query(b12, "frame_id gray# four#", with_views("SELECT frame_id, sum((v * 19595 + (255 - v) * 38470 + ((v * 7) % 256) * 7471 + 32768) >> 16) AS gray, sum(255 - v) AS four FROM pixels GROUP BY frame_id", PIXELS)),
    "c1_drop_unlabelled": Query(lambda s, d: relational.drop_unlabelled(labelled(s, d), "type").groupBy("type").agg(F.count("*").alias("n")), "type n#", with_views("SELECT type, count(*) AS n FROM labelled WHERE type IS NOT NULL GROUP BY type", LABELLED)),
    "c2_seen_labels": Query(c2, "kind type n#", with_views("SELECT CASE WHEN type = 4 THEN 'unseen' ELSE 'seen' END AS kind, type, count(*) AS n FROM particles WHERE split = 'val' GROUP BY ALL", PARTICLES)),
    "c3_first_hours": Query(
        lambda s, d: relational.limit_first_hours(fx.frames(s, d)), "folder frame_id",
        with_views("SELECT folder, frame_id FROM (SELECT *, count(*) OVER (PARTITION BY folder) AS n, min(ts) OVER (PARTITION BY folder) AS t0 FROM frames) WHERE n <= 19 OR ts <= t0 + INTERVAL 3 HOURS", FRAMES),
    ),
    "c3_first_hours_series": Query(
        lambda s, d: relational.limit_first_hours(fx.series(s, d)).groupBy("folder").agg(F.count("*").alias("n"), F.max("ts").alias("last")), "folder n# last",
        with_views("SELECT folder, count(*) AS n, max(ts) AS last FROM (SELECT *, count(*) OVER (PARTITION BY folder) AS k, min(ts) OVER (PARTITION BY folder) AS t0 FROM series) WHERE k <= 19 OR ts <= t0 + INTERVAL 3 HOURS GROUP BY folder", SERIES),
    ),
    "c4_holdout_by_source": Query(c4, "source_file n#", with_views("SELECT source_file, count(*) AS n FROM particles WHERE split <> 'train' GROUP BY source_file", PARTICLES)),
    "c5_common_features": Query(
        lambda s, d: s.createDataFrame([(c,) for c in relational.common_features(fx.particles(s, d), fx.predictions(s, d), required=("type",))], "feature string").crossJoin(fx.particles(s, d).agg(F.count("*").alias("n"))), "feature n#",
        with_views("SELECT unnest(['row_id', 'type', 'experiment', 'split', 'source_file', 'l_partkey', 'l_suppkey']) AS feature, (SELECT count(*) FROM particles) AS n", PARTICLES),
    ),
    "c6_fill_missing": Query(
        lambda s, d: relational.fill_missing_features(fx.particles(s, d).select("experiment", "Area"), ["Area", "Solidity"]).groupBy("experiment").agg(F.avg("Area").alias("area"), F.avg("Solidity").alias("solidity")), "experiment area* solidity*",
        with_views("SELECT experiment, avg(Area) AS area, 0 AS solidity FROM particles GROUP BY experiment", PARTICLES),
    ),
    "c7_pair_frames": Query(c7, "folder raw_name filtered_name", with_views("SELECT folder, filename AS raw_name, replace(filename, '.bmp', '_nlm_filtered.tiff') AS filtered_name FROM frames WHERE frame_id % 45 <> 7", FRAMES)),
    "c8_join_predictions": Query(
        lambda s, d: relational.join_predictions(fx.particles(s, d).select("row_id", "type", "experiment"), fx.predictions(s, d).select("row_id", "enhanced", "confidence")).groupBy("experiment", "type", "enhanced").agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence")), "experiment type enhanced n# confidence*",
        with_views("SELECT experiment, type, enhanced, count(*) AS n, avg(confidence) AS confidence FROM predictions GROUP BY ALL", PREDICTIONS),
    ),
    "c9_crop_pixels": Query(c9, "frame_id n# v# moment#", with_views("""WITH w AS (SELECT vec_id AS frame_id, greatest(vec_id % 5 - 1, 0) AS x0, greatest(vec_id % 4 - 1, 0) AS y0, least(vec_id % 5 + vec_id % 4 + 2, 8) AS x1, least(vec_id % 4 + vec_id % 3 + 2, 8) AS y1 FROM embeddings)
          SELECT frame_id, count(*) AS n, sum(v) AS v, sum((x - x0) * (y - y0)) AS moment FROM pixels JOIN w USING (frame_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY frame_id""", PIXELS)),
    "c10_inner_region": Query(lambda s, d: relational.inner_region(fx.pixels(s, d), 8, 8, 2).groupBy("frame_id").agg(F.count("*").alias("n"), F.sum("v").alias("v")), "frame_id n# v#", with_views("SELECT frame_id, count(*) AS n, sum(v) AS v FROM pixels WHERE x BETWEEN 2 AND 5 AND y BETWEEN 2 AND 5 GROUP BY frame_id", PIXELS)),
    "c11_with_combined": Query(c11, "dataset n# share*", with_views("WITH c AS (SELECT experiment AS dataset, count(*) AS n FROM particles GROUP BY 1 UNION ALL SELECT 'combined', count(*) FROM particles) SELECT dataset, n, 100.0 * n / (SELECT sum(n) FROM c) AS share FROM c", PARTICLES)),
    "c13_trainable_groups": Query(
        lambda s, d: relational.trainable_groups(fx.particles(s, d).where("experiment <> '3mM-1' OR type = 2"), "experiment", "type"), "experiment classes# least# trainable",
        with_views("WITH c AS (SELECT experiment, type, count(*) AS n FROM particles WHERE experiment <> '3mM-1' OR type = 2 GROUP BY ALL) SELECT experiment, count(*) AS classes, min(n) AS least, count(*) >= 2 AND min(n) >= 2 AS trainable FROM c GROUP BY experiment", PARTICLES),
    ),
    "d1_class_distribution": Query(lambda s, d: stats.class_distribution(fx.particles(s, d), "type", ["experiment"]), "experiment type n# percent*", with_views("SELECT experiment, type, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY experiment) AS percent FROM particles GROUP BY experiment, type", PARTICLES)),
    "d2_impute_median": Query(d2, "what n# value*", with_views(f"""WITH u AS ({unpivot_sql('particles', '', LONG_COLS)}), m AS (SELECT quantile_cont(Gray_kur, 0.5) AS q FROM particles)
          SELECT concat('feature:', feature) AS what, count(*) FILTER (WHERE value IS NULL) AS n, quantile_cont(value, 0.5) AS value FROM u GROUP BY feature
          UNION ALL SELECT concat('filled:', experiment), count(*), avg(coalesce(Gray_kur, q)) FROM particles, m GROUP BY experiment""", PARTICLES)),
    "d3_low_variance": Query(d3, "feature var_samp~ dropped", with_views(f"WITH u AS ({unpivot_sql('particles', '', LONG_COLS)} UNION ALL SELECT 'flat', 3::DOUBLE FROM particles) SELECT feature, var_samp(value) AS var_samp, var_samp(value) < 1e-10 AS dropped FROM u GROUP BY feature", PARTICLES)),
    "d4_scaler": Query(d4, "split " + " ".join(f"{c}*" for c in LONG_COLS), with_views("WITH t AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in LONG_COLS) + " FROM particles WHERE split = 'train') SELECT split, " + ", ".join(f"avg(({c} - m_{c}) / s_{c}) AS {c}" for c in LONG_COLS) + " FROM particles, t GROUP BY split", PARTICLES)),
    "d5_anova_f": Query(
        lambda s, d: stats.select_k_best(stats.anova_f(fx.particles(s, d), "experiment", LONG_COLS + ["MeanIntensity", "Perimeter"]), 3).withColumn("f", F.round("f", 4)), "feature f~ rank# selected",
        with_views(f"""WITH u AS ({unpivot_sql('particles', 'experiment', LONG_COLS + ['MeanIntensity', 'Perimeter'])}), g AS (SELECT feature, experiment, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM u WHERE value IS NOT NULL GROUP BY ALL),
          o AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(n * m) / sum(n) AS m FROM g GROUP BY feature),
          f AS (SELECT feature, (sum(g.n * (g.m - o.m) * (g.m - o.m)) / (max(o.k) - 1)) / (sum(g.v * g.n) / (max(o.n) - max(o.k))) AS f FROM g JOIN o USING (feature) GROUP BY feature)
          SELECT feature, f, row_number() OVER (ORDER BY f DESC, feature) AS rank, row_number() OVER (ORDER BY f DESC, feature) <= 3 AS selected FROM f""", PARTICLES),
    ),
    "d6_profile": Query(
        lambda s, d: stats.profile(fx.particles(s, d), LONG_COLS, ["experiment"]), "experiment feature min* max* mean* std* q01* q05* q95* q99*",
        with_views(f"WITH u AS ({unpivot_sql('particles', 'experiment', LONG_COLS)}) SELECT experiment, feature, min(value) AS min, max(value) AS max, avg(value) AS mean, stddev_pop(value) AS std, quantile_cont(value, 0.01) AS q01, quantile_cont(value, 0.05) AS q05, quantile_cont(value, 0.95) AS q95, quantile_cont(value, 0.99) AS q99 FROM u GROUP BY ALL", PARTICLES),
    ),
    "d7_confusion_matrix": Query(
        lambda s, d: stats.confusion_matrix(relational.with_combined(fx.predictions(s, d).withColumnRenamed("experiment", "dataset")), "type", "enhanced", [1, 2, 3, 4, 5], ["dataset"]), "dataset true_class predicted_class n#",
        with_views("""WITH d AS (SELECT experiment AS dataset, type, enhanced FROM predictions UNION ALL SELECT 'combined', type, enhanced FROM predictions), l AS (SELECT unnest([1, 2, 3, 4, 5])::INTEGER AS c)
          SELECT g.dataset, a.c AS true_class, b.c AS predicted_class, count(d.type) AS n FROM (SELECT DISTINCT dataset FROM d) g CROSS JOIN l a CROSS JOIN l b LEFT JOIN d ON d.dataset = g.dataset AND d.type = a.c AND d.enhanced = b.c GROUP BY ALL""", PREDICTIONS),
    ),
    "d8_classification_report": Query(
        lambda s, d: stats.classification_report(fx.predictions(s, d), "type", "enhanced", ["experiment"]), "experiment class precision* recall* f1* support#",
        with_views(REPORT_SQL.format(by="experiment,", true="type", pred="enhanced") + """ SELECT experiment, CAST(c AS VARCHAR) AS class, precision, recall, f1, support FROM s
          UNION ALL SELECT experiment, 'macro', avg(precision), avg(recall), avg(f1), sum(support) FROM s GROUP BY experiment
          UNION ALL SELECT experiment, 'weighted', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM s GROUP BY experiment""", PREDICTIONS),
    ),
    "d9_class_accuracy": Query(
        lambda s, d: stats.class_accuracy(fx.predictions(s, d), "type", "enhanced", "confidence", "experiment"), "experiment type accuracy* mean_confidence* n#",
        with_views("SELECT experiment, type, avg(CASE WHEN type = enhanced THEN 1::DOUBLE ELSE 0 END) AS accuracy, avg(confidence) AS mean_confidence, count(*) AS n FROM predictions GROUP BY GROUPING SETS ((), (experiment), (experiment, type))", PREDICTIONS),
    ),
    "d10_confidence_stats": Query(
        lambda s, d: stats.confidence_stats(fx.predictions(s, d), "type", "enhanced", "confidence", ["source_file"]), "source_file mean* median* std* min* max* mean_right* mean_wrong* n_right# n_wrong#",
        with_views("""SELECT source_file, avg(confidence) AS mean, quantile_cont(confidence, 0.5) AS median, stddev_pop(confidence) AS std, min(confidence) AS min, max(confidence) AS max, coalesce(avg(confidence) FILTER (WHERE type = enhanced), 0) AS mean_right,
          coalesce(avg(confidence) FILTER (WHERE type <> enhanced), 0) AS mean_wrong, count(*) FILTER (WHERE type = enhanced) AS n_right, count(*) FILTER (WHERE type <> enhanced) AS n_wrong FROM predictions GROUP BY source_file""", PREDICTIONS),
    ),
    "d11_calibration": Query(
        lambda s, d: stats.calibration(fx.predictions(s, d), "type", "enhanced", "confidence", ["experiment"]), "experiment high_accuracy* n_high# share_above*",
        with_views("SELECT experiment, coalesce(avg(CASE WHEN type = enhanced THEN 1::DOUBLE ELSE 0 END) FILTER (WHERE confidence > 0.9::DOUBLE), 0) AS high_accuracy, count(*) FILTER (WHERE confidence > 0.9::DOUBLE) AS n_high, avg(CASE WHEN confidence > 0.8::DOUBLE THEN 1::DOUBLE ELSE 0 END) AS share_above FROM predictions GROUP BY experiment", PREDICTIONS),
    ),
    "d11_reliability": Query(
        lambda s, d: stats.reliability(fx.predictions(s, d), "type", "enhanced", "confidence"), "bin# n# mean_confidence* accuracy*",
        with_views("SELECT least(CAST(floor(confidence * 10) AS INTEGER), 9) AS bin, count(*) AS n, avg(confidence) AS mean_confidence, avg(CASE WHEN type = enhanced THEN 1::DOUBLE ELSE 0 END) AS accuracy FROM predictions GROUP BY 1", PREDICTIONS),
    ),
    "d12_balanced_accuracy": Query(
        lambda s, d: stats.balanced_accuracy(fx.predictions(s, d), "type", "enhanced", ["experiment"]), "experiment balanced_accuracy*",
        with_views("SELECT experiment, avg(r) AS balanced_accuracy FROM (SELECT experiment, type, avg(CASE WHEN type = enhanced THEN 1::DOUBLE ELSE 0 END) AS r FROM predictions GROUP BY ALL) GROUP BY experiment", PREDICTIONS),
    ),
    "d13_class_weights": Query(
        lambda s, d: stats.with_row_weights(labelled(s, d), "type").groupBy("type").agg(F.count("*").alias("n"), F.sum("weight").alias("total"), F.max("weight").alias("weight")), "type n# total* weight*",
        with_views("WITH c AS (SELECT type, count(*) AS n FROM labelled WHERE type IS NOT NULL GROUP BY type) SELECT type, n, n * w AS total, w AS weight FROM (SELECT type, n, (SELECT sum(n) FROM c) / ((SELECT count(*) FROM c) * n::DOUBLE) AS w FROM c)", LABELLED),
    ),
    "d14_pair_confusion": Query(
        lambda s, d: stats.pair_confusion(fx.predictions(s, d), "type", "enhanced", 4, 1, ["experiment"]), "experiment type n# accuracy* n_as_other# percent_as_other*",
        with_views("SELECT experiment, type, count(*) AS n, avg(CASE WHEN type = enhanced THEN 1::DOUBLE ELSE 0 END) AS accuracy, count(*) FILTER (WHERE enhanced = 5 - type) AS n_as_other, 100 * avg(CASE WHEN enhanced = 5 - type THEN 1::DOUBLE ELSE 0 END) AS percent_as_other FROM predictions WHERE type IN (1, 4) GROUP BY ALL", PREDICTIONS),
    ),
    "d15_true_vs_pred": Query(
        lambda s, d: stats.true_vs_pred(fx.predictions(s, d), "type", "enhanced", ["source_file"]), "source_file class n_true# n_predicted#",
        with_views("SELECT source_file, c AS class, sum(t) AS n_true, sum(1 - t) AS n_predicted FROM (SELECT source_file, type AS c, 1 AS t FROM predictions UNION ALL SELECT source_file, enhanced, 0 FROM predictions) GROUP BY ALL", PREDICTIONS),
    ),
    "d16_scoreboard": Query(d16, "experiment test_accuracy* test_confidence* test_n# val_accuracy* val_confidence* val_n# gap*", with_views("""SELECT *, test_accuracy - val_accuracy AS gap FROM (SELECT experiment, avg(CASE WHEN type = enhanced THEN 1::DOUBLE ELSE 0 END) FILTER (WHERE split = 'test') AS test_accuracy,
          avg(confidence) FILTER (WHERE split = 'test') AS test_confidence, count(*) FILTER (WHERE split = 'test') AS test_n, avg(CASE WHEN type = enhanced THEN 1::DOUBLE ELSE 0 END) FILTER (WHERE split = 'val') AS val_accuracy,
          avg(confidence) FILTER (WHERE split = 'val') AS val_confidence, count(*) FILTER (WHERE split = 'val') AS val_n FROM predictions GROUP BY experiment)""", PREDICTIONS)),
    "d16_accuracy_bands": Query(d16_bands, "experiment split accuracy* difference* band", with_views("""WITH a AS (SELECT experiment, split, avg(CASE WHEN type = original THEN 1::DOUBLE ELSE 0 END) AS accuracy FROM predictions WHERE split <> 'train' GROUP BY ALL),
          t AS (SELECT experiment, avg(CASE WHEN type = enhanced THEN 1::DOUBLE ELSE 0 END) AS ta FROM predictions WHERE split = 'train' AND experiment <> '6mM-12' GROUP BY experiment),
          x AS (SELECT a.experiment, split, accuracy, accuracy - coalesce(ta, 0.9::DOUBLE) AS difference FROM a LEFT JOIN t USING (experiment))
          SELECT *, CASE WHEN difference < -0.10::DOUBLE THEN 'far_below' WHEN difference < -0.05::DOUBLE THEN 'below' ELSE 'ok' END AS band FROM x""", PREDICTIONS)),
    "d17_compare_models": Query(
        lambda s, d: stats.compare_models(fx.predictions(s, d), "type", ("original", "enhanced"), "experiment"), "experiment original_accuracy* enhanced_accuracy* improvement* average_improvement* verdict",
        with_views("""WITH p AS (SELECT experiment, avg(CASE WHEN type = original THEN 1::DOUBLE ELSE 0 END) AS original_accuracy, avg(CASE WHEN type = enhanced THEN 1::DOUBLE ELSE 0 END) AS enhanced_accuracy FROM predictions GROUP BY experiment),
          i AS (SELECT *, enhanced_accuracy - original_accuracy AS improvement, avg(enhanced_accuracy - original_accuracy) OVER () AS average_improvement FROM p)
          SELECT *, CASE WHEN average_improvement > 0.01 THEN 'better' WHEN average_improvement < -0.01 THEN 'worse' ELSE 'same' END AS verdict FROM i""", PREDICTIONS),
    ),
    "d18_overview": Query(
        lambda s, d: stats.overview(fx.predictions(s, d), "type", "enhanced", "confidence"), "accuracy* mean_confidence* class_coverage* right_ratio*",
        with_views("SELECT avg(CASE WHEN type = enhanced THEN 1::DOUBLE ELSE 0 END) AS accuracy, avg(confidence) AS mean_confidence, count(DISTINCT enhanced) / 4 AS class_coverage, avg(CASE WHEN type = enhanced THEN 1::DOUBLE ELSE 0 END) AS right_ratio FROM predictions", PREDICTIONS),
    ),
    "d19_histogram": Query(lambda s, d: stats.histogram(fx.particles(s, d), "dis", 20, ["experiment"], density=True), "experiment bin# left* n# density*", with_views(hist_sql("particles", "dis", "experiment", 20), PARTICLES)),
    "d20_box_stats": Query(
        lambda s, d: stats.box_stats(fx.particles(s, d), "Area", ["type"]), "type q1* median* q3* whisker_low* whisker_high* n_outliers#",
        with_views("""WITH q AS (SELECT type, quantile_cont(Area, 0.25) AS q1, quantile_cont(Area, 0.5) AS median, quantile_cont(Area, 0.75) AS q3 FROM particles GROUP BY type),
          j AS (SELECT q.*, Area, Area BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS i FROM particles JOIN q USING (type))
          SELECT type, q1, median, q3, min(Area) FILTER (WHERE i) AS whisker_low, max(Area) FILTER (WHERE i) AS whisker_high, count(*) FILTER (WHERE NOT i) AS n_outliers FROM j GROUP BY ALL""", PARTICLES),
    ),
    "d21_kde": Query(
        lambda s, d: stats.kde(fx.particles(s, d), "Perimeter", ["experiment"]), "experiment k# x* density*",
        with_views("""WITH s AS (SELECT experiment, count(Perimeter) AS n, min(Perimeter) AS lo, max(Perimeter) AS hi, stddev_samp(Perimeter) AS sd FROM particles GROUP BY experiment HAVING count(Perimeter) > 5 AND stddev_samp(Perimeter) > 0),
          g AS (SELECT experiment, n, lo, hi, pow(n, -0.2::DOUBLE) * sd AS h, k, lo + k * (hi - lo) / 99 AS x FROM s, (SELECT unnest(range(100)) AS k))
          SELECT experiment, k, x, sum(exp(-0.5 * ((x - Perimeter) / h) * ((x - Perimeter) / h))) / max(n * h * 2.5066282746310002) AS density FROM g JOIN particles USING (experiment) GROUP BY experiment, k, x""", PARTICLES),
    ),
    "d24_run_report": Query(
        lambda s, d: stats.run_report(fx.table(s, d, "orders").selectExpr("o_orderkey AS step", "CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'skipped' ELSE 'failed' END AS status")), "total# succeeded# skipped# success_rate*",
        "SELECT count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS succeeded, count(*) FILTER (WHERE o_orderstatus = 'O') AS skipped, count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*) FILTER (WHERE o_orderstatus <> 'O'), 0) AS success_rate FROM orders",
    ),
    "d25_f1_by_class": Query(
        lambda s, d: stats.f1_by_class(fx.predictions(s, d), "type", ["original", "enhanced"], "source_file"), "model class f1*",
        with_views("SELECT 'original' AS model, class, f1 FROM (" + REPORT_SQL.format(by="source_file,", true="type", pred="original") + " SELECT CAST(c AS VARCHAR) AS class, avg(f1) AS f1 FROM s GROUP BY c) UNION ALL SELECT 'enhanced', class, f1 FROM (" + REPORT_SQL.format(by="source_file,", true="type", pred="enhanced") + " SELECT CAST(c AS VARCHAR) AS class, avg(f1) AS f1 FROM s GROUP BY c)", PREDICTIONS),
    ),
    "e1_rank_predictions": Query(e1, "experiment row_id confidence_rank#", with_views("SELECT experiment, row_id, row_number() OVER (PARTITION BY experiment ORDER BY confidence DESC, row_id) AS confidence_rank FROM predictions", PREDICTIONS)),
    "e1_global_rank": Query(
        lambda s, d: ranking.global_rank(fx.predictions(s, d).select("row_id", "experiment", "confidence"), [F.desc("confidence"), F.col("row_id")], 8).groupBy("experiment").agg(F.sum("rank").alias("ranks"), F.min("rank").alias("best"), F.max("rank").alias("worst")), "experiment ranks# best# worst#",
        with_views("SELECT experiment, sum(r) AS ranks, min(r) AS best, max(r) AS worst FROM (SELECT experiment, row_number() OVER (ORDER BY confidence DESC, row_id) AS r FROM predictions) GROUP BY experiment", PREDICTIONS),
    ),
    "e1_top_predictions": Query(lambda s, d: ranking.top_predictions(fx.predictions(s, d), "confidence", "row_id", 50), "row_id confidence*", with_views("SELECT row_id, confidence FROM predictions ORDER BY confidence DESC, row_id LIMIT 50", PREDICTIONS)),
    "e4_frame_intervals": Query(
        lambda s, d: ranking.frame_intervals(fx.series(s, d)), "folder frame_id interval_s*",
        with_views("SELECT folder, frame_id, date_diff('microsecond', lag(ts) OVER (PARTITION BY folder ORDER BY ts, frame_id), ts) / 1e6 AS interval_s FROM series", SERIES),
    ),
    "e4_interval_summary": Query(
        lambda s, d: ranking.interval_summary(fx.frames(s, d)), "folder n# first_ts last_ts hours* mean_interval_s* max_interval_s*",
        with_views("WITH i AS (SELECT *, date_diff('microsecond', lag(ts) OVER (PARTITION BY folder ORDER BY ts, frame_id), ts) / 1e6 AS s FROM frames) SELECT folder, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, date_diff('microsecond', min(ts), max(ts)) / 3.6e9 AS hours, avg(s) AS mean_interval_s, max(s) AS max_interval_s FROM i GROUP BY folder", FRAMES),
    ),
    "e5_relative_times": Query(lambda s, d: ranking.relative_times(fx.series(s, d)), "folder frame_id rel_s*", with_views("SELECT folder, frame_id, date_diff('microsecond', min(ts) OVER (PARTITION BY folder), ts) / 1e6 AS rel_s FROM series", SERIES)),
    "e6_landmark_frames": Query(
        lambda s, d: ranking.landmark_frames(fx.frames(s, d)), "folder frame_id landmark",
        with_views("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY ts, frame_id) - 1 AS i, count(*) OVER (PARTITION BY folder) AS n FROM frames)
          SELECT folder, frame_id, 'first' AS landmark FROM n WHERE i = 0 UNION ALL SELECT folder, frame_id, 'middle' FROM n WHERE i = n // 2 UNION ALL SELECT folder, frame_id, 'last' FROM n WHERE i = n - 1""", FRAMES),
    ),
    "e7_intensity_series": Query(
        lambda s, d: ranking.intensity_series(fx.pixels(s, d), fx.frames(s, d), 10), "folder frame_id idx# mean* std*",
        with_views("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY ts, frame_id) - 1 AS idx, count(*) OVER (PARTITION BY folder) AS n FROM frames)
          SELECT folder, frame_id, idx, avg(v) AS mean, stddev_pop(v) AS std FROM n JOIN pixels USING (frame_id) WHERE idx % greatest(1, n // 10) = 0 GROUP BY ALL""", PIXELS, FRAMES),
    ),
    "e8_series_change": Query(
        lambda s, d: ranking.series_change(fx.pixels(s, d), fx.frames(s, d)), "folder n# frame_rate* mean_change* std_change*",
        with_views("""WITH f AS (SELECT frame_id, avg(v) AS m, stddev_pop(v) AS s FROM pixels GROUP BY frame_id)
          SELECT folder, count(*) AS n, count(*) / nullif(date_diff('microsecond', min(ts), max(ts)) / 1e6, 0) AS frame_rate, arg_max(m, ts) - arg_min(m, ts) AS mean_change, arg_max(s, ts) - arg_min(s, ts) AS std_change FROM frames JOIN f USING (frame_id) GROUP BY folder""", PIXELS, FRAMES),
    ),
}
