"""Views that present the provided tables as particle tables, frames, predictions, boxes and file inventories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = ["Area", "Major", "Minor", "Eccentricity", "ConvexArea", "Circularity", "Extent", "Perimeter", "MeanIntensity", "Gray_var", "Gray_skew", "Gray_skew_abs", "Gray_kur", "dis", "dis_normal", "Major_Minor_ratio", "normalized_local_mean_gray"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def particles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measured particle for each order line; the joins are on keys, so the optimiser picks their strategy by size."""
    t = {n: table(spark, sf_dir, n) for n in ("lineitem", "orders", "part", "supplier", "nation")}
    # A line's class is made before the joins, so that neither flag is dealt.
    t["lineitem"] = t["lineitem"].withColumn("type", F.expr("CASE WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'N' THEN 3 WHEN l_linestatus = 'F' THEN 1 ELSE 4 END"))
    joined = (
        t["lineitem"]
        .join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["part"], F.col("l_partkey") == F.col("p_partkey"))
        .join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
    )
    base = joined.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, cast(round(l_extendedprice * 100) as bigint)) AS row_id",
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_extendedprice AS Area",
        "greatest(l_quantity, cast(p_size as double)) AS Major",
        "least(l_quantity, cast(p_size as double)) AS Minor",
        "l_extendedprice * (1 + l_tax) AS ConvexArea",
        "1 - 5 * l_discount AS Circularity",
        "0.2D + 10 * l_tax AS Extent",
        "p_retailprice AS Perimeter",
        "128 + s_acctbal / 100 AS MeanIntensity",
        "(l_quantity - p_size) * (l_quantity - p_size) / 10 AS Gray_var",
        "(l_quantity - p_size) / 50 AS Gray_skew",
        "abs((l_quantity - p_size) / 50) AS Gray_skew_abs",
        "CASE WHEN l_partkey % 97 <> 0 THEN o_totalprice / 100000 - 3 END AS Gray_kur",
        "cast(datediff(l_shipdate, o_orderdate) as double) AS dis",
        "type",
        "element_at(array('3mM-1', '3mM-4', '6mM-4', '6mM-10', '6mM-12'), cast(n_regionkey as int) + 1) AS experiment",
        "CASE WHEN l_linenumber <= 5 THEN 'train' WHEN l_linenumber = 6 THEN 'test' ELSE 'val' END AS split",
    )
    return base.selectExpr(
        "*",
        "sqrt(1 - (Minor / Major) * (Minor / Major)) + CASE WHEN l_partkey % 50 = 0 THEN 0.05D ELSE 0D END AS Eccentricity",
        "Major / Minor AS Major_Minor_ratio",
        "(abs(dis) + 1) / 1000 AS dis_normal",
        "MeanIntensity / 255 AS normalized_local_mean_gray",
        "concat(experiment, '_', split) AS source_file",
    )


#: What a prediction has of its own, made of a particle's columns.
PREDICTED = {
    "enhanced": "CASE WHEN l_partkey % 5 <> 0 THEN type ELSE cast(1 + l_suppkey % 4 as int) END",
    "original": "CASE WHEN l_partkey % 3 <> 0 THEN type ELSE cast(1 + l_suppkey % 4 as int) END",
    "confidence": "0.3D + 0.7D * ((31 * l_partkey + 17 * l_suppkey) % 1000) / 1000",
    "cluster": "cast(CASE WHEN l_partkey % 37 = 0 THEN -1 ELSE l_suppkey % 6 END as int)",
}


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' predictions with confidences, class probabilities and a cluster for every particle."""
    own = [f"{e} AS {c}" for c, e in PREDICTED.items()]
    base = particles(spark, sf_dir).selectExpr("row_id", "type", "experiment", "split", "source_file", "l_partkey", "l_suppkey", *own)
    return base.selectExpr("*", *(f"CASE WHEN enhanced = {c} THEN confidence ELSE (1 - confidence) / 3 END AS prob_class_{c}" for c in (1, 2, 3, 4)))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, y, x, v): every vector as an 8 x 8 frame."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "e")).selectExpr("vec_id AS frame_id", "cast(i div 8 as int) AS y", "cast(i % 8 as int) AS x", "cast(floor(least(255D, greatest(0D, 128D + 240D * cast(e as double)))) as int) AS v")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame_id, folder, filename, ts): a time series of frames for every 45 vectors."""
    base = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id AS frame_id",
        "vec_id div 45 AS k",
        "make_timestamp_ntz(2025, 6, 28, 0, 0, 0) + make_dt_interval(0, 0, cast(vec_id * 7 as int), cast(vec_id % 1000 as decimal(18,6)) / 1000) AS ts",
    )
    return base.selectExpr("frame_id", "concat(CASE WHEN k % 2 = 1 THEN '2`5+100mM' ELSE '3mM' END, '-0628-', k, '-mix') AS folder", "ts").selectExpr("frame_id", "folder", "concat(folder, '_', date_format(ts, 'yyyyMMddHHmmssSSS'), '_', frame_id % 45, '_AfterFPN.bmp') AS filename", "ts")


def filtered_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).withColumn("v", F.expr("cast((v div 8) * 8 as int)"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS frame_id", "concat('[', 1 + vec_id % 5, ', ', 1 + vec_id % 4, ', ', 1 + vec_id % 4, ', ', 1 + vec_id % 3, ']') AS BoundingBox")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, length, mtime, doc_id): documents as an inventory of image files."""
    return table(spark, sf_dir, "documents").selectExpr("doc_id", "concat(source, '/', doc_id, element_at(array('.bmp', '.tiff', '_nlm_filtered.tiff', '._x.h5'), cast(doc_id % 4 as int) + 1)) AS path", "n_chars AS length", "doc_id AS mtime")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(folder, frame_id, ts, value): events as irregular series of values."""
    return table(spark, sf_dir, "events").selectExpr("user_id AS folder", "event_id AS frame_id", "ts", "value")
