"""Clusterings with a chosen number of clusters, their errors and features; fits are distributed by the ML library."""

from __future__ import annotations

import math

from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainspark.operators.neighbours import squared_distance
from grainspark.operators.stats import unpivot


#: Different rows that a task of a mixture's fit reads at least.
TASK_ROWS = 100_000


def with_vector(df: DataFrame, source: str | list[str], out: str = "features") -> DataFrame:
    """A vector column from an array column or from several numeric ones."""
    if isinstance(source, str):
        return df.withColumn(out, array_to_vector(F.transform(source, lambda x: x.cast("double"))))
    return VectorAssembler(inputCols=source, outputCol=out).transform(df)


def _best_silhouette(make, df: DataFrame, ks):
    """(model, scores): the greatest simplified silhouette (squared distances to centres), the least k among equals."""
    judge, tried = ClusteringEvaluator(), []
    df = df.select("features").persist()
    for k in ks:
        model = make(k).fit(df)
        found = model.transform(df)
        if found.select("prediction").distinct().limit(2).count() > 1:
            tried.append((judge.evaluate(found), -k, model))
    df.unpersist()
    if not tried:
        raise ValueError("no number of clusters splits the rows")
    best = max(tried, key=lambda t: t[:2])
    return best[2], {-k: s for s, k, _ in tried}


def kmeans_best_k(df: DataFrame, ks=range(2, 11), seed: int = 42):
    return _best_silhouette(lambda k: KMeans(k=k, seed=seed), df, ks)


def hierarchical_best_k(df: DataFrame, ks=range(2, 11), seed: int = 42):
    """Divisive: bisecting k-means."""
    return _best_silhouette(lambda k: BisectingKMeans(k=k, seed=seed), df, ks)


def gmm_best_k(df: DataFrame, ks=range(2, 11), seed: int = 42, max_iter: int = 100):
    """(model, {k: (bic, aic)}): the mixture of least BIC.

    Every round of a fit is a job with a result for each task, so equal rows are counted once and read as one with a
    weight, TASK_ROWS of them in a task.
    """
    counted = df.groupBy("features").agg(F.count("*").cast("double").alias("__n")).persist()
    n, different = counted.agg(F.sum("__n"), F.count("*")).first()
    df, d = counted.coalesce(-(-different // TASK_ROWS)), len(counted.first()[0])
    tried = []
    for k in ks:
        model = GaussianMixture(k=k, seed=seed, maxIter=max_iter, weightCol="__n").fit(df)
        ll, p = model.summary.logLikelihood, k - 1 + k * d + k * d * (d + 1) / 2
        tried.append((p * math.log(n) - 2 * ll, 2 * p - 2 * ll, k, model))
    counted.unpersist()
    best = min(tried, key=lambda t: (t[0], t[2]))
    return best[3], {k: (bic, aic) for bic, aic, k, _ in tried}


def pca_2d(df: DataFrame, k: int = 2):
    """(rows with ``pca``, explained shares): centred first; each axis is turned so that its largest loading is positive."""
    centred = StandardScaler(inputCol="features", outputCol="__c", withMean=True, withStd=False).fit(df).transform(df)
    model = PCA(k=k, inputCol="__c", outputCol="__p").fit(centred)
    axes = model.pc.toArray()
    signs = [1.0 if axes[abs(axes[:, j]).argmax(), j] > 0 else -1.0 for j in range(k)]
    p = vector_to_array("__p")
    return model.transform(centred).withColumn("pca", F.array(*(p[j] * signs[j] for j in range(k)))).drop("__c", "__p"), model.explainedVariance.toArray().tolist()


def class_means(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, mean array): the mean vector of each class."""
    at = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return at.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("mean"))


def _distance_to(vector: Column, centre: list[float]) -> Column:
    return F.sqrt(squared_distance(vector, F.array(*(F.lit(float(c)) for c in centre))))


def cluster_features(df: DataFrame, vector: str, centres: list[list[float]], mean_a: list[float], mean_b: list[float], error_cluster: int | None = None) -> DataFrame:
    """Distances to centres, one-hot membership (nearest centre), distances to two training class means, their difference, and the error-cluster flag."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    out = df.withColumns({f"dist_cluster_{k}": _distance_to(v, c) for k, c in enumerate(centres)})
    d = F.array(*(f"dist_cluster_{k}" for k in range(len(centres))))
    out = out.withColumn("cluster", (F.array_position(d, F.array_min(d)) - 1).cast("int"))
    out = out.withColumns({f"in_cluster_{k}": (F.col("cluster") == k).cast("int") for k in range(len(centres))})
    out = out.withColumns({"dist_class_a": _distance_to(v, mean_a), "dist_class_b": _distance_to(v, mean_b)})
    out = out.withColumn("dist_difference", F.col("dist_class_a") - F.col("dist_class_b"))
    return out.withColumn("in_error_cluster", (F.col("cluster") == error_cluster).cast("int")) if error_cluster is not None else out


def mixture_posteriors(df: DataFrame, model) -> DataFrame:
    """``gmm_p``: the class posteriors of a fitted mixture, never of one fitted anew."""
    return model.transform(df).withColumn("gmm_p", vector_to_array("probability")).drop("probability", "prediction")


def cluster_error_report(df: DataFrame, true: str, predicted: str, confidence: str, cluster: str, high: float = 0.5) -> DataFrame:
    """Rows, accuracy, error rate, mean confidence, class counts and confusions of each cluster; noise (-1 or null) is left out."""
    kept = df.where(F.col(cluster) >= 0).withColumn("__ok", (F.col(true) == F.col(predicted)).cast("double"))
    main = kept.groupBy(cluster).agg(F.count("*").alias("size"), F.avg("__ok").alias("accuracy"), (1 - F.avg("__ok")).alias("error_rate"), F.avg(confidence).alias("avg_confidence"), F.count_if(F.col("__ok") == 0).alias("n_errors"))

    def counts(key: Column, where: Column, name: str) -> DataFrame:
        by = kept.where(where).groupBy(cluster, key.alias("k")).agg(F.count("*").alias("n"))
        return by.groupBy(cluster).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(name))

    out = main.join(counts(F.col(true), F.lit(True), "true_counts"), cluster).join(counts(F.col(predicted), F.lit(True), "predicted_counts"), cluster)
    out = out.join(counts(F.concat_ws("->", F.col(true), F.col(predicted)), F.col("__ok") == 0, "confusions"), cluster, "left")
    return out.withColumn("is_high_error", F.col("error_rate") > high)


def error_cluster(report: DataFrame, cluster: str) -> int | None:
    """The cluster of greatest error rate, the least number among equals."""
    row = report.orderBy(F.desc("error_rate"), cluster).first()
    return None if row is None else row[cluster]


def cluster_feature_patterns(df: DataFrame, cols: list[str], cluster: str, clusters: DataFrame | None = None, least_z: float = 1.5, top: int = 10) -> DataFrame:
    """(cluster, feature, z, min, max, mean, std, rank): features whose cluster mean is far from the mean of all, farthest first."""
    long = unpivot(df.where(F.col(cluster) >= 0), [cluster], cols)
    overall = long.groupBy("feature").agg(F.avg("value").alias("__m"), F.stddev_pop("value").alias("__s"))
    per = long.groupBy(cluster, "feature").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    if clusters is not None:
        per = per.join(clusters, cluster, "left_semi")
    z = (F.col("mean") - F.col("__m")) / (F.col("__s") + 1e-8)
    far = per.join(F.broadcast(overall), "feature").withColumn("z", z).where(F.abs("z") > least_z).drop("__m", "__s")
    w = Window.partitionBy(cluster).orderBy(F.desc(F.abs("z")), "feature")
    return far.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)
