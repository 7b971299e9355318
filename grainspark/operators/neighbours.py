"""Nearest neighbours, exact and approximate, and pairs within a distance, over vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainspark.functions.durable import durable
from grainspark.operators import pivots
from grainspark.operators.density import dbscan, dbscan_search  # noqa: F401  part of what this module offers


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def knn_join(a: DataFrame, b: DataFrame, k: int, key: str, vector: str, within: str | None = None, block: int = pivots.BLOCK, keep_self: bool = False, exact: bool = True, probe: float = 0.6) -> DataFrame:
    """(a_key, b_key, rank, distance): the k nearest rows of ``b`` (inside ``within`` where given) for each row of ``a``; ties by key.

    Exact by a pivot index (see ``pivots``): a query compares itself with the points of its own cell, then of those
    cells that its k-th distance reaches. How much that saves depends on the data: little where all rows are about
    equally far from each other. With ``exact=False`` a query looks at the nearest cells that hold a share ``probe`` of
    its group's points and at no others; measure the recall on your data.

    Rows with a null group or a vector that is null, empty or not finite have no neighbours and are none; vectors of
    different lengths are never neighbours.
    """
    found = knn_candidates(a, b, k, key, vector, within, exact, probe, block).where("keys IS NOT NULL")
    best = found.groupBy("g", "vid").agg(F.slice(F.array_sort(F.collect_list(F.struct("d2", "keys"))), 1, k + 1).alias("best"))
    flat = F.flatten(F.transform("best", lambda p: F.transform(p["keys"], lambda x: F.struct(p["d2"].alias("d2"), x.alias("key")))))
    rows = pivots.points(a, key, vector, within).select("g", "vid", F.col("key").alias("a_key")).join(best, ["g", "vid"])
    own = F.filter(F.array_sort(flat), lambda x: F.lit(keep_self) | (x["key"] != F.col("a_key")))
    ranked = rows.select("a_key", F.posexplode(F.slice(own, 1, k)).alias("rank", "x"))
    return ranked.select("a_key", F.col("x.key").alias("b_key"), (F.col("rank") + 1).alias("rank"), F.sqrt("x.d2").alias("distance"))


def knn_candidates(a: DataFrame, b: DataFrame, k: int, key: str, vector: str, within: str | None = None, exact: bool = True, probe: float = 0.6, block: int = pivots.BLOCK) -> DataFrame:
    """What ``knn_join`` chooses from: (g, vid, d2, keys, compared), one more neighbour than k as a row may meet itself."""
    stored = durable(pivots.distinct_points(pivots.points(b, key, vector, within), k + 1))
    queries = stored.select("g", "vid", "v") if a is b else durable(pivots.points(a, key, vector, within).groupBy("g", "vid").agg(F.first("v").alias("v")))
    return pivots.nearest(pivots.PivotIndex(stored, "keys array<string>", block), queries, k + 1, None if exact else probe)


def knn_join_approx(a: DataFrame, b: DataFrame, k: int, key: str, vector: str, radius: float, tables: int = 4, seed: int = 42) -> DataFrame:
    """Candidates within ``radius`` from random projections, ranked by true distance; measure its recall against ``knn_join``."""
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=radius / 2, numHashTables=tables, seed=seed)
    va, vb = (x.select(F.col(key).cast("string").alias("key"), array_to_vector(F.transform(F.col(vector), lambda e: e.cast("double"))).alias("features")) for x in (a, b))
    pairs = model.fit(vb).approxSimilarityJoin(va, vb, radius, "distance").select(F.col("datasetA.key").alias("a_key"), F.col("datasetB.key").alias("b_key"), "distance").where("a_key <> b_key")
    w = Window.partitionBy("a_key").orderBy("distance", "b_key")
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def epsilon_pairs(df: DataFrame, key: str, vector: str, eps: float) -> DataFrame:
    """(u, v, distance) for u < v within ``eps``, by the pivot index; the result has a row for each pair, however many there are."""
    rows = pivots.points(df, key, vector)
    stored = durable(rows.groupBy("g", "vid").agg(F.first("v").alias("v")))
    index = pivots.PivotIndex(stored)
    names = "a string, b string, d2 double"

    def kernel(x: pa.Table, y: pa.Table) -> pa.Table:
        found = [*pivots.meetings(x, y, pivots.numbers(x, "t2")), (np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        i, j, d2 = (np.concatenate(f) for f in zip(*found, strict=True))
        return pa.table({"a": x["vid"].take(pa.array(i)), "b": y["vid"].take(pa.array(j)), "d2": pa.array(d2)})

    pairs = index.search(durable(index.errands(stored.withColumn("t2", F.lit((eps * pivots.WIDER) ** 2)), "all")), kernel, names)
    own = rows.select("vid", F.col("key").alias("k"))
    both = pairs.join(own.select(F.col("vid").alias("a"), F.col("k").alias("u")), "a").join(own.select(F.col("vid").alias("b"), F.col("k").alias("v")), "b")
    kind = df.schema[key].dataType
    return both.select(F.col("u").cast(kind).alias("u"), F.col("v").cast(kind).alias("v"), F.sqrt("d2").alias("distance")).where((F.col("u") < F.col("v")) & (F.col("distance") <= eps))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("u", "v", "distance").union(pairs.select("v", "u", "distance"))


def noise_counts(nodes: DataFrame, pairs: DataFrame, eps_values: list[float], min_points: int) -> list[int]:
    """Rows that would be noise for each eps, from the pairs within the greatest one: two aggregations for all of them."""
    both = both_ways(pairs)
    core = both.groupBy("u").agg(F.array(*(F.count_if(F.col("distance") <= e) + 1 >= min_points for e in eps_values)).alias("core"))
    near = both.join(core.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.array(*(F.max((F.col("distance") <= e) & F.col("core")[k]) for k, e in enumerate(eps_values))).alias("near"))
    marked = nodes.join(core, "u", "left").join(near, "u", "left")
    alone = min_points <= 1  # then every row is a core
    row = marked.agg(*(F.count_if(F.lit(not alone) & ~(F.coalesce(F.get("core", F.lit(k)), F.lit(False)) | F.coalesce(F.get("near", F.lit(k)), F.lit(False)))) for k in range(len(eps_values)))).first()
    return list(row)
