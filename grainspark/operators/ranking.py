"""Ranks, top rows, and time-series windows within folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainspark.functions.durable import durable

#: Rows that one range of a rank holds about.
RANGE_ROWS = 1_000_000


def top_predictions(df: DataFrame, confidence: str, key: str, n: int) -> DataFrame:
    """The ``n`` most confident rows, ties by key; each task keeps n rows at most."""
    return df.orderBy(F.desc(confidence), key).limit(n)


def global_rank(df: DataFrame, order: list[Column], parts: int) -> DataFrame:
    """``rank`` over all rows from 1, without a window over everything: ranges are sorted, and each range's rank starts after the rows before it.

    The dealt table is stored once, so that counting and ranking see the same ranges; the offsets are one row for each
    range.
    """
    dealt = durable(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(1)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return dealt.withColumn("__in", inside).join(F.broadcast(before), "__part").withColumn("rank", F.col("__in") + F.col("__before")).drop("__in", "__part", "__before")


def range_count(df: DataFrame, rows: int) -> int:
    """Ranges for ``rows`` rows: as many as bound a range by RANGE_ROWS, and no fewer than the session's shuffle partitions."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS))


def rank_predictions(df: DataFrame, confidence: str, key: str, by: str, parts: int | None = None) -> DataFrame:
    """``confidence_rank`` within ``by``: greatest confidence first, ties by key.

    All rows are ranked by (by, confidence, key) in ranges, and a data set starts after the rows of those before it, so
    no data set is sorted in one task. The number of ranges grows with the rows, unless ``parts`` gives it.
    """
    sizes = durable(df.groupBy(by).agg(F.count("*").alias("__n")))
    parts = parts or range_count(df, sizes.agg(F.sum("__n")).first()[0] or 0)
    w = Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_first("__by")).rowsBetween(Window.unboundedPreceding, -1)
    earlier = sizes.withColumnRenamed(by, "__by").withColumn("__earlier", F.coalesce(F.sum("__n").over(w), F.lit(0))).drop("__n")
    ranked = global_rank(df, [F.asc_nulls_first(by), F.desc(confidence), F.col(key)], parts)
    return ranked.join(earlier, F.col(by).eqNullSafe(F.col("__by"))).withColumn("confidence_rank", F.col("rank") - F.col("__earlier")).drop("rank", "__by", "__earlier")


def top_n(df: DataFrame, keys: list[str], by: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key in the order ``by`` (make it total)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= n)


def frame_intervals(series: DataFrame, folder: str = "folder", ts: str = "ts", key: str = "frame_id") -> DataFrame:
    """Seconds since the frame before (null for the first)."""
    w = Window.partitionBy(folder).orderBy(ts, key)
    return series.withColumn("interval_s", F.timestamp_diff("MICROSECOND", F.lag(ts).over(w), F.col(ts)) / 1e6)


def interval_summary(series: DataFrame, folder: str = "folder", ts: str = "ts", key: str = "frame_id") -> DataFrame:
    """Frames, first and last time, hours, mean and greatest interval of each folder."""
    hours = F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)) / 3.6e9
    return frame_intervals(series, folder, ts, key).groupBy(folder).agg(F.count("*").alias("n"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), hours.alias("hours"), F.avg("interval_s").alias("mean_interval_s"), F.max("interval_s").alias("max_interval_s"))


def relative_times(series: DataFrame, folder: str = "folder", ts: str = "ts") -> DataFrame:
    """``rel_s``: seconds since the folder's earliest frame."""
    return series.withColumn("rel_s", F.timestamp_diff("MICROSECOND", F.min(ts).over(Window.partitionBy(folder)), F.col(ts)) / 1e6)


def numbered(series: DataFrame, folder: str = "folder", ts: str = "ts", key: str = "frame_id") -> DataFrame:
    """``idx`` from 0 and the number ``n`` of frames in the folder."""
    w = Window.partitionBy(folder)
    return series.withColumn("idx", F.row_number().over(w.orderBy(ts, key)) - 1).withColumn("n", F.count("*").over(w).cast("int"))


def landmark_frames(series: DataFrame, folder: str = "folder", ts: str = "ts", key: str = "frame_id") -> DataFrame:
    """The first, middle and last frame of each folder (one frame may be several)."""
    marked = numbered(series, folder, ts, key)
    names = F.filter(F.array(F.when(F.col("idx") == 0, "first"), F.when(F.col("idx") == F.expr("n div 2"), "middle"), F.when(F.col("idx") == F.col("n") - 1, "last")), lambda x: x.isNotNull())
    return marked.select("*", F.explode(names).alias("landmark"))


def strided_frames(series: DataFrame, points: int = 50, folder: str = "folder", ts: str = "ts", key: str = "frame_id") -> DataFrame:
    """Every max(1, n div points)-th frame of a folder."""
    return numbered(series, folder, ts, key).where(F.col("idx") % F.greatest(F.lit(1), F.expr(f"n div {points}")) == 0)


def intensity_series(pixels: DataFrame, series: DataFrame, points: int = 50) -> DataFrame:
    """Mean and deviation (pop) of the strided frames; pixels of other frames are dropped before they are aggregated."""
    picked = strided_frames(series, points).select("frame_id", "folder", "idx")
    return pixels.join(picked, "frame_id").groupBy("folder", "frame_id", "idx").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def series_change(pixels: DataFrame, series: DataFrame) -> DataFrame:
    """Frames per second and the change of mean and deviation from first to last frame, for each folder."""
    frame = pixels.groupBy("frame_id").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    joined = series.join(frame, "frame_id")
    order = F.struct("ts", "frame_id")
    seconds = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1e6
    return joined.groupBy("folder").agg(F.count("*").alias("n"), F.try_divide(F.count("*"), seconds).alias("frame_rate"), (F.max_by("mean", order) - F.min_by("mean", order)).alias("mean_change"), (F.max_by("std", order) - F.min_by("std", order)).alias("std_change"))
