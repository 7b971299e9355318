"""Incremental work on files as a stream: each new file of a folder is handled once, in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from grainspark.sources.catalog import pending_work


def watch_inventory(spark: SparkSession, folder: str, schema: StructType | str, done: Callable[[], DataFrame], handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "gray", files_per_batch: int = 1000) -> StreamingQuery:
    """Read inventory files as they arrive and pass the rows with work to do to ``handle``.

    ``done`` gives the present table of finished work; the checkpoint makes each file count once. ``handle`` gets the
    batch's number and has to be idempotent for it, as a batch may be tried again after a failure.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)

    def batch(df: DataFrame, number: int) -> None:
        handle(pending_work(df, done(), mode).where("reason IS NOT NULL"), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


DONE = "path string, done_mtime long, done_mode string"


def finished(spark: SparkSession, sink: str, below: int | None = None) -> DataFrame:
    """(path, done_mtime, done_mode, reason, batch) of the work in a sink, of batches below a number where given."""
    path = spark._jvm.org.apache.hadoop.fs.Path(sink)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{DONE}, reason string, batch long")
    rows = spark.read.schema(f"{DONE}, reason string, batch long").parquet(sink)
    return rows if below is None else rows.where(F.col("batch") < below)


def run_pending(spark: SparkSession, inventory: str, schema: StructType | str, before: DataFrame, sink: str, checkpoint: str, mode: str = "gray", files_per_batch: int = 1000) -> StreamingQuery:
    """Take all inventory files that have come since the last call, and write the work they ask for to ``sink``.

    A batch writes (path, done_mtime, done_mode, reason) to the folder of its number and replaces what an earlier try
    left there, so a replayed batch does its work once. ``before`` is what was finished without the sink; a path that
    comes again is compared with the latest of that and of what earlier batches did.
    """

    def batch(df: DataFrame, number: int) -> None:
        every = before.select("path", "done_mtime", "done_mode").union(finished(spark, sink, number).select("path", "done_mtime", "done_mode"))
        done = every.groupBy("path").agg(F.max(F.struct("done_mtime", "done_mode")).alias("x")).select("path", "x.*")
        work = pending_work(df, done, mode).where("reason IS NOT NULL")
        work.select("path", F.col("mtime").cast("long").alias("done_mtime"), F.lit(mode).alias("done_mode"), "reason").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(inventory)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
