"""Cutting lineage through the cluster's shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables made inside ``temporary`` blocks, the innermost last.
_MADE: list[list[str]] = []
_NAME = re.compile(r"^(.*/table-[0-9a-f]{32})/")


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Only on one machine (master local) a temporary one is made where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared folder and read back.

    Neither its plan nor the constraints that the optimiser had derived from it come back, so loops may do this in
    every round. ``release`` deletes such a table; what a result still reads stays in the folder.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(*tables: DataFrame) -> None:
    """Delete tables that ``durable`` has made and nothing reads any more; other tables are left alone."""
    for df in tables:
        for folder in {m[1] for f in df.inputFiles() if (m := _NAME.match(f))}:
            delete_folder(df.sparkSession, folder)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables that ``durable`` makes inside are deleted at the end, so write what is to stay before."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE.remove(made)
        for path in made:
            delete_folder(spark, path)
