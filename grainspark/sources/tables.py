"""Reading and writing tables, frame listings and model bundles."""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainspark.operators.models import Boosted, Bundle, Plain


def load_tables(spark: SparkSession, paths: list[str], fmt: str = "parquet", **options) -> DataFrame:
    """Rows of several tables, tagged with their file's stem as ``source_file``; columns that a table lacks are null."""
    out = None
    for path in paths:
        one = spark.read.format(fmt).options(**options).load(path)
        one = one.withColumn("source_file", F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", ""))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no paths")
    return out


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: tuple[str, ...] = (), mode: str = "overwrite", **options) -> None:
    df.write.format(fmt).mode(mode).options(**options).partitionBy(*partition_by).save(path)


def list_frames(spark: SparkSession, root: str, glob: str = "*", pattern: str = "", ignore_case: bool = True, once_filtered: bool = False) -> DataFrame:
    """(path, name, length, mtime) of files under ``root``, contents not read; ``once_filtered`` leaves out multiply filtered names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).drop("content")
    name = F.element_at(F.split("path", "/"), -1)
    out = files.select("path", name.alias("name"), "length", F.col("modificationTime").alias("mtime"))
    if pattern:
        out = out.where(F.lower("name").contains(pattern.lower()) if ignore_case else F.col("name").contains(pattern))
    if once_filtered:
        out = out.where(F.size(F.split("name", "_nlm_filtered")) == 2)
    return out


def save_bundle(bundle: Bundle, path: str, spark: SparkSession, group: str = "combined", version: str = "latest", scores: dict | None = None) -> None:
    """Write models, statistics and a registry row under ``path/version/group``."""
    base = f"{path}/{version}/{group}"
    for name in ("medians", "extremes", "scaler"):
        getattr(bundle, name).write.mode("overwrite").parquet(f"{base}/{name}")
    kinds = {}
    for name, model in bundle.models.items():
        if isinstance(model, Boosted):
            kinds[name] = {"kind": "boosted", "classes": list(model.models)}
            for c, m in model.models.items():
                m.write().overwrite().save(f"{base}/models/{name}/{c}")
        else:
            kinds[name] = {"kind": type(model.model).__name__, "classes": model.classes}
            model.model.write().overwrite().save(f"{base}/models/{name}")
    row = (group, version, json.dumps(bundle.features), json.dumps(bundle.selected), json.dumps(bundle.classes), json.dumps(kinds), json.dumps(scores or {}))
    meta = spark.createDataFrame([row], "group string, version string, features string, selected string, classes string, models string, scores string")
    meta.withColumn("saved_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{base}/metadata")


def load_bundle(spark: SparkSession, path: str, group: str = "combined", version: str = "latest") -> Bundle:
    base = f"{path}/{version}/{group}"
    row = spark.read.parquet(f"{base}/metadata").first()
    readers = {"RandomForestClassificationModel": RandomForestClassificationModel, "LogisticRegressionModel": LogisticRegressionModel}
    models = {}
    for name, m in json.loads(row["models"]).items():
        if m["kind"] == "boosted":
            models[name] = Boosted({c: GBTClassificationModel.load(f"{base}/models/{name}/{c}") for c in m["classes"]})
        else:
            models[name] = Plain(readers[m["kind"]].load(f"{base}/models/{name}"), m["classes"])
    stats = {n: spark.read.parquet(f"{base}/{n}") for n in ("medians", "extremes", "scaler")}
    return Bundle(json.loads(row["features"]), json.loads(row["selected"]), stats["medians"], stats["extremes"], stats["scaler"], json.loads(row["classes"]), models)
