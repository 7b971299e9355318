"""Catalogues of experiments, data sets, frame stacks and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainspark.functions.parse import chemistry, frame_ts, replicate


def experiment_catalog(df: DataFrame, label: str = "type", splits: tuple[str, ...] = ("train", "test", "val")) -> DataFrame:
    """(experiment, split, samples, classes) for all pairs; classes (sorted) for training only; a split without rows has 0 and is ``missing``."""
    found = df.groupBy("experiment", "split").agg(F.count("*").alias("samples"), F.sort_array(F.collect_set(label)).alias("classes"))
    grid = df.select("experiment").distinct().withColumn("split", F.explode(F.array(*(F.lit(s) for s in splits))))
    out = grid.join(found, ["experiment", "split"], "left")
    return out.select("experiment", "split", F.coalesce("samples", F.lit(0)).cast("long").alias("samples"), F.when(F.col("split") == "train", F.col("classes")).alias("classes"), F.col("samples").isNull().alias("missing"))


def dataset_catalog(df: DataFrame, label: str = "type", source: str = "source_file") -> DataFrame:
    """(source, samples, has_target, classes, n_columns); hidden and temporary files are skipped."""
    kept = df.where(~F.col(source).startswith(".") & ~F.col(source).startswith("~"))
    return kept.groupBy(source).agg(F.count("*").alias("samples"), (F.count(label) > 0).alias("has_target"), F.sort_array(F.collect_set(label)).alias("classes")).withColumn("n_columns", F.lit(len(df.columns)))


def pending_work(source: DataFrame, done: DataFrame, mode: str = "gray", force: bool = False, key: str = "path") -> DataFrame:
    """(source columns, reason): new, newer, mode or forced; null where nothing is to do.

    ``done`` has the key, ``done_mtime`` and ``done_mode``.
    """
    joined = source.join(done.select(key, "done_mtime", "done_mode"), key, "left")
    reason = F.when(F.lit(force), "forced").when(F.col("done_mtime").isNull(), "new").when(F.col("mtime") > F.col("done_mtime"), "newer").when(F.col("done_mode") != mode, "mode")
    return joined.withColumn("reason", reason).drop("done_mtime", "done_mode")


def work_counts(work: DataFrame) -> DataFrame:
    return work.groupBy(F.coalesce("reason", F.lit("skipped")).alias("reason")).agg(F.count("*").alias("n"))


def build_series(frames: DataFrame, name: str = "filename") -> tuple[DataFrame, DataFrame]:
    """(series, rejects): frames numbered by time in their folder with relative seconds; names without a time are rejects."""
    parsed = frames.withColumn("ts", frame_ts(F.col(name)))
    w = Window.partitionBy("folder")
    good = parsed.where(F.col("ts").isNotNull()).withColumn("idx", F.row_number().over(w.orderBy("ts", name)) - 1)
    good = good.withColumn("rel_s", F.timestamp_diff("MICROSECOND", F.min("ts").over(w), F.col("ts")) / 1e6)
    return good, parsed.where(F.col("ts").isNull()).withColumn("error", F.lit("no time in name"))


def series_metadata(series: DataFrame) -> DataFrame:
    """One row for each folder: frames, earliest and latest time, duration, and what its name says of chemistry and replicate."""
    duration = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts")) / 1e6
    by = series.groupBy("folder").agg(F.count("*").alias("num_images"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"), duration.alias("total_duration_seconds"))
    return attach_chemistry(by).drop("status")


def attach_chemistry(series: DataFrame) -> DataFrame:
    """Add Na2CO3_mM, CaCl_mM, replicate and whether anything was found (updated, unchanged)."""
    c, r = chemistry(F.col("folder")), replicate(F.col("folder"))
    out = series.withColumns({"Na2CO3_mM": c["Na2CO3_mM"], "CaCl_mM": c["CaCl_mM"], "replicate": r})
    return out.withColumn("status", F.when(F.coalesce("Na2CO3_mM", "CaCl_mM", F.col("replicate").cast("double")).isNotNull(), "updated").otherwise("unchanged"))


def file_kind(path):
    low = F.lower(path)
    return F.when(low.rlike(r"_nlm_filtered\.tiff?$"), "filtered").when(low.rlike(r"\.tiff?$"), "converted").when(low.endswith(".bmp"), "raw").otherwise("other")


def storage_inventory(files: DataFrame) -> DataFrame:
    """(kind, n, bytes, reduction_percent against raw bytes)."""
    by = files.groupBy(file_kind(F.col("path")).alias("kind")).agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))
    raw = F.max(F.when(F.col("kind") == "raw", F.col("bytes"))).over(Window.partitionBy(F.lit(1)))
    return by.withColumn("reduction_percent", 100 * (1 - F.try_divide(F.col("bytes"), raw)))


def audit_frames(files: DataFrame, required: DataFrame, key: str = "path") -> DataFrame:
    """(key, status): stray (``._`` names), missing_part (not in ``required``) or ok."""
    there = required.select(key).distinct().withColumn("__there", F.lit(True))
    status = F.when(F.col(key).contains("._"), "stray").when(F.col("__there").isNull(), "missing_part").otherwise("ok")
    return files.join(there, key, "left").withColumn("status", status).drop("__there")


def models_present(registry: DataFrame, groups: DataFrame, group: str, artefact: str, required: tuple[str, ...]) -> DataFrame:
    """(group, n_present, complete): which groups have every required artefact."""
    have = registry.where(F.col(artefact).isin(*required)).groupBy(group).agg(F.count_distinct(artefact).alias("n"))
    out = groups.select(group).distinct().join(have, group, "left")
    return out.select(group, F.coalesce("n", F.lit(0)).cast("long").alias("n_present"), (F.coalesce("n", F.lit(0)) == len(required)).alias("complete"))


def resolve_prediction_columns(df: DataFrame) -> DataFrame:
    """Rename to predicted, confidence and type whichever columns hold them; enhanced ones first."""
    def pick(*tests):
        return next((c for t in tests for c in df.columns if t(c.lower())), None)

    found = {
        "predicted": pick(lambda c: c.startswith("enhanced_pred") or c == "enhanced", lambda c: c.startswith("predict")),
        "confidence": pick(lambda c: c.startswith("enhanced_conf"), lambda c: "confidence" in c),
        "type": pick(lambda c: c == "true_label", lambda c: c == "type"),
    }
    if not found["predicted"]:
        raise ValueError("no column of predictions")
    for new, old in found.items():
        if old and old != new:
            df = df.drop(new).withColumnRenamed(old, new) if new in df.columns else df.withColumnRenamed(old, new)
    return df
