"""Filters, joins and set operations on particle tables, frames and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def missing(column: str | Column) -> Column:
    """Null and NaN both count as missing."""
    c = F.col(column) if isinstance(column, str) else column
    return c.isNull() | F.isnan(c.cast("double"))


def drop_unlabelled(df: DataFrame, target: str) -> DataFrame:
    return df.where(~missing(target))


def keep_seen_labels(test: DataFrame, train: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose label occurs in training, the others); the distinct labels are a row for each class."""
    seen = train.select(label).where(F.col(label).isNotNull()).distinct()
    return test.join(seen, label, "left_semi"), test.join(seen, label, "left_anti")


def limit_first_hours(frames: DataFrame, folder: str = "folder", ts: str = "ts", n: int = 19, hours: int = 3) -> DataFrame:
    """Folders of more than ``n`` frames keep those up to ``hours`` after their first one, inclusive; others keep all."""
    w = Window.partitionBy(folder)
    marked = frames.withColumn("__n", F.count("*").over(w)).withColumn("__first", F.min(ts).over(w))
    return marked.where((F.col("__n") <= n) | (F.col(ts) <= F.col("__first") + F.expr(f"interval {hours} hours"))).drop("__n", "__first")


def holdout_by_source(rows: DataFrame, train: DataFrame, source: str = "source_file") -> DataFrame:
    """Rows whose source gave nothing to training."""
    return rows.join(train.select(source).distinct(), source, "left_anti")


def holdout_tail(rows: DataFrame, order: list[str], n_train: int) -> DataFrame:
    """Without sources: the rows after the first ``n_train`` by an explicit order, found by a top-n and an anti join on the order key."""
    head = rows.select(*order).orderBy(*order).limit(n_train)
    return rows.join(head, order, "left_anti")


def common_features(*tables: DataFrame, required: tuple[str, ...] = ()) -> list[str]:
    """Column names that all tables share, in the first one's order; fails at once if a required one is lacking."""
    shared = [c for c in tables[0].columns if all(c in t.columns for t in tables[1:])]
    if lacking := [c for c in required if c not in shared]:
        raise ValueError(f"required columns are missing: {lacking}")
    return shared


def fill_missing_features(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.lit(0.0) for n in names if n not in df.columns})


def pair_frames(left: DataFrame, right: DataFrame, name: str = "filename", suffix: str = "_nlm_filtered", keys: tuple[str, ...] = ("folder",)) -> DataFrame:
    """Pairs of a frame and its filtered form in the same folder: names agree without extension and suffix."""
    stem = F.regexp_replace(F.col(name), r"\.[^./]*$", "")
    a = left.select(*keys, F.col(name).alias("raw_name"), stem.alias("stem"))
    b = right.where(F.endswith(stem, F.lit(suffix))).select(*keys, F.col(name).alias("filtered_name"), F.regexp_replace(stem, f"{suffix}$", "").alias("stem"))
    return a.join(b, [*keys, "stem"])


def join_predictions(truth: DataFrame, predicted: DataFrame, key: str = "row_id") -> DataFrame:
    """Truth beside prediction, by id: rows have no positions here."""
    return truth.join(predicted.select(key, *(c for c in predicted.columns if c not in truth.columns)), key)


def crop_pixels(windows: DataFrame, pixels: DataFrame, side: int = 64) -> DataFrame:
    """Pixels inside boxes (x0 <= x < x1, y0 <= y < y1) of the same frame, with coordinates counted from the box.

    Boxes are dealt to the grid cells they touch and pixels to their one cell, so the join is on keys.
    """
    cells = windows.where("x0 < x1 AND y0 < y1")
    for axis in "xy":
        cells = cells.withColumn(f"c{axis}", F.explode(F.sequence(F.expr(f"{axis}0 div {side}"), F.expr(f"({axis}1 - 1) div {side}"))))
    placed = pixels.withColumns({"cx": F.expr(f"cast(x as bigint) div {side}"), "cy": F.expr(f"cast(y as bigint) div {side}")})
    joined = placed.join(cells, ["frame_id", "cx", "cy"]).where("x >= x0 AND x < x1 AND y >= y0 AND y < y1")
    return joined.withColumns({"bx": F.col("x") - F.col("x0"), "by": F.col("y") - F.col("y0")}).drop("cx", "cy")


def inner_region(pixels: DataFrame, height: int, width: int, offset: int) -> DataFrame:
    return pixels.where((F.col("x") >= offset) & (F.col("x") < width - offset) & (F.col("y") >= offset) & (F.col("y") < height - offset))


def with_combined(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Every row once under its dataset and once under ``combined``."""
    return df.withColumn(dataset, F.explode(F.array(F.col(dataset), F.lit("combined"))))


def dataset_shares(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """(dataset, n, share): per cent of all rows; the window is over one row for each dataset."""
    return df.groupBy(dataset).agg(F.count("*").alias("n")).withColumn("share", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 6))


def trainable_groups(df: DataFrame, group: str, label: str, least_classes: int = 2, least_rows: int = 2) -> DataFrame:
    """(group, classes, least, trainable): enough classes, each with enough rows."""
    counts = df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    by = counts.groupBy(group).agg(F.count("*").alias("classes"), F.min("n").alias("least"))
    return by.withColumn("trainable", (F.col("classes") >= least_classes) & (F.col("least") >= least_rows))
