"""Frame operators over pixel tables (frame_id, y, x, v).

What needs intensities only works on at most 256 counts of each frame. Reference statistics are one broadcast row.
Values are cut to whole numbers towards zero, after clipping.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainspark.functions.durable import durable, release
from grainspark.operators.graph import components, merge_level

METHODS = ("histogram_matching", "min_max", "z_score", "peak_align", "peak_spread_align")
THRESHOLDS = {"low": 3.0, "medium": 2.0, "high": 1.5}


def value_counts(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys, "v").agg(F.count("*").alias("n"))


def histogram_peak(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``peak``: the left edge, cut to a whole number, of the first fullest of 256 bins between 0 and 255."""
    keys = keys or ["frame_id"]
    edge = F.least(F.floor(F.col("v") * 256 / 255), F.lit(255))
    bins = pixels.where("v BETWEEN 0 AND 255").groupBy(*keys, edge.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    best = bins.groupBy(*keys).agg(F.max_by("bin", F.struct("n", -F.col("bin"))).alias("bin"))
    return best.select(*keys, F.floor(F.col("bin") * 255 / 256).cast("int").alias("peak"))


def spread_metrics(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Deviation and variance (pop), interquartile range and range."""
    keys = keys or ["frame_id"]
    v = F.col("v").cast("double")
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.75)))
    return pixels.groupBy(*keys).agg(F.stddev_pop(v).alias("std"), F.var_pop(v).alias("var"), (q[1] - q[0]).alias("iqr"), (F.max("v") - F.min("v")).alias("range"))


def frame_statistics(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    keys = keys or ["frame_id"]
    base = pixels.groupBy(*keys).agg(F.min("v").alias("min"), F.max("v").alias("max"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return base.join(histogram_peak(pixels, keys), keys)


def ordered_deviation(pixels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """``std`` (pop) by Welford's update in the order of the pixels.

    What partial sums give depends, in the last bit, on how they are merged, and cutting to whole numbers makes that a
    grey level where a value falls on one. Here a frame's pixels meet in one row, which frames of ordinary size allow.
    """
    seen = F.filter(F.array_sort(F.collect_list(F.struct("y", "x", "v"))), lambda p: p["v"].isNotNull())

    def state(n: Column, mean: Column, square: Column) -> Column:
        return F.struct(n.alias("n"), mean.alias("mean"), square.alias("square"))

    def step(a: Column, p: Column) -> Column:
        x, n = p["v"].cast("double"), a["n"] + 1.0
        mean = a["mean"] + (x - a["mean"]) / n
        return state(n, mean, a["square"] + (x - mean) * (x - a["mean"]))

    std = F.aggregate(seen, state(F.lit(0.0), F.lit(0.0), F.lit(0.0)), step, lambda a: F.sqrt(F.try_divide(a["square"], a["n"])))
    return pixels.groupBy(*(keys or ["frame_id"])).agg(std.alias("std"))


def _clip(c: Column, top: int = 255) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(float(top)), c))


def matched(counts: DataFrame, reference: DataFrame) -> DataFrame:
    """(frame_id, v, new): each value goes to the reference value of the same cumulative share, linear in between.

    Both tables hold at most 256 values a frame; the reference's segments are one array.
    """
    w = Window.partitionBy("frame_id").orderBy("v")
    total = F.sum("n").over(Window.partitionBy("frame_id"))
    q = counts.withColumn("q", F.sum("n").over(w) / total)
    one = Window.partitionBy(F.lit(1))
    ref = reference.withColumn("q", F.sum("n").over(one.orderBy("v")) / F.sum("n").over(one))
    steps = ref.agg(F.sort_array(F.collect_list(F.struct("q", "v"))).alias("ref"))
    joined = q.crossJoin(F.broadcast(steps))
    low = F.filter("ref", lambda s: s["q"] <= F.col("q"))
    high = F.filter("ref", lambda s: s["q"] > F.col("q"))
    a, b = F.try_element_at(low, F.lit(-1)), F.try_element_at(high, F.lit(1))
    line = a["v"] + (b["v"] - a["v"]) * F.try_divide(F.col("q") - a["q"], b["q"] - a["q"])
    return joined.select("frame_id", "v", F.when(a.isNull(), b["v"].cast("double")).when(b.isNull(), a["v"].cast("double")).otherwise(line).alias("new"))


def normalise_frames(pixels: DataFrame, reference_id: int, method: str, ordered: bool = False) -> DataFrame:
    """All frames brought to the reference frame: (frame_id, y, x, v). ``ordered`` takes deviations by ``ordered_deviation``."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method}; known: {', '.join(METHODS)}")
    of_reference = pixels.where(F.col("frame_id") == reference_id)
    if method == "histogram_matching":
        table = matched(value_counts(pixels, ["frame_id"]), value_counts(of_reference, []))
        return pixels.join(table, ["frame_id", "v"]).select("frame_id", "y", "x", F.col("new").cast("int").alias("v"))

    def statistics(of: DataFrame) -> DataFrame:
        found = frame_statistics(of)
        return found.drop("std").join(ordered_deviation(of), "frame_id") if ordered else found

    ref = statistics(of_reference).select(*(F.col(c).alias(f"r_{c}") for c in ("min", "max", "mean", "std", "peak")))
    joined = pixels.join(statistics(pixels), "frame_id").crossJoin(F.broadcast(ref))
    v, std = F.col("v").cast("double"), F.col("std")
    shift = F.col("r_peak") - F.col("peak")
    if method == "min_max":
        new = F.coalesce(F.try_divide(v - F.col("min"), F.col("max") - F.col("min")), F.lit(0.0)) * (F.col("r_max") - F.col("r_min")) + F.col("r_min")
    elif method == "z_score":
        new = _clip(F.coalesce(F.try_divide(v - F.col("mean"), std), F.lit(0.0)) * F.col("r_std") + F.col("r_mean"))
    elif method == "peak_align":
        new = F.when(shift == 0, v).otherwise(_clip(v + shift))
    else:
        moved = v + shift
        new = _clip(F.when(std > 0, F.col("r_peak") + (moved - F.col("r_peak")) * F.try_divide(F.col("r_std"), std)).otherwise(moved))
    return joined.select("frame_id", "y", "x", new.cast("int").alias("v"))


def regions(pixels: DataFrame, size: int, keys: list[str]) -> DataFrame:
    """(keys, ry, rx, mean, std): R x R regions, ragged at the edges."""
    return pixels.groupBy(*keys, F.expr(f"cast(y div {size} as int)").alias("ry"), F.expr(f"cast(x div {size} as int)").alias("rx")).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def regional_anomalies(pixels: DataFrame, size: int, sensitivity: str = "medium", keys: list[str] | None = None) -> DataFrame:
    """Regions with ``anomaly``: the mean far from the frame's mean of means, or the deviation far above its mean."""
    keys, t = keys or ["frame_id"], THRESHOLDS[sensitivity]
    grid = regions(pixels, size, keys)
    whole = grid.groupBy(*keys).agg(F.avg("mean").alias("__m"), F.stddev_pop("mean").alias("__s"), F.avg("std").alias("__ms"), F.stddev_pop("std").alias("__ss"))
    out = grid.join(whole, keys)
    # The margin keeps exact ties out, whatever the order in which sums were taken.
    flag = (F.abs(F.col("mean") - F.col("__m")) > t * F.col("__s") + 1e-9) | (F.col("std") > F.col("__ms") + t * F.col("__ss") + 1e-9)
    return out.withColumn("anomaly", flag).drop("__m", "__s", "__ms", "__ss")


def streak_bands(anomalies: DataFrame, least: float = 0.3, keys: list[str] | None = None) -> DataFrame:
    """(keys, direction, band, share): columns (vertical) and rows (horizontal) of regions with enough anomalies."""
    keys = keys or ["frame_id"]
    flag = F.avg(F.col("anomaly").cast("double")).alias("share")
    vertical = anomalies.groupBy(*keys, F.lit("vertical").alias("direction"), F.col("rx").alias("band")).agg(flag)
    horizontal = anomalies.groupBy(*keys, F.lit("horizontal").alias("direction"), F.col("ry").alias("band")).agg(flag)
    return vertical.unionByName(horizontal).where(F.col("share") >= least)


def streak_lines(bands: DataFrame, size: int, height: int, width: int) -> DataFrame:
    """The pixel columns or rows that bands cover."""
    end = F.when(F.col("direction") == "vertical", width).otherwise(height)
    return bands.withColumn("line", F.explode(F.sequence(F.col("band") * size, F.least((F.col("band") + 1) * size, end) - 1)))


def line_means(pixels: DataFrame, axis: str) -> DataFrame:
    """Means of columns (axis x) or rows (axis y)."""
    return pixels.groupBy("frame_id", axis).agg(F.avg("v").alias("mean"))


def region_differences(pixels: DataFrame, height: int, width: int, keys: list[str] | None = None) -> DataFrame:
    """Mean of corner quarters and halves, left against right, top against bottom, and the deviation of the corners."""
    keys = keys or ["frame_id"]
    top, left = F.col("y") < height // 2, F.col("x") < width // 2
    part = {"top_left": top & left, "top_right": top & ~left, "bottom_left": ~top & left, "bottom_right": ~top & ~left, "left": left, "right": ~left, "top": top, "bottom": ~top}
    means = pixels.groupBy(*keys).agg(*(F.avg(F.when(c, F.col("v"))).alias(f"{n}_mean") for n, c in part.items()), *(F.stddev_pop(F.when(c, F.col("v"))).alias(f"{n}_std") for n, c in part.items()), *(F.percentile(F.when(c, F.col("v").cast("double")), 0.5).alias(f"{n}_median") for n, c in part.items()))
    corners = F.array(*(F.col(f"{n}_mean") for n in ("top_left", "top_right", "bottom_left", "bottom_right")))
    mean = F.aggregate(corners, F.lit(0.0), lambda s, x: s + x) / 4
    var = F.aggregate(corners, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / 4
    return means.withColumns({"left_vs_right": F.col("left_mean") - F.col("right_mean"), "top_vs_bottom": F.col("top_mean") - F.col("bottom_mean"), "corner_std": F.sqrt(var)})


def stage_report(staged: DataFrame, size: int, height: int, width: int, sensitivity: str = "medium") -> DataFrame:
    """For each stage and frame: share of pixels in streak bands, left-right difference, mean, deviation and range."""
    keys = ["stage", "frame_id"]
    lines = streak_lines(streak_bands(regional_anomalies(staged, size, sensitivity, keys), keys=keys), size, height, width)
    counts = lines.groupBy(*keys).agg(F.count_if(F.col("direction") == "vertical").alias("__c"), F.count_if(F.col("direction") == "horizontal").alias("__r"))
    base = staged.groupBy(*keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), (F.max("v") - F.min("v")).alias("range"))
    halves = region_differences(staged, height, width, keys).select(*keys, "left_vs_right")
    out = base.join(halves, keys).join(counts, keys, "left").fillna(0, ["__c", "__r"])
    covered = F.col("__c") * height + F.col("__r") * width - F.col("__c") * F.col("__r")
    return out.withColumn("streak_share", covered / (height * width)).drop("__c", "__r")


def noise_metrics(raw: DataFrame, filtered: DataFrame) -> DataFrame:
    """Mean |d|, deviation of d, raw deviation / max(that, 1e-10), correlation; ``error`` where the frames' shapes differ."""
    both = raw.withColumnRenamed("v", "a").join(filtered.withColumnRenamed("v", "b"), ["frame_id", "y", "x"], "full_outer")
    d = F.col("a") - F.col("b")
    alone = F.col("a").isNull() | F.col("b").isNull()
    s = both.groupBy("frame_id").agg(F.max(alone).alias("differs"), F.avg(F.abs(d)).alias("mean_abs"), F.stddev_pop(d).alias("std_diff"), F.stddev_pop("a").alias("std_raw"), F.corr(F.col("a").cast("double"), F.col("b").cast("double")).alias("correlation"))
    keep = lambda c: F.when(~F.col("differs"), c)
    return s.select("frame_id", keep(F.col("mean_abs")).alias("mean_abs"), keep(F.col("std_diff")).alias("std_diff"), keep(F.col("std_raw") / F.greatest("std_diff", F.lit(1e-10))).alias("snr"), keep(F.col("correlation")).alias("correlation"), F.when(F.col("differs"), "shape mismatch").alias("error"))


def abs_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    d = F.abs(F.col("a") - F.col("b"))
    return a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), ["frame_id", "y", "x"]).groupBy("frame_id").agg(F.max(d).alias("max_diff"), F.avg(d).alias("mean_diff"))


def series_difference(pixels: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(folder, y, x, d): the last frame minus the first, pixel by pixel."""
    ends = landmarks.where("landmark IN ('first', 'last')").select("frame_id", "folder", "landmark")
    picked = pixels.join(ends, "frame_id")
    return picked.groupBy("folder", "y", "x").agg((F.max(F.when(F.col("landmark") == "last", F.col("v"))) - F.max(F.when(F.col("landmark") == "first", F.col("v")))).alias("d"))


def difference_summary(difference: DataFrame) -> DataFrame:
    return difference.groupBy("folder").agg(F.min("d").alias("min"), F.max("d").alias("max"), F.avg("d").alias("mean"), F.stddev_pop("d").alias("std"))


def stack_summary(pixels: DataFrame, series: DataFrame) -> DataFrame:
    """Frames, least and greatest value, and bytes (one a pixel) of each folder."""
    frame = pixels.groupBy("frame_id").agg(F.min("v").alias("min"), F.max("v").alias("max"), F.count("*").alias("bytes"))
    return frame.join(series.select("frame_id", "folder"), "frame_id").groupBy("folder").agg(F.count("*").alias("n_frames"), F.min("min").alias("min"), F.max("max").alias("max"), F.sum("bytes").alias("bytes"))


def histogram_comparison(staged: DataFrame) -> DataFrame:
    """(stage, v, n, peak, std): unit-bin counts of each stage beside its peak and deviation."""
    counts = value_counts(staged, ["stage"])
    stats = histogram_peak(staged, ["stage"]).join(staged.groupBy("stage").agg(F.stddev_pop("v").alias("std")), "stage")
    return counts.join(stats, "stage")


def frame_info(pixels: DataFrame, files: DataFrame) -> DataFrame:
    """Width, height and file size of each frame; ``error`` for files without pixels and pixels without a file."""
    size = pixels.groupBy("frame_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    both = size.join(files.select("frame_id", "length"), "frame_id", "full_outer")
    return both.withColumn("error", F.when(F.col("width").isNull(), "unreadable").when(F.col("length").isNull(), "no file"))


def tile(pixels: DataFrame, height: int, width: int, size: int, overlap: int) -> DataFrame:
    """Every pixel once for each tile that covers it: tile_y, tile_x and ``core`` (its result is kept when stitching).

    Tiles start every size - overlap pixels; a core leaves out half the overlap at inner edges.
    """
    step, half = size - overlap, overlap // 2
    out = pixels
    for axis, length in (("y", height), ("x", width)):
        last = max(0, -(-(length - size) // step)) if length > size else 0
        first = F.greatest(F.lit(0), F.ceil((F.col(axis) - size + 1) / step))
        out = out.withColumn(f"tile_{axis}", F.explode(F.sequence(first.cast("int"), F.least(F.lit(last), F.floor(F.col(axis) / step)).cast("int"))))
        start = F.col(f"tile_{axis}") * step
        inside = ((F.col(axis) >= start + half) | (F.col(f"tile_{axis}") == 0)) & ((F.col(axis) < start + size - half) | (F.col(f"tile_{axis}") == last))
        out = out.withColumn(f"__core_{axis}", inside)
    return out.withColumn("core", F.col("__core_y") & F.col("__core_x")).drop("__core_y", "__core_x")


def stitch(tiles: DataFrame) -> DataFrame:
    """(frame_id, y, x, v): the core pixels; where cores overlap the later tile wins."""
    return tiles.where("core").groupBy("frame_id", "y", "x").agg(F.max_by("v", F.struct("tile_y", "tile_x")).alias("v"))


def _means(stack: np.ndarray, h: float, t: int, s: int, sigma: float) -> np.ndarray:
    """Non-local means of frames of one shape (frames x height x width x channels); channels share their weights."""
    _, hh, ww, channels = stack.shape
    pad = np.pad(stack, ((0, 0), (t + s, t + s), (t + s, t + s), (0, 0)), mode="symmetric")
    total, weight, n = np.zeros_like(stack), np.zeros(stack.shape[:3]), 2 * t + 1
    base = pad[:, s : s + hh + 2 * t, s : s + ww + 2 * t]
    for dy in range(-s, s + 1):
        for dx in range(-s, s + 1):
            other = pad[:, s + dy : s + dy + hh + 2 * t, s + dx : s + dx + ww + 2 * t]
            d = np.pad(np.cumsum(np.cumsum(((base - other) ** 2).sum(3), 1), 2), ((0, 0), (1, 0), (1, 0)))
            mean = (d[:, n:, n:] - d[:, :-n, n:] - d[:, n:, :-n] + d[:, :-n, :-n]) / (n * n * channels)
            w = np.exp(-np.maximum(mean - 2 * sigma * sigma, 0) / (h * h))
            total += w[..., None] * other[:, t : t + hh, t : t + ww]
            weight += w
    return total / weight[..., None]


def _denoised_tiles(pixels: DataFrame, columns: list[str], height: int, width: int, template: int, search: int, size: int, work, pixels_a_group: int = 500_000) -> DataFrame:
    """Tiles whose halo holds search window and template, put through ``work``; small tiles share a group, those of one shape an array."""
    halo = 2 * (template // 2 + search // 2)
    groups = 1 + pixels.count() // pixels_a_group
    tiles = tile(pixels, height, width, max(size, 2 * halo + 2), halo).withColumn("__g", F.pmod(F.xxhash64("frame_id", "tile_y", "tile_x"), F.lit(groups)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = ["frame_id", "tile_y", "tile_x"]
        pdf = pdf.sort_values([*keys, "y", "x"], kind="stable").reset_index(drop=True)
        by = pdf.groupby(keys, sort=False)
        y0, x0, y1, x1 = (by[c].transform(f) for f in ("min", "max") for c in ("y", "x"))
        number = by.ngroup()
        out = pdf[columns].to_numpy(float).copy()
        for (hh, ww), at in pdf.groupby([y1 - y0 + 1, x1 - x0 + 1]).indices.items():
            which, k = np.unique(number.to_numpy()[at], return_inverse=True)
            stack = np.zeros((len(which), hh, ww, len(columns)))
            spot = (k, (pdf["y"] - y0).to_numpy()[at], (pdf["x"] - x0).to_numpy()[at])
            stack[spot] = out[at]
            out[at] = work(stack)[spot]
        done = pdf[["frame_id", "y", "x", "tile_y", "tile_x", "core"]].copy()
        for c, name in enumerate(columns):
            done[name] = out[:, c]
        return done

    schema = "frame_id long, y int, x int, tile_y int, tile_x int, core boolean, " + ", ".join(f"`{c}` double" for c in columns)
    done = tiles.select("__g", "frame_id", "y", "x", "tile_y", "tile_x", "core", *columns).groupBy("__g").applyInPandas(run, schema)
    best = F.max_by(F.struct(*columns), F.struct("tile_y", "tile_x")).alias("__p")
    return done.where("core").groupBy("frame_id", "y", "x").agg(best).select("frame_id", "y", "x", *(F.col(f"__p.{c}").alias(c) for c in columns))


def denoise(pixels: DataFrame, height: int, width: int, h: float = 6.0, template: int = 3, search: int = 10, size: int = 256, sigma: float = 0.0, rescale: bool = False) -> DataFrame:
    """Non-local means: each value becomes the mean over a search window, weighted by exp(-max(d - 2 sigma^2, 0) / h^2).

    d is the mean squared difference of the templates round the two pixels, edges mirrored. Values are 0 to 255; with
    ``rescale`` (other depths) each frame is first brought to that range, cut to whole numbers, and brought back after.
    """
    t, s = template // 2, search // 2
    if not rescale:
        done = _denoised_tiles(pixels.select("frame_id", "y", "x", F.col("v").cast("double").alias("v")), ["v"], height, width, template, search, size, lambda x: np.clip(np.rint(_means(x, h, t, s, sigma)), 0, 255))
        return done.select("frame_id", "y", "x", F.col("v").cast("int").alias("v"))
    ends = pixels.groupBy("frame_id").agg(F.min("v").cast("double").alias("__lo"), F.max("v").cast("double").alias("__hi"))
    unit = F.coalesce(F.floor(F.try_divide((F.col("v") - F.col("__lo")) * 255, F.col("__hi") - F.col("__lo"))), F.lit(0)).cast("int")
    eight = pixels.join(ends, "frame_id").select("frame_id", "y", "x", unit.alias("v"))
    back = denoise(eight, height, width, h, template, search, size, sigma).join(ends, "frame_id")
    kind = dict(pixels.dtypes)["v"]
    return back.select("frame_id", "y", "x", (F.col("v") / 255 * (F.col("__hi") - F.col("__lo")) + F.col("__lo")).cast(kind).alias("v"))


#: RGB to XYZ (D65), rows X, Y, Z, each divided by the white point.
_XYZ = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]) / np.array([[0.950456], [1.0], [1.088754]])


def _to_lab(rgb: np.ndarray) -> np.ndarray:
    """L, a and b in steps of 255 / 100, 1 and 1, from 8-bit RGB."""
    u = rgb / 255
    u = np.where(u > 0.04045, ((u + 0.055) / 1.055) ** 2.4, u / 12.92) @ _XYZ.T
    f = np.where(u > 0.008856, np.cbrt(u), 7.787 * u + 16 / 116)
    return np.stack([(116 * f[..., 1] - 16) * 2.55, 500 * (f[..., 0] - f[..., 1]), 200 * (f[..., 1] - f[..., 2])], -1)


def _to_rgb(lab: np.ndarray) -> np.ndarray:
    y = (lab[..., 0] / 2.55 + 16) / 116
    f = np.stack([y + lab[..., 1] / 500, y, y - lab[..., 2] / 200], -1)
    u = np.where(f**3 > 0.008856, f**3, (f - 16 / 116) / 7.787) @ np.linalg.inv(_XYZ).T
    u = np.where(u > 0.0031308, 1.055 * np.maximum(u, 0) ** (1 / 2.4) - 0.055, 12.92 * u)
    return np.clip(np.rint(u * 255), 0, 255)


def denoise_colour(pixels: DataFrame, height: int, width: int, h: float = 6.0, template: int = 3, search: int = 10, size: int = 256) -> DataFrame:
    """Non-local means of (frame_id, y, x, r, g, b[, a]): lightness by itself, the two colour axes together; alpha stays as it is."""
    t, s = template // 2, search // 2

    def work(stack: np.ndarray) -> np.ndarray:
        lab = _to_lab(stack)
        return _to_rgb(np.concatenate([_means(lab[..., :1], h, t, s, 0.0), _means(lab[..., 1:], h, t, s, 0.0)], -1))

    base = pixels.select("frame_id", "y", "x", *(F.col(c).cast("double").alias(c) for c in "rgb"))
    done = _denoised_tiles(base, ["r", "g", "b"], height, width, template, search, size, work).select("frame_id", "y", "x", *(F.col(c).cast("int").alias(c) for c in "rgb"))
    return done.join(pixels.select("frame_id", "y", "x", "a"), ["frame_id", "y", "x"]) if "a" in pixels.columns else done


def crop_stats(crops: DataFrame, key: str = "crop", ring: int = 10) -> DataFrame:
    """(key, median, border_mean, border_std): median of finite values, and mean and deviation of the outer ring."""
    v = F.when(~F.isnan(F.col("v").cast("double")), F.col("v").cast("double"))
    w = Window.partitionBy(key)
    marked = crops.withColumns({"__w": F.max("bx").over(w), "__h": F.max("by").over(w)})
    edge = (F.col("bx") < ring) | (F.col("by") < ring) | (F.col("bx") > F.col("__w") - ring) | (F.col("by") > F.col("__h") - ring)
    return marked.groupBy(key).agg(F.percentile(v, 0.5).alias("median"), F.avg(F.when(edge, v)).alias("border_mean"), F.stddev_pop(F.when(edge, v)).alias("border_std"))


def best_cuts(v: np.ndarray, n: np.ndarray, groups: int) -> np.ndarray:
    """The group of each of some ascending values, counted ``n`` times, that gives the least sum of squares within groups.

    Exact, by dynamic programming over the last group's first value; of equal sums (to 6 places) the earliest cuts win,
    the last cut first.
    """
    count, total, square = (np.concatenate([[0.0], np.cumsum(x)]) for x in (n, n * v, n * v * v))

    def within(first: np.ndarray, end: int) -> np.ndarray:
        rows = count[end] - count[first]
        return square[end] - square[first] - (total[end] - total[first]) ** 2 / rows

    best = [np.array([0.0] + [within(np.array([0]), e)[0] for e in range(1, len(v) + 1)])]
    start = []
    for g in range(1, groups):
        cost, place = np.full(len(v) + 1, np.inf), np.zeros(len(v) + 1, int)
        for end in range(g + 1, len(v) + 1):
            first = np.arange(g, end)
            every = np.round(best[-1][first] + within(first, end), 6)
            place[end] = first[every.argmin()]
            cost[end] = (best[-1][first] + within(first, end))[every.argmin()]
        best.append(cost)
        start.append(place)
    out, end = np.zeros(len(v), int), len(v)
    for g in range(groups - 1, 0, -1):
        out[start[g - 1][end] : end] = g
        end = start[g - 1][end]
    return out


def _lloyd(v: np.ndarray, n: np.ndarray, groups: int) -> np.ndarray:
    """The group of each value after k-means steps from the values that hold evenly spaced ranks; equal starts are one group."""
    means = np.unique(v[np.searchsorted(np.cumsum(n), (np.arange(groups) + 0.5) / groups * n.sum())])
    for _ in range(100):
        at = np.abs(v[:, None] - means[None, :]).argmin(1)
        new = np.array([np.average(v[at == j], weights=n[at == j]) if (at == j).any() else means[j] for j in range(len(means))])
        if np.allclose(new, means):
            break
        means = new
    return np.unique(at, return_inverse=True)[1]


def segment_phases(crops: DataFrame, key: str = "crop", phases: int = 3, ring: int = 10, exact: bool = False) -> DataFrame:
    """(key, v, phase, background): one-dimensional k-means on each crop's value counts, phases in order of their means.

    With ``exact`` it is the best of all partitions, and a crop with fewer values than phases has a phase for each;
    otherwise steps from evenly spaced ranks end at an optimum near by, with fewer phases where one value fills the crop.
    ``background`` marks the phase nearest to the border mean (the darker one of two). A group is at most 256 rows.
    """
    counts = crops.groupBy(key, "v").agg(F.count("*").alias("n")).join(crop_stats(crops, key, ring).select(key, "border_mean"), key)
    kind = dict(crops.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("v", kind="stable")
        v, n = pdf["v"].to_numpy(float), pdf["n"].to_numpy(float)
        phase = (best_cuts if exact else _lloyd)(v, n, min(phases, len(v)))
        means = np.array([np.average(v[phase == p], weights=n[phase == p]) for p in range(phase.max() + 1)])
        back = np.round(np.abs(means - pdf["border_mean"].iloc[0]), 6).argmin()
        return pd.DataFrame({key: pdf[key], "v": pdf["v"], "phase": phase.astype(np.int32), "background": phase == back})

    return counts.groupBy(key).applyInPandas(run, f"`{key}` {kind}, v int, phase int, background boolean")


def tile_runs(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> tuple[np.ndarray, ...]:
    """(y, x0, x1, first y, first x) of the longest runs of the pixels in the given runs, with their object's least pixel.

    Objects are 4-connected. Runs of neighbouring rows meet by two searches in the sorted ends; no pixel is a node.
    """
    low, left, width = y.min(), x0.min(), int(x1.max() - x0.min()) + 2  # a column more, so that rows do not touch
    change = np.zeros((int(y.max() - low) + 1) * width + 1, np.int64)
    np.add.at(change, (y - low) * width + x0 - left, 1)
    np.add.at(change, (y - low) * width + x1 - left + 1, -1)
    on = np.cumsum(change) > 0
    edge = np.diff(on.astype(np.int8), prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    below_from, below_to = np.searchsorted(end, start + width), np.searchsorted(start, end + width, side="right")
    many = np.maximum(below_to - below_from, 0)
    upper = np.repeat(np.arange(len(start)), many)
    lower = np.repeat(below_from - np.cumsum(many) + many, many) + np.arange(many.sum())
    least = merge_level(len(start), upper, lower)
    return start // width + low, start % width + left, end % width + left, start[least] // width + low, start[least] % width + left


def _objects(runs: DataFrame, key: str, tile: int) -> DataFrame:
    """(key, y, x0, x1, object): runs of pixels with their 4-connected object, named by its least pixel.

    Objects are found inside tiles of ``tile`` x ``tile`` pixels; only runs at tile borders are linked by joins.
    """
    kind = runs.schema[key].dataType.simpleString()

    def label(table: pa.Table) -> pa.Table:
        y, x0, x1 = (table[c].to_numpy().astype(np.int64) for c in ("y", "x0", "x1"))
        found = tile_runs(y, x0, x1)
        return pa.table({key: table[key].take(pa.array(np.zeros(len(found[0]), np.int64))), **{c: pa.array(f.astype(np.int32)) for c, f in zip(("y", "x0", "x1", "ny", "nx"), found, strict=True)}})

    dealt = runs.select(key, "y", "x0", "x1").withColumns({"__ty": F.floor(F.col("y") / tile), "__tx": F.floor(F.col("x0") / tile)})
    node = F.concat_ws(":", F.col(key).cast("string"), F.lpad("ny", 9, "0"), F.lpad("nx", 9, "0"))
    placed = durable(dealt.groupBy(key, "__ty", "__tx").applyInArrow(label, f"`{key}` {kind}, y int, x0 int, x1 int, ny int, nx int").select(key, "y", "x0", "x1", node.alias("node")))
    side = placed.where((F.col("x1") + 1) % tile == 0).select(key, "y", (F.col("x1") + 1).alias("x0"), F.col("node").alias("u")).join(placed.where(F.col("x0") % tile == 0).select(key, "y", "x0", F.col("node").alias("v")), [key, "y", "x0"])
    column = F.floor(F.col("x0") / tile).alias("tx")
    above = placed.where((F.col("y") + 1) % tile == 0).select(key, (F.col("y") + 1).alias("y"), column, F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("node").alias("u"))
    under = placed.where(F.col("y") % tile == 0).select(key, "y", column, "x0", "x1", F.col("node").alias("v"))
    meet = above.join(under, [key, "y", "tx"]).where((F.col("a0") <= F.col("x1")) & (F.col("x0") <= F.col("a1")))  # half a tile's width of runs on either side at most
    edges = side.select("u", "v").union(meet.select("u", "v"))
    roots = components(edges)
    names = roots.join(roots.groupBy("root").agg(F.min("node").alias("object")), "root").select("node", "object")
    return placed.join(names, "node", "left").select(key, "y", "x0", "x1", F.coalesce("object", "node").alias("object"))


def largest_object(mask: DataFrame, height: int, width: int, key: str = "crop", fill_below: int = 64, tile: int = 512) -> DataFrame:
    """(key, y, x): the largest 4-connected object after small holes are filled; ties go to the object of the least pixel.

    ``mask`` has a row for every pixel with boolean ``on``. A hole is a background object of fewer pixels than
    ``fill_below``, at the edge or not.
    """
    runs = mask.select(key, "y", F.col("x").alias("x0"), F.col("x").alias("x1"), "on")
    size = F.sum(F.col("x1") - F.col("x0") + 1)
    holes = durable(_objects(runs.where("NOT on"), key, tile))
    small = holes.groupBy(key, "object").agg(size.alias("n")).where(F.col("n") < fill_below)
    filled = runs.where("on").drop("on").unionByName(holes.join(small, [key, "object"], "left_semi").select(key, "y", "x0", "x1"))
    objects = durable(_objects(filled, key, tile))
    release(holes)
    order = F.struct((-F.col("n")).alias("n"), F.col("object"))
    best = objects.groupBy(key, "object").agg(size.alias("n")).groupBy(key).agg(F.min(order)["object"].alias("object"))
    return objects.join(best, [key, "object"], "left_semi").select(key, "y", F.explode(F.sequence("x0", "x1")).alias("x"))
