"""Profiles of feature tables and evaluation of predictions.

Many columns are handled by one unpivot and one aggregation. Null and NaN are both missing. Names say which deviation
is meant: ``pop`` divides by n, ``samp`` by n - 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainspark.functions.durable import durable
from grainspark.operators.quantiles import join_groups, quantiles


def unpivot(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """(keys, feature, value): long form with NaN as null."""
    clean = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(c) for c in cols]
    return df.select(*keys, *clean).unpivot(keys, cols, "feature", "value")


def class_distribution(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    total = F.sum("n").over(Window.partitionBy(*(by or [F.lit(1)])))
    return df.groupBy(*by, label).agg(F.count("*").alias("n")).withColumn("percent", F.round(100.0 * F.col("n") / total, 6))


def missing_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, n_missing, median): of the values that are there, the exact median."""
    long = unpivot(df, [], cols)
    middle = quantiles(long, ["feature"], [0.5]).select("feature", F.col("q")[0].alias("median"))
    return long.groupBy("feature").agg(F.count_if(F.col("value").isNull()).alias("n_missing")).join(middle, "feature")


def medians(df: DataFrame, cols: list[str], approx: bool = False, stored: bool = False) -> DataFrame:
    """One row with the median of each column; exact, or by one pass with a sketch. A ``stored`` table is read for each pass."""
    if approx:
        return df.agg(*(F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), 0.5, 100_000).alias(c) for c in cols))
    found = quantiles(unpivot(df, [], cols), ["feature"], [0.5], stored=stored)
    return found.agg(*(F.max(F.when(F.col("feature") == c, F.col("q")[0])).alias(c) for c in cols))


def impute_median(df: DataFrame, cols: list[str], stats: DataFrame | None = None) -> DataFrame:
    """Missing values become the median of ``stats`` (a row as of ``medians``, by default of ``df`` itself)."""
    row = (stats if stats is not None else medians(df, cols)).select(*(F.col(c).alias(f"__{c}") for c in cols))
    joined = df.crossJoin(F.broadcast(row.limit(1)))
    filled = {c: F.coalesce(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), F.col(f"__{c}")) for c in cols}
    return joined.withColumns(filled).drop(*(f"__{c}" for c in cols))


def low_variance(df: DataFrame, cols: list[str], eps: float = 1e-10) -> DataFrame:
    """(feature, var_samp, dropped)."""
    return unpivot(df, [], cols).groupBy("feature").agg(F.var_samp("value").alias("var_samp")).withColumn("dropped", F.coalesce(F.col("var_samp") < eps, F.lit(True)))


def drop_low_variance(df: DataFrame, cols: list[str], eps: float = 1e-10) -> tuple[DataFrame, list[str]]:
    out = {r["feature"] for r in low_variance(df, cols, eps).where("dropped").collect()}
    return df.drop(*out), [c for c in cols if c not in out]


def fit_scaler(df: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, mean, std): population deviation, 1 where it is zero."""
    stats = unpivot(df, [], cols).groupBy("feature").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    return stats.withColumn("std", F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def apply_scaler(df: DataFrame, scaler: DataFrame, cols: list[str]) -> DataFrame:
    """Standardised columns; the scaler is one row for each feature and is folded into a single row."""
    row = scaler.agg(*(F.max(F.when(F.col("feature") == c, F.col(k))).alias(f"__{k}_{c}") for c in cols for k in ("mean", "std")))
    scaled = {c: (F.col(c) - F.col(f"__mean_{c}")) / F.col(f"__std_{c}") for c in cols}
    return df.crossJoin(F.broadcast(row)).withColumns(scaled).drop(*row.columns)


def anova_f(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """(feature, f): variance between classes over variance within, from counts, sums and squares in one aggregation."""
    by = unpivot(df, [label], cols).where(f"value IS NOT NULL AND {label} IS NOT NULL").groupBy("feature", label).agg(F.count("*").alias("n"), F.sum("value").alias("s"), F.var_pop("value").alias("v"))
    total = by.groupBy("feature").agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("sb"), F.sum(F.col("v") * F.col("n")).alias("within"))
    between = F.col("sb") - F.col("s") * F.col("s") / F.col("n")
    return total.select("feature", F.try_divide(between / (F.col("k") - 1), F.col("within") / (F.col("n") - F.col("k"))).alias("f"))


def select_k_best(scores: DataFrame, k: int) -> DataFrame:
    """Rank by F, greatest first, ties by name; the table has a row for each feature."""
    w = Window.partitionBy(F.lit(1)).orderBy(F.desc_nulls_last("f"), "feature")
    return scores.withColumn("rank", F.row_number().over(w)).withColumn("selected", F.col("rank") <= k)


def compare_top(scores: DataFrame, known: list[str], ks: tuple[int, ...] = (15, 20, 25)) -> DataFrame:
    """(k, rank, feature, f, status): the k best features for each k there are enough features for; NEW where not among ``known``."""
    ranked = select_k_best(scores, max(ks)).withColumn("__n", F.count("*").over(Window.partitionBy(F.lit(1))))
    each = ranked.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks)))).where("k <= __n AND rank <= k")
    return each.select("k", "rank", "feature", "f", F.when(F.col("feature").isin(*known), "orig").otherwise("NEW").alias("status"))


def profile(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """min, max, mean, std (pop) and the 1st, 5th, 95th and 99th percentile of each feature."""
    by = by or []
    long = durable(unpivot(df, by, cols))
    marks = quantiles(long, [*by, "feature"], [0.01, 0.05, 0.95, 0.99], stored=True)
    out = long.groupBy(*by, "feature").agg(F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    joined = join_groups(out, marks.drop("n"), [*by, "feature"])
    return joined.select(*by, "feature", "min", "max", "mean", "std", *(F.col("q")[k].alias(f"q{n}") for k, n in enumerate(("01", "05", "95", "99"))))


def confusion_matrix(df: DataFrame, true: str, predicted: str, labels: list[int], by: list[str] | None = None) -> DataFrame:
    """(by, true, predicted, n) for all pairs of labels, zeros included; the grid is groups x labels x labels."""
    by = by or []
    spread = [F.explode(F.array(*(F.lit(x) for x in labels))).alias("t")]
    counts = df.groupBy(*by, F.col(true).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    grid = groups.select(*by, *spread).withColumn("p", F.explode(F.array(*(F.lit(x) for x in labels))))
    return grid.join(counts, [*by, "t", "p"], "left").select(*by, F.col("t").alias("true_class"), F.col("p").alias("predicted_class"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def classification_report(df: DataFrame, true: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Precision, recall, F1 and support for each class, and rows ``macro`` and ``weighted``; zero where undefined."""
    by = by or []
    both = df.select(*by, F.explode(F.array(F.struct(F.col(true).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("e"), (F.col(true) == F.col(predicted)).cast("int").alias("ok"))
    per = both.groupBy(*by, F.col("e.c").alias("class")).agg(F.sum("e.t").alias("support"), F.sum("e.p").alias("predicted"), F.sum(F.col("e.t") * F.col("ok")).alias("hits"))

    def rate(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))

    per = per.withColumn("precision", rate(F.col("hits"), F.col("predicted"))).withColumn("recall", rate(F.col("hits"), F.col("support")))
    per = per.withColumn("f1", rate(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    kinds = ("precision", "recall", "f1")
    each = per.select(*by, F.col("class").cast("string").alias("class"), *kinds, F.col("support").cast("long").alias("support"))
    macro = per.groupBy(*by).agg(*(F.avg(k).alias(k) for k in kinds), F.sum("support").cast("long").alias("support")).select(*by, F.lit("macro").alias("class"), *kinds, "support")
    weighted = per.groupBy(*by).agg(*(rate(F.sum(F.col(k) * F.col("support")), F.sum("support")).alias(k) for k in kinds), F.sum("support").cast("long").alias("support")).select(*by, F.lit("weighted").alias("class"), *kinds, "support")
    return each.unionByName(macro).unionByName(weighted)


def right(true: str, predicted: str) -> Column:
    return (F.col(true) == F.col(predicted)).cast("double")


def class_accuracy(df: DataFrame, true: str, predicted: str, confidence: str, dataset: str) -> DataFrame:
    """Accuracy, mean confidence and rows: of all, of each dataset and of each class in it, by grouping sets."""
    sets = df.withColumn("__ok", right(true, predicted)).groupingSets([[], [dataset], [dataset, true]], dataset, true)
    return sets.agg(F.avg("__ok").alias("accuracy"), F.avg(confidence).alias("mean_confidence"), F.count("*").alias("n"))


def confidence_stats(df: DataFrame, true: str, predicted: str, confidence: str, by: list[str]) -> DataFrame:
    """Mean, median, deviation (pop), least and greatest confidence; mean and rows of right and of wrong ones (0 if none)."""
    ok = F.col(true) == F.col(predicted)
    c = F.col(confidence)
    middle = quantiles(df, by, [0.5], confidence).select(*by, F.col("q")[0].alias("median"))
    main = df.groupBy(*by).agg(
        F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
        F.coalesce(F.avg(F.when(ok, c)), F.lit(0.0)).alias("mean_right"), F.coalesce(F.avg(F.when(~ok, c)), F.lit(0.0)).alias("mean_wrong"),
        F.count_if(ok).alias("n_right"), F.count_if(~ok).alias("n_wrong"),
    )
    return join_groups(main, middle, by)


def calibration(df: DataFrame, true: str, predicted: str, confidence: str, by: list[str], high: float = 0.9, share_above: float = 0.8) -> DataFrame:
    """Accuracy and rows above a high confidence, and the share of rows above another."""
    c = F.col(confidence)
    return df.groupBy(*by).agg(F.coalesce(F.avg(F.when(c > high, right(true, predicted))), F.lit(0.0)).alias("high_accuracy"), F.count_if(c > high).alias("n_high"), F.avg((c > share_above).cast("double")).alias("share_above"))


def reliability(df: DataFrame, true: str, predicted: str, confidence: str, bins: int = 10) -> DataFrame:
    """Rows, mean confidence and accuracy in equal bins of confidence."""
    b = F.least(F.floor(F.col(confidence) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"), F.avg(right(true, predicted)).alias("accuracy"))


def balanced_accuracy(df: DataFrame, true: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    by = by or []
    recall = df.groupBy(*by, true).agg(F.avg(right(true, predicted)).alias("r"))
    return recall.groupBy(*by).agg(F.avg("r").alias("balanced_accuracy"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): rows / (classes x rows of the class)."""
    w = Window.partitionBy(F.lit(1))
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))
    return counts.withColumn("weight", F.sum("n").over(w) / (F.count("*").over(w) * F.col("n").cast("double")))


def with_row_weights(df: DataFrame, label: str) -> DataFrame:
    return df.join(F.broadcast(class_weights(df, label).select(label, "weight")), label)


def pair_confusion(df: DataFrame, true: str, predicted: str, a: int, b: int, by: list[str] | None = None) -> DataFrame:
    """For each of two classes: rows, accuracy, and how many (and per cent) were taken for the other."""
    other = F.when(F.col(true) == a, b).otherwise(a)
    hit = (F.col(predicted) == other).cast("double")
    return df.where(F.col(true).isin(a, b)).groupBy(*(by or []), true).agg(F.count("*").alias("n"), F.avg(right(true, predicted)).alias("accuracy"), F.sum(hit).cast("long").alias("n_as_other"), (100 * F.avg(hit)).alias("percent_as_other"))


def true_vs_pred(df: DataFrame, true: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Rows of each class in truth and in prediction; classes of either side appear."""
    by = by or []
    long = df.select(*by, F.explode(F.array(F.struct(F.col(true).alias("class"), F.lit(1).alias("t")), F.struct(F.col(predicted).alias("class"), F.lit(0).alias("t")))).alias("e"))
    return long.groupBy(*by, F.col("e.class").alias("class")).agg(F.sum("e.t").cast("long").alias("n_true"), F.sum(1 - F.col("e.t")).cast("long").alias("n_predicted"))


def scoreboard(df: DataFrame, true: str, predicted: str, confidence: str, experiment: str = "experiment", split: str = "split", splits: tuple[str, ...] = ("test", "val")) -> DataFrame:
    """Accuracy, mean confidence and rows of each experiment, a column for each split, and test minus validation accuracy."""
    out = df.withColumn("__ok", right(true, predicted)).groupBy(experiment).pivot(split, list(splits)).agg(F.avg("__ok").alias("accuracy"), F.avg(confidence).alias("confidence"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("gap", F.col(f"{splits[0]}_accuracy") - F.col(f"{splits[1]}_accuracy"))


def accuracy_bands(scores: DataFrame, train: DataFrame, key: str, default: float = 0.9) -> DataFrame:
    """``scores`` (key, accuracy) against training (key, train_accuracy): far below, below or ok."""
    diff = F.col("accuracy") - F.coalesce("train_accuracy", F.lit(default))
    out = scores.join(F.broadcast(train.select(key, "train_accuracy")), key, "left")
    return out.withColumn("difference", diff).withColumn("band", F.when(diff < -0.10, "far_below").when(diff < -0.05, "below").otherwise("ok")).drop("train_accuracy")


def compare_models(df: DataFrame, true: str, models: tuple[str, str], dataset: str) -> DataFrame:
    """Accuracy of two models on each dataset, the second's gain, the mean gain and its verdict (better or worse by 0.01)."""
    a, b = models
    per = df.groupBy(dataset).agg(F.avg(right(true, a)).alias(f"{a}_accuracy"), F.avg(right(true, b)).alias(f"{b}_accuracy"))
    per = per.withColumn("improvement", F.col(f"{b}_accuracy") - F.col(f"{a}_accuracy")).withColumn("average_improvement", F.avg("improvement").over(Window.partitionBy(F.lit(1))))
    mean = F.col("average_improvement")
    return per.withColumn("verdict", F.when(mean > 0.01, "better").when(mean < -0.01, "worse").otherwise("same"))


def overview(df: DataFrame, true: str, predicted: str, confidence: str, classes: int = 4) -> DataFrame:
    """One row: accuracy, mean confidence, covered share of classes, right rows to all rows."""
    ok = F.col(true) == F.col(predicted)
    return df.agg(F.avg(ok.cast("double")).alias("accuracy"), F.avg(confidence).alias("mean_confidence"), (F.count_distinct(predicted) / F.lit(float(classes))).alias("class_coverage"), (F.count_if(ok) / F.count("*")).alias("right_ratio"))


def histogram(df: DataFrame, column: str, bins: int, by: list[str] | None = None, density: bool = False) -> DataFrame:
    """(by, bin, left, n[, density]): equal bins between least and greatest value, the right edge in the last bin."""
    by = by or []
    x = F.col(column).cast("double")
    ranges = df.groupBy(*by).agg(F.min(x).alias("__lo"), F.max(x).alias("__hi"), F.count(x).alias("__n"))
    joined = df.where(x.isNotNull()).join(ranges, by) if by else df.where(x.isNotNull()).crossJoin(F.broadcast(ranges))
    width = (F.col("__hi") - F.col("__lo")) / bins
    b = F.coalesce(F.least(F.floor(F.try_divide(x - F.col("__lo"), width)).cast("int"), F.lit(bins - 1)), F.lit(0))
    out = joined.groupBy(*by, b.alias("bin"), "__lo", "__hi", "__n").agg(F.count("*").alias("n"))
    out = out.withColumn("left", F.col("__lo") + F.col("bin") * width)
    if density:
        out = out.withColumn("density", F.try_divide(F.col("n"), F.col("__n") * width))
    return out.drop("__lo", "__hi", "__n")


def box_stats(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Quartiles, whiskers (the farthest values within 1.5 interquartile ranges) and the number of outliers."""
    x = F.col(column).cast("double")
    df = durable(df.select(*by, column))
    # Stored, so that its size says whether the rows have to be dealt by group to meet it.
    q = durable(quantiles(df, by, [0.25, 0.5, 0.75], column, stored=True).select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = x.between(F.col("q1") - reach, F.col("q3") + reach)
    joined = join_groups(df, q, by)
    return joined.groupBy(*by, "q1", "median", "q3").agg(F.min(F.when(inside, x)).alias("whisker_low"), F.max(F.when(inside, x)).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))


def kde(df: DataFrame, column: str, by: list[str], points: int = 100, cells: int | None = None) -> DataFrame:
    """(by, k, x, density): a Gaussian estimate at evenly spaced points, for groups of more than 5 values and some spread.

    Scott's bandwidth h, n^(-1/5) times the sample deviation. Every value counts at every point: tasks sum grid x values
    in batches and send on one vector of sums for each group, which one aggregation adds. Missing values (null, NaN) do
    not count; a null key is a group.

    ``cells`` makes it an approximation for very large groups: values are first counted in so many equal cells of the
    group's range and taken at the middle of theirs, which moves each by half a cell's width w at most and the density
    by 0.121 w / h^2 at most (the steepest slope of the Gaussian is 0.242 / h^2).
    """
    x = F.col(column).cast("double")
    clean = df.where(x.isNotNull() & ~F.isnan(x)).select(*by, x.alias("__v"))
    stats = clean.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"), F.stddev_samp("__v").alias("sd")).where("n > 5 AND sd > 0")
    stats = stats.withColumn("__g", F.md5(F.to_json(F.struct(*by), {"ignoreNullFields": "false"}))).withColumn("__h", F.pow(F.col("n").cast("double"), F.lit(-0.2)) * F.col("sd"))
    values = join_groups(clean, stats, by).select("__g", "lo", "hi", "__h", "__v", F.lit(1).cast("long").alias("__w"))
    if cells:
        width = (F.col("hi") - F.col("lo")) / cells
        cell = F.least(F.floor((F.col("__v") - F.col("lo")) / width), F.lit(cells - 1))
        values = values.groupBy("__g", "lo", "hi", "__h", (F.col("lo") + (cell + 0.5) * width).alias("__v")).agg(F.count("*").alias("__w"))

    def sums(batches):
        held: dict[str, np.ndarray] = {}

        def drain():
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([x.tolist() for x in held.values()], pa.list_(pa.float64()))], names=["__g", "sums"])
            held.clear()
            return out

        for batch in batches:
            group = batch.column(0).dictionary_encode()
            lo, hi, h, v, w = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(1, 6))
            codes = group.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            edges = np.searchsorted(codes[order], np.arange(len(group.dictionary) + 1))
            for g, name in enumerate(group.dictionary.to_pylist()):
                own = order[edges[g] : edges[g + 1]]
                first = own[0]
                grid = lo[first] + np.arange(points) * (hi[first] - lo[first]) / max(points - 1, 1)
                total = held.setdefault(name, np.zeros(points))
                for at in range(0, len(own), 1024):
                    z = (grid[:, None] - v[own[at : at + 1024]]) / h[first]
                    total += np.exp(-0.5 * z * z) @ w[own[at : at + 1024]]
            if len(held) > 4096:
                yield drain()
        yield drain()

    parts = values.mapInArrow(sums, "__g string, sums array<double>").select("__g", F.posexplode("sums").alias("k", "__s")).groupBy("__g", "k").agg(F.sum("__s").alias("__s"))
    place = F.col("lo") + F.col("k") * (F.col("hi") - F.col("lo")) / max(points - 1, 1)
    return parts.join(stats, "__g").select(*by, "k", place.alias("x"), (F.col("__s") / (F.col("n") * F.col("__h") * 2.5066282746310002)).alias("density"))


def f1_by_class(df: DataFrame, true: str, models: list[str], dataset: str) -> DataFrame:
    """(model, class, f1): F1 of each class averaged over datasets."""
    parts = [classification_report(df, true, m, [dataset]).where("class NOT IN ('macro', 'weighted')").withColumn("model", F.lit(m)) for m in models]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both.groupBy("model", "class").agg(F.avg("f1").alias("f1"))


def run_report(steps: DataFrame) -> DataFrame:
    """One row over (step, status): totals, skipped ones, and the success rate among those not skipped."""
    done, skipped = F.col("status") == "ok", F.col("status") == "skipped"
    return steps.agg(F.count("*").alias("total"), F.count_if(done).alias("succeeded"), F.count_if(skipped).alias("skipped"), F.try_divide(F.count_if(done), F.count_if(~skipped)).alias("success_rate"))
