"""Two-sample tests and the explanation of errors by feature distributions.

Rank statistics, moments and medians come from counts of distinct values, which are stored once. Running sums over the
values of a feature are taken inside cells of about equally many distinct values (marks of a sketch), and a cell starts
after the sums of the cells before it, so that a feature is never in one task, however its values are spread. P-values
are series in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainspark.functions.durable import durable
from grainspark.operators.stats import unpivot


def normal_tail(z: Column) -> Column:
    """Two-sided normal tail erfc(|z| / sqrt 2) by a rational Chebyshev fit (relative error below 1.2e-7)."""
    x = F.abs(z) / 1.4142135623730951
    t = 1 / (1 + 0.5 * x)
    # Fixed values of the fit, lowest power first.
    poly = F.lit(0.0)
    for c in reversed((-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def kolmogorov_tail(x: Column, terms: int = 40) -> Column:
    total = F.lit(0.0)
    for k in range(1, terms + 1):
        total = total + (2.0 if k % 2 else -2.0) * F.exp(-2.0 * k * k * x * x)
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def value_counts(long: DataFrame, keys: list[str], side: Column) -> DataFrame:
    """(keys, value, na, nb): rows of the two sides at each distinct value; ``side`` is true, false or null (neither)."""
    return long.where("value IS NOT NULL").groupBy(*keys, "value").agg(F.count_if(side).alias("na"), F.count_if(~side).alias("nb")).where("na + nb > 0")


#: Distinct values that one cell of a running sum holds about.
CELL_VALUES = 200_000


def below(counts: DataFrame, keys: list[str], cells: int | None = None) -> DataFrame:
    """Add ``ba`` and ``bb`` (rows of each side at smaller values) and the totals ``ta`` and ``tb``; ``counts`` is stored first.

    There are as many cells as keep a cell of the largest key near CELL_VALUES distinct values, unless ``cells`` gives
    their number.
    """
    counts = durable(counts)
    cells = cells or max(4, -(-(counts.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) // CELL_VALUES))
    marks = F.percentile_approx("value", [i / cells for i in range(1, cells)], max(1000, 10 * cells))
    # Stored, as marks of a sketch differ with the order its parts come in, and rows and offsets must have the same cells.
    ends = durable(counts.groupBy(*keys).agg(marks.alias("marks"), F.sum("na").alias("ta"), F.sum("nb").alias("tb")))
    at = F.size(F.filter("marks", lambda m: m < F.col("value")))
    placed = counts.join(ends, keys).withColumn("cell", at).drop("marks")
    totals = placed.groupBy(*keys, "cell").agg(F.sum("na").alias("ca"), F.sum("nb").alias("cb"))
    earlier = Window.partitionBy(*keys).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "cell", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"o{c[1]}") for c in ("ca", "cb")))
    inside = Window.partitionBy(*keys, "cell").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    out = placed.join(offsets, [*keys, "cell"])
    return out.withColumns({f"b{s}": F.col(f"o{s}") + F.coalesce(F.sum(f"n{s}").over(inside), F.lit(0)) for s in "ab"}).drop("cell", "oa", "ob")


def pair_counts(df: DataFrame, cols: list[str], dataset: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(pair, feature, value, na, nb): values are counted once for all datasets, then set side by side for each pair."""
    names = sorted({name for pair in pairs for name in pair})
    long = unpivot(df.where(F.col(dataset).isin(*names)), [dataset], cols).where("value IS NOT NULL")
    counts = long.groupBy("feature", "value").agg(*(F.count_if(F.col(dataset) == name).alias(f"__{k}") for k, name in enumerate(names)))
    sides = [F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(f"__{names.index(a)}").alias("na"), F.col(f"__{names.index(b)}").alias("nb")) for a, b in pairs]
    return counts.select("feature", "value", F.explode(F.array(*sides)).alias("e")).select("e.pair", "feature", "value", "e.na", "e.nb").where("na + nb > 0")


def ks_from(ranked: DataFrame, keys: list[str]) -> DataFrame:
    gap = F.abs((F.col("ba") + F.col("na")) / F.col("ta") - (F.col("bb") + F.col("nb")) / F.col("tb"))
    out = ranked.where("ta > 0 AND tb > 0").groupBy(*keys).agg(F.max(gap).alias("ks"), F.max("ta").alias("ta"), F.max("tb").alias("tb"))
    scale = F.sqrt(F.col("ta") * F.col("tb") / (F.col("ta") + F.col("tb")))
    return out.select(*keys, "ks", kolmogorov_tail(scale * F.col("ks")).alias("ks_p"))


def mann_whitney_from(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """U of the first side, and its two-sided p by the normal approximation with ties and continuity corrected."""
    t = (F.col("na") + F.col("nb")).cast("double")
    rank = F.col("ba") + F.col("bb") + (t + 1) / 2
    sums = ranked.where("ta > 0 AND tb > 0").groupBy(*keys).agg(F.sum(F.col("na") * rank).alias("ra"), F.sum(t * t * t - t).alias("ties"), F.max("ta").cast("double").alias("ta"), F.max("tb").cast("double").alias("tb"))
    u, n = F.col("ra") - F.col("ta") * (F.col("ta") + 1) / 2, F.col("ta") + F.col("tb")
    sd = F.sqrt(F.col("ta") * F.col("tb") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.greatest(F.abs(u - F.col("ta") * F.col("tb") / 2) - 0.5, F.lit(0.0)), sd)
    return sums.select(*keys, u.alias("u"), F.coalesce(F.least(F.lit(1.0), normal_tail(z)), F.lit(1.0)).alias("mw_p"))


def ks_2samp(df: DataFrame, cols: list[str], dataset: str, pairs: list[tuple[str, str]]) -> DataFrame:
    return ks_from(ranked_pairs(df, cols, dataset, pairs), ["pair", "feature"])


def mann_whitney(df: DataFrame, cols: list[str], dataset: str, pairs: list[tuple[str, str]]) -> DataFrame:
    return mann_whitney_from(ranked_pairs(df, cols, dataset, pairs), ["pair", "feature"])


def effects_from(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """Cohen's d (population variances weighted by n - 1; 0 where they vanish) and differences of mean and median."""
    means = ranked.groupBy(*keys).agg(*(F.try_divide(F.sum(F.col(f"n{s}") * F.col("value")), F.sum(f"n{s}")).alias(f"m{s}") for s in "ab"))
    near = ranked.join(means, keys)

    def of(side: str) -> list[Column]:
        n, before, total, off = (F.col(f"{x}{side}") for x in "nbtm")
        place = (total - 1) / 2

        def at(rank):
            return F.max(F.when((before <= rank) & (rank < before + n), F.col("value")))

        middle = (at(F.floor(place)) + at(F.ceil(place))) / 2
        return [F.max(total).alias(f"t{side}"), F.max(off).alias(f"m{side}"), F.try_divide(F.sum(n * (F.col("value") - off) * (F.col("value") - off)), F.sum(n)).alias(f"v{side}"), middle.alias(f"q{side}")]

    s = near.groupBy(*keys).agg(*of("a"), *of("b"))
    pooled = F.sqrt(F.try_divide((F.col("ta") - 1) * F.col("va") + (F.col("tb") - 1) * F.col("vb"), F.col("ta") + F.col("tb") - 2))
    d = F.coalesce(F.try_divide(F.col("ma") - F.col("mb"), pooled), F.lit(0.0))
    return s.select(*keys, d.alias("cohens_d"), (F.col("ma") - F.col("mb")).alias("mean_difference"), (F.col("qa") - F.col("qb")).alias("median_difference"))


def ranked_pairs(df: DataFrame, cols: list[str], dataset: str, pairs: list[tuple[str, str]]) -> DataFrame:
    return below(pair_counts(df, cols, dataset, pairs), ["pair", "feature"])


def effect_sizes(df: DataFrame, cols: list[str], dataset: str, pairs: list[tuple[str, str]]) -> DataFrame:
    return effects_from(ranked_pairs(df, cols, dataset, pairs), ["pair", "feature"])


def drift_report(df: DataFrame, cols: list[str], dataset: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """All tests and effects of each feature and pair, with flags at 0.05 and 0.001 (by the lesser p)."""
    keys = ["pair", "feature"]
    ranked = durable(ranked_pairs(df, cols, dataset, pairs))
    out = effects_from(ranked, keys).join(ks_from(ranked, keys), keys).join(mann_whitney_from(ranked, keys), keys)
    least = F.least("ks_p", "mw_p")
    return out.withColumns({"significant_05": least < 0.05, "significant_001": least < 0.001})


def significant_shares(report: DataFrame) -> DataFrame:
    """Share of significant features for each pair and (pair null) overall."""
    return report.groupingSets([[], ["pair"]], "pair").agg(F.avg(F.col("significant_05").cast("double")).alias("share_05"), F.avg(F.col("significant_001").cast("double")).alias("share_001"))


def error_feature_effects(df: DataFrame, cols: list[str], true: str, predicted: str, tests: bool = True) -> DataFrame:
    """For each class and feature: means of right and wrong rows, their distance, rows and U-test p; both sides need two rows.

    Without ``tests`` there is no p, and no value is counted: what asks for means alone takes one aggregation.
    """
    ok = (F.col(true) == F.col(predicted)).alias("ok")
    long = unpivot(df.select(F.col(true).alias("class"), ok, *cols), ["class", "ok"], cols)
    keys = ["class", "feature"]

    def when(flag: Column) -> Column:
        return F.when(flag, F.col("value"))

    means = long.groupBy(*keys).agg(F.avg(when(F.col("ok"))).alias("mean_right"), F.avg(when(~F.col("ok"))).alias("mean_wrong"), F.count(when(F.col("ok"))).alias("n_right"), F.count(when(~F.col("ok"))).alias("n_wrong")).where("n_right > 1 AND n_wrong > 1")
    if tests:
        means = means.join(mann_whitney_from(below(value_counts(long, keys, F.col("ok")), keys), keys).select(*keys, "mw_p"), keys)
    else:
        means = means.where("class IS NOT NULL")
    return means.withColumn("effect", F.abs(F.col("mean_right") - F.col("mean_wrong")))


def confusion_feature_effects(df: DataFrame, cols: list[str], true: str, predicted: str) -> DataFrame:
    """For each (true, predicted) confusion and feature: mean of the confused and of the right rows of the class, distance, rows."""
    long = unpivot(df.select(F.col(true).alias("true_class"), F.col(predicted).alias("predicted_class"), *cols), ["true_class", "predicted_class"], cols)
    means = long.groupBy("true_class", "predicted_class", "feature").agg(F.avg("value").alias("mean"), F.count("value").alias("n"))
    # A class's right row is found among its own rows of means, so that the table behind them is read once.
    w, right = Window.partitionBy("true_class", "feature"), F.col("true_class") == F.col("predicted_class")
    marked = means.withColumns({"mean_right": F.max(F.when(right, F.col("mean"))).over(w), "__right": F.count_if(right).over(w)})
    wrong = marked.where("true_class <> predicted_class AND __right > 0").drop("__right").withColumnRenamed("mean", "mean_confused")
    return wrong.withColumn("effect", F.abs(F.col("mean_confused") - F.col("mean_right")))


def effect_pivot(effects: DataFrame, classes: list[int], value: str, fill: float) -> DataFrame:
    """feature x class table of a value of ``error_feature_effects``."""
    return effects.groupBy("feature").pivot("class", classes).agg(F.avg(value)).fillna(fill)


def log_p_pivot(effects: DataFrame, classes: list[int]) -> DataFrame:
    """feature x class of -log10 p, p at least 1e-10 and 1 where there is no test."""
    wide = effect_pivot(effects, classes, "mw_p", 1.0)
    return wide.select("feature", *((-F.log10(F.greatest(F.col(str(c)), F.lit(1e-10)))).alias(str(c)) for c in classes))


def confusion_pivot(effects: DataFrame, classes: list[int]) -> DataFrame:
    return effects.groupBy("true_class").pivot("predicted_class", classes).agg(F.avg("effect"))


def feature_problem_rank(effects: DataFrame) -> DataFrame:
    return effects.groupBy("feature").agg(F.avg("effect").alias("mean_effect"))
