"""Classifiers for each group on ``pyspark.ml``: fitting, tuning, voting, routing and prediction."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainspark.functions.durable import durable, release, temporary
from grainspark.functions.parse import normalise_schema
from grainspark.operators.clusters import with_vector
from grainspark.operators.features import INPUTS, NEW, engineer_features, shape_extremes
from grainspark.operators.relational import trainable_groups
from grainspark.operators.sampling import ClassHashes, hash_folds, hash_order
from grainspark.operators.stats import anova_f, apply_scaler, class_accuracy, classification_report, confusion_matrix, fit_scaler, impute_median, medians, select_k_best, with_row_weights


@dataclass
class Boosted:
    """One boosted binary model for each class; their probabilities are scaled to sum to one."""

    models: dict[int, Model]

    def transform(self, df: DataFrame) -> DataFrame:
        out = df
        for c, m in self.models.items():
            m = m.copy().setPredictionCol(f"__pred{c}").setProbabilityCol(f"__prob{c}").setRawPredictionCol(f"__raw{c}")
            out = m.transform(out).withColumn(f"__p{c}", vector_to_array(f"__prob{c}")[1]).drop(f"__pred{c}", f"__prob{c}", f"__raw{c}")
        total = sum((F.col(f"__p{c}") for c in list(self.models)[1:]), F.col(f"__p{next(iter(self.models))}"))
        return out.withColumn("probabilities", F.array(*(F.try_divide(F.col(f"__p{c}"), total) for c in self.models))).drop(*(f"__p{c}" for c in self.models))


@dataclass
class Plain:
    """A fitted multinomial model whose label indexes are positions in ``classes``."""

    model: Model
    classes: list[int]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df).withColumn("probabilities", vector_to_array("probability")).drop("probability", "rawPrediction", "prediction")


def _indexed(df: DataFrame, label: str, classes: list[int]) -> DataFrame:
    return df.withColumn("__label", F.array_position(F.array(*(F.lit(c) for c in classes)), F.col(label)).cast("double") - 1)


def boosted_trees(df: DataFrame, label: str, classes: list[int], weight: str | None = None, **params) -> Boosted:
    models = {}
    for c in classes:
        gbt = GBTClassifier(featuresCol="features", labelCol="__y", seed=42, **params)
        models[c] = (gbt.setWeightCol(weight) if weight else gbt).fit(df.withColumn("__y", (F.col(label) == c).cast("double")))
    return Boosted(models)


def random_forest(df: DataFrame, label: str, classes: list[int], weight: str | None = None, **params) -> Plain:
    rf = RandomForestClassifier(featuresCol="features", labelCol="__label", seed=42, **params)
    return Plain((rf.setWeightCol(weight) if weight else rf).fit(_indexed(df, label, classes)), classes)


def logistic(df: DataFrame, label: str, classes: list[int], weight: str | None = None, **params) -> Plain:
    lr = LogisticRegression(featuresCol="features", labelCol="__label", family="multinomial", **params)
    return Plain((lr.setWeightCol(weight) if weight else lr).fit(_indexed(df, label, classes)), classes)


KINDS = {"boosted": boosted_trees, "forest": random_forest, "logistic": logistic}


def soft_vote(df: DataFrame, columns: list[str], classes: list[int], weights: list[float] | None = None) -> DataFrame:
    """``probabilities``: (weighted) mean of probability arrays; ``predicted`` the likeliest class, the first among equals; ``confidence``."""
    weights = weights or [1.0] * len(columns)
    total = F.transform(columns[0], lambda x: x * (weights[0] / sum(weights)))
    for c, w in zip(columns[1:], weights[1:], strict=True):
        total = _add_scaled(total, c, w / sum(weights))
    out = df.withColumn("probabilities", total)
    best = F.array_max("probabilities")
    names = F.array(*(F.lit(c) for c in classes))
    return out.withColumn("confidence", best).withColumn("predicted", F.element_at(names, F.array_position("probabilities", best).cast("int")))


def _add_scaled(total, column: str, share: float):
    return F.zip_with(total, F.col(column), lambda a, b: a + b * share)


@dataclass
class Bundle:
    """What scoring needs: features, fitted statistics, models, and the classes in order."""

    features: list[str]
    selected: list[str]
    medians: DataFrame
    extremes: DataFrame
    scaler: DataFrame
    classes: list[int]
    models: dict = field(default_factory=dict)


def matrix_columns(df: DataFrame, label: str, cols: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """What a fit reads of ``df``: label, ``cols`` and what the engineered features are made of; and ``more``."""
    named = normalise_schema(df)
    inputs = [c for c in INPUTS if c != "Gray_ave" or "MeanIntensity" not in named.columns]  # one mean grey is looked at
    return named.select(*dict.fromkeys(c for c in (*more, label, *cols, *inputs) if c in named.columns))


def fit_matrix(train: DataFrame, label: str, cols: list[str], k: int = 15, stored: bool = False) -> Bundle:
    """Statistics of the model matrix: medians, extremes, scaling and the k features of greatest F, all from training rows.

    Each statistic is one row, or one row for each feature; it is fetched once, so that scoring does not fit it anew.
    What the passes read is stored first, unless ``train`` is ``stored`` already.
    """
    spark = train.sparkSession
    every = [*cols, *NEW]
    with temporary(spark):  # what the five passes read is made once, and goes once they are done
        base = matrix_columns(train, label, cols)
        base = base if stored else durable(base)
        extremes = shape_extremes(base)
        extremes = spark.createDataFrame(extremes.collect(), extremes.schema)
        full = engineer_features(base, stats=extremes)
        middle = medians(full, every, stored=True)
        middle = spark.createDataFrame(middle.collect(), middle.schema)
        filled = impute_median(full, every, middle)
        scaler = fit_scaler(filled, every)
        scaler = spark.createDataFrame(scaler.collect(), scaler.schema)
        ranked = select_k_best(anova_f(filled, label, every), k)
        selected = [r["feature"] for r in ranked.where("selected").orderBy("rank").collect()]
        classes = [r[0] for r in base.select(label).where(F.col(label).isNotNull()).distinct().orderBy(label).collect()]
    return Bundle(every, selected, middle, extremes, scaler, classes)


def prepare_matrix(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Engineered columns, median fill, scaling and selection with the bundle's statistics; the features end as a vector."""
    return with_vector(_scaled(df, bundle), bundle.selected)


def _scaled(df: DataFrame, bundle: Bundle) -> DataFrame:
    full = engineer_features(normalise_schema(df), stats=bundle.extremes)
    return apply_scaler(impute_median(full, bundle.features, bundle.medians), bundle.scaler, bundle.features)


def stored_matrix(df: DataFrame, label: str, bundle: Bundle) -> DataFrame:
    """(label, features) of ``prepare_matrix`` for several fits. It is stored by columns, as a feature's equal values are packed there and those of a vector are not."""
    stored = durable(_scaled(df, bundle).select(label, F.struct(*bundle.selected).alias("features")))
    return with_vector(stored.select(label, *(F.col("features")[c].alias(c) for c in bundle.selected)), bundle.selected).select(label, "features")


def vote(ready: DataFrame, models: dict, classes: list[int]) -> DataFrame:
    """The vote of several models over prepared rows (a vector column ``features``)."""
    out, columns = ready, []
    for name, model in models.items():
        out = model.transform(out).withColumnRenamed("probabilities", f"__{name}")
        columns.append(f"__{name}")
    return soft_vote(out, columns, classes).drop(*columns, "features")


def predict(df: DataFrame, bundle: Bundle) -> DataFrame:
    """Rows with probabilities (array and prob_class_<c>), confidence and predicted class by the vote of the bundle's models."""
    out = vote(prepare_matrix(df, bundle), bundle.models, bundle.classes)
    return out.withColumns({f"prob_class_{c}": F.col("probabilities")[k] for k, c in enumerate(bundle.classes)})


def train_bundle(train: DataFrame, label: str, cols: list[str], kinds: dict[str, dict], k: int = 15, stored: bool = False) -> Bundle:
    """Fit the matrix and each kind of model (boosted, forest, logistic: parameters) with balanced weights.

    What ``train`` comes from is computed once, unless it is ``stored`` already.
    """
    base = train if stored else durable(matrix_columns(train, label, cols))
    bundle = fit_matrix(base, label, cols, k, stored=True)
    prepared = stored_matrix(base, label, bundle)
    if not stored:
        release(base)
    ready = with_row_weights(prepared, label)
    bundle.models = {name: KINDS[name](ready, label, bundle.classes, weight="weight", **params) for name, params in kinds.items()}
    release(prepared)
    return bundle


def train_by_group(df: DataFrame, group: str, label: str, cols: list[str], kinds: dict[str, dict], k: int = 15) -> dict[str, Bundle]:
    """A bundle for each group that has enough classes and rows; groups are few, each fit is distributed."""
    usable = [r[group] for r in trainable_groups(df, group, label).where("trainable").orderBy(group).collect()]
    return {g: train_bundle(df.where(F.col(group) == g), label, cols, kinds, k) for g in usable}


def routes(groups: DataFrame, group: str, available: list[str], generic: str = "combined") -> DataFrame:
    """(group, model): the group's own model, else the generic one, else the first there is."""
    fallback = generic if generic in available else min(available, default=None)
    return groups.select(group).distinct().withColumn("model", F.when(F.col(group).isin(*available), F.col(group)).otherwise(F.lit(fallback)))


def route_models(df: DataFrame, group: str, bundles: dict[str, Bundle], generic: str = "combined") -> DataFrame:
    """Predictions of each row by its group's model; one filtered transform for each model, then a union."""
    routed = df.join(F.broadcast(routes(df, group, list(bundles), generic)), group)  # few groups: a shuffle would make one task of each
    parts = [predict(routed.where(F.col("model") == name), b) for name, b in bundles.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def gate_models(scores: DataFrame, least: float = 0.7, fewest: int = 2) -> DataFrame:
    """(model, accuracy, kept): models of enough accuracy; all if fewer than ``fewest`` pass."""
    passed = scores.agg(F.count_if(F.col("accuracy") >= least).alias("__n"))
    return scores.crossJoin(F.broadcast(passed)).withColumn("kept", (F.col("accuracy") >= least) | (F.col("__n") < fewest)).drop("__n")


def fold_rows(df: DataFrame, label: str, key: str, cols: list[str], seed: int = 42) -> DataFrame:
    """What ``fold_scores`` reads, stored: label, matrix columns and the bytes of the key's hash."""
    rows = matrix_columns(df, label, cols, (key,)).withColumn("__hash", F.unhex(hash_order(key, seed)))
    return durable(rows.drop(*({key} - {label, *cols})))


def fold_scores(df: DataFrame, label: str, key: str, cols: list[str], candidates: list[dict[str, dict]], k: int, seed: int, rows: DataFrame | None = None) -> DataFrame:
    """(candidate, fold, accuracy, balanced_accuracy); a candidate maps kinds of models to parameters.

    What does not depend on the candidate (the fold's statistics and matrices) is made once for each fold. Folds are
    those of ``hash_folds``, so rows are stored once and never dealt. ``rows`` may be what ``fold_rows`` has made of ``df``.
    """
    stored = fold_rows(df, label, key, cols, seed) if rows is None else rows
    hash_ = F.lower(F.hex("__hash"))
    with temporary(df.sparkSession):
        found = ClassHashes(stored, [label], key, seed, stored.select(F.col(label).alias("k0"), hash_.alias("hash")))
        folded, scores = stored.withColumn("fold", hash_folds(found, k, hash_)).drop("__hash"), []
    for fold in range(k):
        train = folded.where(F.col("fold") != fold)
        bundle = fit_matrix(train, label, cols, stored=True)
        prepared = stored_matrix(train, label, bundle)
        ready = with_row_weights(prepared, label)
        held = prepare_matrix(folded.where(F.col("fold") == fold), bundle).select(label, "features")  # a pass for each candidate, so not stored
        for number, kinds in enumerate(candidates):
            fitted = {name: KINDS[name](ready, label, bundle.classes, weight="weight", **params) for name, params in kinds.items()}
            right = F.avg((F.col(label) == F.col("predicted")).cast("double"))
            by = vote(held, fitted, bundle.classes).groupBy(label).agg(F.count("*").alias("n"), right.alias("recall"))
            one = by.agg((F.sum(F.col("n") * F.col("recall")) / F.sum("n")).alias("accuracy"), F.avg("recall").alias("balanced")).first()
            scores.append((number, fold, one["accuracy"], one["balanced"]))
        release(prepared)
    if rows is None:
        release(stored)
    return df.sparkSession.createDataFrame(scores, "candidate int, fold int, accuracy double, balanced_accuracy double")


def cv_score(df: DataFrame, label: str, key: str, cols: list[str], kinds: dict[str, dict], k: int = 3, seed: int = 42, rows: DataFrame | None = None) -> DataFrame:
    """(fold, accuracy, balanced_accuracy): one row for each fold held out."""
    return fold_scores(df, label, key, cols, [kinds], k, seed, rows).drop("candidate")


def grid(options: dict[str, list]) -> list[dict]:
    out = [{}]
    for name, values in options.items():
        out = [{**o, name: v} for o in out for v in values]
    return out


def random_draws(options: dict[str, list], n: int, seed: int = 42) -> list[dict]:
    """``n`` different draws from the grid (all of it if it is smaller)."""
    every = grid(options)
    picked = np.random.default_rng(seed).permutation(len(every))[:n]
    return [every[i] for i in sorted(picked.tolist())]


def search(df: DataFrame, label: str, key: str, cols: list[str], kind: str, candidates: list[dict], k: int = 3, seed: int = 42, metric: str = "balanced_accuracy", rows: DataFrame | None = None) -> list[tuple[float, dict]]:
    """(mean score over folds, parameters), best first; used with ``grid`` or ``random_draws``."""
    means = fold_scores(df, label, key, cols, [{kind: params} for params in candidates], k, seed, rows).groupBy("candidate").agg(F.avg(metric).alias("mean")).collect()
    return sorted(((r["mean"], candidates[r["candidate"]]) for r in means), key=lambda x: (-x[0], str(x[1])))


def feature_importance(bundle: Bundle, spark) -> DataFrame:
    """(model, feature, importance, rank) of the models that have importances."""
    rows = []
    for name, model in bundle.models.items():
        fitted = list(model.models.values()) if isinstance(model, Boosted) else [model.model]
        values = [m.featureImportances.toArray() for m in fitted if hasattr(m, "featureImportances")]
        if values:
            mean = np.mean(values, axis=0)
            order = np.argsort(-mean, kind="stable")
            rows += [(name, bundle.selected[i], float(mean[i]), r + 1) for r, i in enumerate(order)]
    return spark.createDataFrame(rows, "model string, feature string, importance double, rank int")


def evaluate(train: DataFrame, test: DataFrame, label: str, classes: list[int]) -> dict[str, DataFrame]:
    """Reports over predicted training and test rows, the side being a grouping key."""
    both = train.select(label, "predicted", "confidence").withColumn("side", F.lit("train")).unionByName(test.select(label, "predicted", "confidence").withColumn("side", F.lit("test")))
    return {
        "confusion": confusion_matrix(both, label, "predicted", classes, ["side"]),
        "report": classification_report(both, label, "predicted", ["side"]),
        "accuracy": class_accuracy(both, label, "predicted", "confidence", "side"),
    }
