"""End-to-end training: catalogue, balance, features, fit, score and report, with skip flags and a step table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainspark.operators.models import Bundle, evaluate, predict, train_bundle
from grainspark.operators.sampling import balance_experiments
from grainspark.operators.stats import run_report
from grainspark.sources.catalog import experiment_catalog


@dataclass
class Config:
    features: list[str]
    label: str = "type"
    key: str = "row_id"
    kinds: dict[str, dict] = field(default_factory=lambda: {"forest": {"numTrees": 20}, "logistic": {"maxIter": 20}})
    selected: int = 15
    seed: int = 42
    skip: tuple[str, ...] = ()


@dataclass
class Result:
    catalog: DataFrame
    steps: DataFrame
    summary: DataFrame
    bundle: Bundle | None = None
    predictions: DataFrame | None = None
    reports: dict[str, DataFrame] = field(default_factory=dict)


def run_pipeline(df: DataFrame, config: Config) -> Result:
    """``df`` has experiment and split columns; a skipped or failed step ends in the step table, later steps follow."""
    spark, steps = df.sparkSession, []
    out = Result(experiment_catalog(df, config.label), df, df)

    def step(name: str, work):
        if name in config.skip:
            steps.append((name, "skipped", ""))
            return None
        try:
            value = work()
        except Exception as e:  # noqa: BLE001  the report names it
            steps.append((name, "failed", f"{type(e).__name__}: {e}"[:500]))
            return None
        steps.append((name, "ok", ""))
        return value

    train = df.where(F.col("split") == "train")
    balanced = step("balance", lambda: balance_experiments(train, "experiment", config.label, config.key, config.seed))
    out.bundle = step("train", lambda: train_bundle(balanced if balanced is not None else train, config.label, config.features, config.kinds, config.selected))
    if out.bundle is not None:
        out.predictions = step("predict", lambda: predict(df, out.bundle))
    if out.predictions is not None:
        p = out.predictions
        out.reports = step("report", lambda: evaluate(p.where("split = 'train'"), p.where("split <> 'train'"), config.label, out.bundle.classes)) or {}
    out.steps = spark.createDataFrame(steps, "step string, status string, error string")
    out.summary = run_report(out.steps)
    return out
