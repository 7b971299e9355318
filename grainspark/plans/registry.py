"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainspark.operators.ranking import top_n
from grainspark.operators.relational import join_predictions
from grainspark.operators.stats import right
from grainspark.plans import imaging, learning, tables
from grainspark.plans.base import Query
from grainspark.plans.sqlviews import PREDICTIONS, with_views
from grainspark.sources import fixtures as fx


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two classes of each experiment that are predicted worst, with accuracy, mean confidence and rows."""
    truth = fx.particles(spark, sf_dir).select("row_id", "type", "experiment")
    joined = join_predictions(truth, fx.predictions(spark, sf_dir).select("row_id", "enhanced", "confidence"))
    scored = joined.groupBy("experiment", "type").agg(F.avg(right("type", "enhanced")).alias("accuracy"), F.avg("confidence").alias("mean_confidence"), F.count("*").alias("n"))
    return top_n(scored, ["experiment"], [F.col("accuracy"), F.col("type")], 2)


FLAGSHIP = Query(
    flagship,
    "experiment type accuracy* mean_confidence* n# rank#",
    with_views("""WITH s AS (SELECT experiment, type, avg(CASE WHEN type = enhanced THEN 1::DOUBLE ELSE 0 END) AS accuracy, avg(confidence) AS mean_confidence, count(*) AS n FROM predictions GROUP BY ALL)
      SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY accuracy, type) AS rank FROM s) WHERE rank <= 2""", PREDICTIONS),
)

MODULES = (tables, learning, imaging)


def _all() -> dict[str, Query]:
    out = {"worst_classes": FLAGSHIP}
    for m in MODULES:
        out |= m.QUERIES
    return out


def queries() -> dict:
    return dict(_all())


def oracle_sql() -> dict[str, str]:
    return {n: q.oracle() for n, q in _all().items() if q.sql}
