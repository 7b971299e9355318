"""Exact quantiles without gathering a group's values in one place.

A mergeable sketch of each group gives, for every wanted quantile, two marks that enclose it. A second pass counts what
lies below the marks and counts the distinct values between them; the quantile is read off those counts. What meets in
one task is the distinct values between two marks: about 8 / ``accuracy`` of a large group, however often one value repeats.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainspark.functions.durable import durable


def join_groups(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null (a null key is a group); without keys each row of ``left`` meets the one row of ``right``."""
    own = right.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    return left.join(own, on or F.lit(True), how).drop(*(f"__k{i}" for i in range(len(keys))))


def quantiles(long: DataFrame, keys: list[str], at: list[float], value: str = "value", accuracy: int = 20_000, stored: bool = False) -> DataFrame:
    """(keys, n, q): for each group the number of its values and an array of quantiles, linear between neighbours.

    Missing values (null, NaN) do not count; a group without values has n = 0 and null quantiles. Null keys are a group.
    Keys and values are written once, so that what they come from is computed once, unless ``long`` is ``stored`` already;
    so is the sketch, a row for each group.
    """
    v = F.col(value).cast("double")
    base = long.select(*keys, F.when(~F.isnan(v), v).alias("__v"))
    base = base if stored else durable(base)
    # The sketch errs by 1 / accuracy of the rows, and interpolation needs a rank on either side; small groups are taken whole.
    slack = 3.0 / accuracy
    marks = [max(0.0, q - slack) for q in at] + [min(1.0, q + slack) for q in at]
    # Stored, as three steps read it, and as its size then says whether the rows have to be dealt by group to meet it.
    sketch = durable(base.groupBy(*keys).agg(F.count("__v").alias("n"), F.percentile_approx("__v", marks, accuracy).alias("__m")))
    few = F.array_repeat(F.lit(float("-inf")), len(at)), F.array_repeat(F.lit(float("inf")), len(at))
    bounds = sketch.withColumn("__m", F.when(F.col("n") < accuracy, F.concat(*few)).otherwise(F.col("__m"))).drop("n")
    joined = join_groups(base.where("__v IS NOT NULL"), bounds, keys)
    m, k = F.col("__m"), len(at)
    sides = [F.when(F.col("__v") < m[i], F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("v"))).when(F.col("__v") <= m[i + k], F.struct(F.lit(i).alias("i"), F.col("__v").alias("v"))) for i in range(k)]
    parts = joined.select(*keys, F.explode(F.filter(F.array(*sides), lambda s: s.isNotNull())).alias("s"))
    counts = parts.groupBy(*keys, F.col("s.i").alias("__i"), F.col("s.v").alias("__v")).agg(F.count("*").alias("__c"))
    ends = F.sum("__c").over(Window.partitionBy(*keys, "__i").orderBy(F.asc_nulls_first("__v")))
    both = join_groups(counts.withColumn("__end", ends), sketch.drop("__m"), keys)
    place = F.element_at(F.array(*(F.lit(float(q)) for q in at)), F.col("__i") + 1) * (F.col("n") - 1)
    low, high = F.floor(place), F.ceil(place)

    def value_at(rank):
        return F.max(F.when((F.col("__end") - F.col("__c") <= rank) & (rank < F.col("__end")), F.col("__v")))

    each = both.groupBy(*keys, "__i").agg(value_at(low).alias("a"), value_at(high).alias("b"), F.max(place - low).alias("f"))
    found = each.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", (F.col("a") + (F.col("b") - F.col("a")) * F.col("f")).alias("q")))), lambda s: s["q"]).alias("q"))
    out = join_groups(sketch.drop("__m"), found, keys, "left")
    return out.withColumn("q", F.coalesce("q", F.array_repeat(F.lit(None).cast("double"), k)))
