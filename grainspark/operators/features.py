"""Engineered particle features. Extremes come from ``stats`` (training extremes) or from the frame itself, by group if asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6
NEW = ["Shape_Complexity", "Area_Perimeter_Ratio", "Convex_Efficiency", "Eccentricity_Robust", "Distance_Ratio", "Distance_Interaction", "Intensity_Stability", "Comprehensive_Shape", "Class4_Discriminator"]

#: Columns that the features are made of.
INPUTS = ["Area", "Major", "Minor", "Eccentricity", "ConvexArea", "Circularity", "Extent", "Perimeter", "MeanIntensity", "Gray_ave", "Gray_var", "dis", "dis_normal", "Major_Minor_ratio"]


def clip(c: Column, low: float, high: float) -> Column:
    """Null and NaN pass through."""
    return F.when(c.isNull() | F.isnan(c), c).otherwise(F.greatest(F.least(c, F.lit(high)), F.lit(low)))


def shape_extremes(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    return df.groupBy(*(by or [])).agg(*(f(c).alias(f"__{n}_{c}") for c in ("Extent", "Circularity") for n, f in (("min", F.min), ("max", F.max))))


def engineer_features(df: DataFrame, by: list[str] | None = None, stats: DataFrame | None = None, recompute_ratio: bool = False, tolerant: bool = False) -> DataFrame:
    """Add the nine features.

    ``recompute_ratio`` replaces Major_Minor_ratio by Major / (Minor + eps). ``tolerant`` adds eps to the min-max
    denominators, leaves out features whose inputs are absent, and uses Gray_var x (1 - Circularity) as the last one.
    A constant column makes Shape_Complexity null unless ``tolerant``.
    """
    have = set(df.columns)
    grey = next((c for c in ("MeanIntensity", "Gray_ave") if c in have), None)
    if recompute_ratio:
        df = df.withColumn("Major_Minor_ratio", F.col("Major") / (F.col("Minor") + EPS))

    def unit(c: str) -> Column:
        width = F.col(f"__max_{c}") - F.col(f"__min_{c}") + (EPS if tolerant else 0.0)
        return F.try_divide(F.col(c) - F.col(f"__min_{c}"), width)

    robust = clip(F.col("Eccentricity"), 0.0, 1.0)
    last = ({"Gray_var", "Circularity"}, lambda: F.col("Gray_var") * (1 - F.col("Circularity"))) if tolerant else ({"Extent", "Circularity", "Perimeter"}, lambda: F.col("Extent") * F.col("Circularity") * F.col("Perimeter"))
    made = {
        "Shape_Complexity": ({"Extent", "Circularity"}, lambda: unit("Extent") * (1 - unit("Circularity"))),
        "Area_Perimeter_Ratio": ({"Area", "Perimeter"}, lambda: F.col("Area") / (F.col("Perimeter") + EPS)),
        "Convex_Efficiency": ({"Area", "ConvexArea"}, lambda: F.col("Area") / (F.col("ConvexArea") + EPS)),
        "Eccentricity_Robust": ({"Eccentricity"}, lambda: robust),
        "Distance_Ratio": ({"dis", "dis_normal"}, lambda: F.col("dis") / (F.col("dis_normal") + EPS)),
        "Distance_Interaction": ({"dis", "dis_normal"}, lambda: F.col("dis") * F.col("dis_normal")),
        "Intensity_Stability": ({"Gray_var"}, lambda: (F.col(grey) if grey else F.lit(0.0)) / (F.col("Gray_var") + EPS)),
        "Comprehensive_Shape": ({"Major_Minor_ratio", "Circularity", "Eccentricity"}, lambda: F.col("Major_Minor_ratio") * F.col("Circularity") * (1 - robust)),
        "Class4_Discriminator": last,
    }
    if lacking := [n for n, (needs, _) in made.items() if not needs <= have]:
        if not tolerant:
            raise ValueError(f"columns for {lacking} are missing")
    wanted = {n: f for n, (needs, f) in made.items() if needs <= have}
    if "Shape_Complexity" in wanted:
        extremes = F.broadcast(stats if stats is not None else shape_extremes(df, by))
        df = df.join(extremes, by) if by else df.crossJoin(extremes)
    out = df.withColumns({n: f() for n, f in wanted.items()})
    return out.drop(*(f"__{n}_{c}" for c in ("Extent", "Circularity") for n in ("min", "max")))
