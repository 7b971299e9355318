"""Scalar parsing: file names, folder names, labels, boxes and channels. All are column expressions.

Text that does not parse gives null, never an error; callers keep such rows as rejects.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that never are features, fixed values of the particle tables.
NOT_FEATURES = ("NO.", "ID", "type", "Centroid", "BoundingBox", "WeightedCentroid", "PixelldxList", "PixList", "PixelValues", "Image", "FilledArea", "FilledArea.1", "Gray_var.1")
SHAPE = ("Area", "Major", "Minor", "Eccentricity", "ConvexArea", "Circularity", "Extent", "Perimeter", "Major_Minor_ratio")
INTENSITY = ("MeanIntensity", "Gray_ave", "Gray_var", "Gray_skew", "Gray_skew_abs", "Gray_kur", "normalized_local_mean_gray")


def frame_ts(name: Column) -> Column:
    """The time in the first ``_<17 digits>_`` of a file name (yyyyMMddHHmmssSSS), or null."""
    digits = F.regexp_extract(name, r"_(\d{17})_", 1)
    spaced = F.regexp_replace(digits, r"^(\d{4})(\d{2})(\d{2})(\d{2})(\d{2})(\d{2})(\d{3})$", "$1-$2-$3 $4:$5:$6.$7")
    return F.when(digits != "", F.try_to_timestamp(spaced, F.lit("yyyy-MM-dd HH:mm:ss.SSS")).cast("timestamp_ntz"))


def chemistry(folder: Column) -> Column:
    """Struct (Na2CO3_mM, CaCl_mM): ``a+bmM`` gives both, a single value counts for both, more plus signs give null; a backtick is the decimal point."""
    found = F.regexp_extract(folder, r"([\d`+]+)mM", 1)
    parts = F.split(F.regexp_replace(found, "`", "."), r"\+")
    value = [F.try_element_at(parts, F.lit(k)).try_cast("double") for k in (1, 2)]
    usable = (found != "") & (F.size(parts) <= 2)
    return F.struct(F.when(usable, value[0]).alias("Na2CO3_mM"), F.when(usable, F.when(F.size(parts) == 1, value[0]).otherwise(value[1])).alias("CaCl_mM"))


def replicate(folder: Column) -> Column:
    return F.regexp_extract(folder, r"(\d+)-mix", 1).try_cast("int")


def concentration(name: Column, mode: str = "train") -> Column:
    """``3mM`` or ``6mM`` by substring, the former first; otherwise 3mM in training, and in validation by val3 / val6 or null."""
    if mode == "train":
        return F.when(name.contains("3mM"), "3mM").when(name.contains("6mM"), "6mM").otherwise("3mM")
    low = F.lower(name)
    return F.when(low.contains("3mm") | low.contains("val3"), "3mM").when(low.contains("6mm") | low.contains("val6"), "6mM")


def normalise_schema(df: DataFrame) -> DataFrame:
    """Aera becomes Area where that is absent, NO. becomes ID; the mean greys come from MeanIntensity, or are 0."""
    for old, new in (("Aera", "Area"), ("NO.", "ID")):
        if old in df.columns and new not in df.columns:
            df = df.withColumnRenamed(old, new)
    for name in ("Gray_ave", "overall_mean_gray"):
        if name not in df.columns:
            df = df.withColumn(name, F.col("MeanIntensity").cast("double") if "MeanIntensity" in df.columns else F.lit(0.0))
    return df


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = NOT_FEATURES) -> list[str]:
    """Numeric columns that are neither excluded nor unnamed."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude and not f.name.startswith("Unnamed")]


def feature_groups(names: list[str]) -> dict[str, list[str]]:
    kinds = {"shape": [n for n in names if n in SHAPE], "intensity": [n for n in names if n in INTENSITY]}
    return kinds | {"other": [n for n in names if n not in SHAPE and n not in INTENSITY]}


def label_codes(df: DataFrame, label: str) -> DataFrame:
    """(label, code): distinct non-null labels, numbered from 0 in order; one row for each class."""
    found = df.select(label).where(F.col(label).isNotNull()).distinct().agg(F.sort_array(F.collect_set(label)).alias("labels"))
    return found.select(F.posexplode("labels").alias("code", label))


def encode_labels(df: DataFrame, codes: DataFrame, label: str, unknown: int | None = None) -> DataFrame:
    """Add ``<label>_code``; labels not in ``codes`` get ``unknown``."""
    known = codes.select(F.col(label).alias("__label"), F.col("code"))
    out = df.join(known, F.col(label) == F.col("__label"), "left").drop("__label")
    return out.withColumn(f"{label}_code", F.coalesce("code", F.lit(unknown)) if unknown is not None else F.col("code")).drop("code")


def decode_labels(code: Column, labels: dict[int, int]) -> Column:
    mapping = F.create_map(*(F.lit(x) for x in chain.from_iterable(labels.items())))
    return F.try_element_at(mapping, code)


def bbox_window(df: DataFrame, column: str = "BoundingBox", offset: int = 0, border: int = 0, height: int | None = None, width: int | None = None) -> DataFrame:
    """Add x0, y0, x1, y1 (end exclusive) from ``[x, y, w, h]`` counted from 1: rounded half to even, moved, grown and clamped."""
    box = F.from_json(F.col(column), "array<double>") if dict(df.dtypes)[column] == "string" else F.col(column)
    x, y, w, h = (F.rint(box[k]).cast("int") for k in range(4))
    x0, y0 = x - 1 + offset - border, y - 1 + offset - border
    x1, y1 = x0 + w + 2 * border, y0 + h + 2 * border

    def clamp(c: Column, top: int | None) -> Column:
        c = F.greatest(c, F.lit(0))
        return F.least(c, F.lit(top)) if top is not None else c

    return df.withColumns({"x0": clamp(x0, width), "y0": clamp(y0, height), "x1": clamp(x1, width), "y1": clamp(y1, height)})


def derive_name(name: Column, add: str = "", remove: str = "", extension: str | None = None) -> Column:
    """The name's stem without ``remove`` and with ``add``, under the same or another extension; slashes become underscores."""
    stem = F.regexp_replace(name, r"\.[^./]*$", "")
    if remove:
        stem = F.replace(stem, F.lit(remove), F.lit(""))
    tail = F.lit(extension) if extension is not None else F.regexp_extract(name, r"(\.[^./]*)$", 1)
    return F.replace(F.concat(stem, F.lit(add), tail), F.lit("/"), F.lit("_"))


def p_stars(p: Column, none: str = "ns") -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").when(p.isNotNull(), none)


def to_gray(r: Column, g: Column, b: Column) -> Column:
    """Luma of 299, 587 and 114 thousandths, rounded as integer arithmetic of 16 bits does."""
    return F.shiftright(r * 19595 + g * 38470 + b * 7471 + 0x8000, 16).cast("int")


def channel(number: int, r: Column, g: Column, b: Column, a: Column) -> Column:
    """Channels 0 to 2, or 3 and 4 for alpha where there is one (4 falls back to green)."""
    return {0: r, 1: g, 2: b, 3: a, 4: F.coalesce(a, g)}[number]
