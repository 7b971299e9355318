"""Splits, balancing and resampling, decided by hashes of a stable row key.

A row's place is the order of md5(key|seed) within its class, so results do not depend on partitions or retries. Where
only the first k rows of a class are wanted, the k-th hash is found by counting prefixes level by level, and one filter
on the hash takes the rows: no row is sorted, ranked or joined (``ClassHashes``).
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainspark.functions.durable import durable, release
from grainspark.operators.neighbours import knn_join

#: Hexadecimal digits that one level of a selection looks at, and rows of a class that the last level takes whole.
DIGITS, LAST = 3, 100_000


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))


def with_class_rank(df: DataFrame, label: list[str], key: str, seed: int, rank: str = "__r", size: str = "__n") -> DataFrame:
    """Add the place of each row in the hash order of its class, from 1, and the rows of the class; null classes are classes.

    Rows are ranked inside the 4,096 beginnings of a hash, and each beginning starts after the rows before it, so no
    class is sorted in one task. Hashes are dealt as bytes and keys are not looked at (equal hashes are equal keys), so a
    key that is not wanted may be dropped from the result and is not dealt then.
    """
    text = hash_order(key, seed)
    marked = df.withColumns({"__h": F.unhex(text), "__b": F.conv(F.substring(text, 1, 3), 16, 10).cast("int")})
    counts = marked.groupBy(*label, "__b").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*label)
    before = F.coalesce(F.sum("__c").over(w.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(label)), F.col("__b").alias("__o"), before.alias("__before"), F.sum("__c").over(w).alias(size))
    joined = marked.join(offsets, [*(F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(label)), F.col("__b") == F.col("__o")])
    inside = F.row_number().over(Window.partitionBy(*label, "__b").orderBy("__h"))
    return joined.withColumn(rank, inside + F.col("__before")).drop("__h", "__b", "__o", "__before", *(f"__k{i}" for i in range(len(label))))


class ClassHashes:
    """Rows of ``df`` by class and hash, to take the first rows of each class in hash order.

    Classes and hashes are stored once. One pass counts them by class and first digits; one picks the rows whose digits are
    those of a class's last wanted row, a 4,096th part of the class, and only their hashes are looked at further. The driver holds
    one entry for each class. Null classes are classes. Rows that share a key are taken together, or left if not all fit.
    """

    def __init__(self, df: DataFrame, label: list[str], key: str, seed: int, rows: DataFrame | None = None):
        """``rows`` (k0, k1, ..., hash) may stand for what would be read of ``df``: the stored table of another selection, filtered."""
        self.hash = hash_order(key, seed)
        self.rows = durable(df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(label)), self.hash.alias("hash"))) if rows is None else rows
        keys = [f"k{i}" for i in range(len(label))]
        name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
        self.counts = durable(self.rows.groupBy(*keys, F.substring("hash", 1, DIGITS).alias("digits")).agg(F.count("*").alias("n")).withColumn("name", name))
        found = self.counts.groupBy("name", *keys).agg(F.sum("n").alias("n")).collect()  # one for each class
        self.sizes = {r["name"]: r["n"] for r in found}
        self.values = {r["name"]: tuple(r[k] for k in keys) for r in found}
        self.label = label

    def pick(self, values: dict, columns: list[str] | None = None) -> Column:
        """The value of each row's class; null for a class without one."""
        out = F.lit(None)
        for name, v in values.items():
            own = F.lit(True)
            for c, x in zip(columns or self.label, self.values[name], strict=True):
                own = own & F.col(c).eqNullSafe(F.lit(x))
            out = F.when(own, F.lit(v)).otherwise(out)
        return out

    def first(self, wanted: dict[str, int]) -> Column:
        """True for the first ``wanted`` rows of each class (by ``sizes``' names), as a condition on the table's columns."""
        return self.condition(self.ends(wanted))

    def condition(self, below: dict[str, str], columns: list[str] | None = None, hash_: Column | None = None) -> Column:
        """Hashes below their class's end, on the table's columns or on those of ``rows``."""
        return F.coalesce((self.hash if hash_ is None else hash_) < self.pick({c: b for c, b in below.items() if b}, columns), F.lit(False))

    def ends(self, wanted: dict[str, int]) -> dict[str, str]:
        """For each class what the hashes of its first ``wanted`` rows are below, and no others."""
        below = {name: "" if wanted.get(name, 0) <= 0 else "g" for name in self.sizes}  # "g" is above every digit
        left = {name: k for name, k in wanted.items() if 0 < k < self.sizes[name]}
        prefix = dict.fromkeys(left, "")
        keys = [f"k{i}" for i in range(len(self.label))]
        counts, rows, narrow, most = self.counts, self.rows, None, 0
        while left:
            so_far = F.sum("n").over(Window.partitionBy(*keys).orderBy("digits"))  # 4,096 counts a class
            asked = counts.withColumn("wanted", self.pick(left, keys)).where("wanted IS NOT NULL").withColumn("end", so_far)
            for r in asked.where((F.col("end") >= F.col("wanted")) & (F.col("end") - F.col("n") < F.col("wanted"))).collect():  # one for each class
                name, digits, rest = r["name"], prefix[r["name"]] + r["digits"], r["wanted"] - (r["end"] - r["n"])
                prefix[name], left[name] = digits, rest
                most = max(most, r["n"])
                if rest == r["n"] or len(digits) >= 32:
                    below[name] = digits + ("g" if rest == r["n"] else "")
                    del left[name], prefix[name]
            if left:
                at = len(next(iter(prefix.values())))
                before, narrow = narrow, durable(rows.where(F.substring("hash", 1, at) == self.pick(prefix, keys)))
                rows = narrow
                name = F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})
                wide = DIGITS if most > LAST else 32
                most = 0
                counts = narrow.groupBy(*keys, F.substring("hash", at + 1, wide).alias("digits")).agg(F.count("*").alias("n")).withColumn("name", name)
                release(*([before] if before is not None else []))
        release(*([narrow] if narrow is not None else []))
        return below


def stratified_split(df: DataFrame, label: str, key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """``part``: test for round(fraction x rows) of each class, else train."""
    found = ClassHashes(df, [label], key, seed)
    wanted = {name: int(Decimal(repr(n * fraction)).quantize(Decimal(1), ROUND_HALF_UP)) for name, n in found.sizes.items()}
    return df.withColumn("part", F.when(found.first(wanted), "test").otherwise("train"))


def stratified_split_approx(df: DataFrame, label: str, key: str, fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """The same without a sort: a row's own hash decides, so shares hold on average only."""
    u = F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("double") / float(1 << 32)
    return df.withColumn("part", F.when(u < fraction, "test").otherwise("train"))


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    return with_class_rank(df, [label], key, seed).withColumn("fold", ((F.col("__r") - 1) % k).cast("int")).drop("__r", "__n")


def hash_folds(found: ClassHashes, k: int, hash_: Column) -> Column:
    """The fold of each row, from 0: the k-ths of its class one after the other in hash order, equal but for one row.

    No row is ranked, sorted or dealt: the ends of the folds are found by counting. Rows that share a key share a fold.
    """
    ends = (found.ends({name: n * fold // k for name, n in found.sizes.items()}) for fold in range(1, k))
    return sum(((~found.condition(e, hash_=hash_)).cast("int") for e in ends), F.lit(0))


def undersample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each class as the smallest one has."""
    found = ClassHashes(df, [label], key, seed)
    least = min(found.sizes.values(), default=0)
    return df.where(found.first(dict.fromkeys(found.sizes, least)))


def balance_experiments(df: DataFrame, experiment: str, label: str, key: str, seed: int = 42) -> DataFrame:
    """Experiments above the median size are cut to it, class by class in proportion, then topped up from what is left.

    Each class keeps min(rows, max(1, floor(target x rows / experiment rows))); the top-up takes the rows first in
    hash order among those not yet taken. Rows without an experiment go.
    """
    df = df.where(F.col(experiment).isNotNull())
    found = ClassHashes(df, [experiment, label], key, seed)
    sizes: dict[object, int] = {}
    for name, n in found.sizes.items():
        sizes[found.values[name][0]] = sizes.get(found.values[name][0], 0) + n
    ordered = sorted(sizes.values())
    target = (ordered[(len(ordered) - 1) // 2] + ordered[len(ordered) // 2]) // 2 if ordered else 0
    wanted, have = {}, dict.fromkeys(sizes, 0)
    for name, n in found.sizes.items():
        own = found.values[name][0]
        wanted[name] = n if sizes[own] <= target else min(n, max(1, target * n // sizes[own]))
        have[own] += wanted[name]
    ends = found.ends(wanted)
    taken = found.condition(ends)
    # Among rows not taken the place in the experiment's hash order decides; what the taken ones leave is open.
    left = found.rows.where(~found.condition(ends, ["k0", "k1"], F.col("hash"))).select("k0", "hash")
    open_ = ClassHashes(df, [experiment], key, seed, left)
    more = open_.first({name: max(0, target - have[values[0]]) for name, values in open_.values.items()})
    return df.where(taken | more)


def smote(df: DataFrame, label: str, key: str, vector: str, k: int = 3, seed: int = 42, exact: bool = True) -> DataFrame:
    """(key, label, vector, synthetic): every class filled up to the largest with points between same-class neighbours.

    With ``exact=False`` neighbours come from the cells nearest to a row (see ``knn_join``).

    Copy j of a row uses a neighbour and a step that its key, j and the seed pick. A class of k rows or fewer is an
    error, as its neighbours would not exist.
    """
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one for each class
    small = [c for c, n in sizes.items() if n <= k]
    if small:
        raise ValueError(f"class {small[0]} has no {k} neighbours")
    hashes = ClassHashes(df, [label], key, seed)
    top = max(hashes.sizes.values(), default=0)
    whole = {name: (top - n) // n for name, n in hashes.sizes.items()}
    more = hashes.first({name: (top - n) % n for name, n in hashes.sizes.items()})
    copies = F.coalesce(hashes.pick(whole), F.lit(0)) + more.cast("int")
    base = df.select(key, label, vector)
    seeds = base.where(copies > 0).withColumn("__j", F.explode(F.sequence(F.lit(1), copies)))
    near = knn_join(df, df, k, key, vector, within=label, exact=exact).groupBy("a_key").agg(F.collect_list(F.struct("rank", "b_key")).alias("near"))
    u = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("__j"), F.lit(seed))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    pick = (F.conv(F.substring(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.col("__j"), F.lit(seed))), 9, 8), 16, 10).cast("long") % k).cast("int")
    chosen = seeds.join(near, F.col(key) == F.col("a_key")).withColumn("__b", F.element_at(F.sort_array("near"), pick + 1)["b_key"]).withColumn("__u", u)
    other = df.select(F.col(key).alias("__b"), F.col(vector).alias("__v"))
    made = chosen.join(other, "__b").select(F.concat_ws("-", F.lit("s"), F.col(key).cast("string"), "__j").alias(key), label, F.zip_with(vector, "__v", lambda x, y: x.cast("double") + F.col("__u") * (y.cast("double") - x.cast("double"))).alias(vector), F.lit(True).alias("synthetic"))
    return df.select(F.col(key).cast("string").alias(key), label, F.transform(vector, lambda x: x.cast("double")).alias(vector), F.lit(False).alias("synthetic")).unionByName(made)


def smote_enn(df: DataFrame, label: str, key: str, vector: str, k: int = 3, seed: int = 42, exact: bool = True) -> DataFrame:
    """SMOTE, then only rows all of whose k neighbours share their label."""
    filled = durable(smote(df, label, key, vector, k, seed, exact))  # read by the search, for the labels and for the result
    near = knn_join(filled, filled, k, key, vector, exact=exact)
    labels = filled.select(F.col(key).alias("b_key"), F.col(label).alias("b_label"))
    own = filled.select(F.col(key).alias("a_key"), F.col(label).alias("a_label"))
    agree = near.join(labels, "b_key").join(own, "a_key").groupBy("a_key").agg(F.bool_and(F.col("a_label") == F.col("b_label")).alias("agree"))
    return filled.join(agree.where("agree").select(F.col("a_key").alias(key)), key, "left_semi")
