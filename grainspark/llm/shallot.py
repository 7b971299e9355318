"""Exact k-means on integer vectors by Shallot search.

Every vector remembers its nearest and second-nearest centroid with an upper bound of the distance to the first and a
lower bound of the distance to all others. When centroids have moved, the bounds move with them; a vector whose upper
bound is below its lower one keeps its centroid unseen. Otherwise the scan starts from the closer of the two remembered
centroids and goes through that centroid's neighbours in order of distance. It ends as soon as the next neighbour is
further away than the vector's distance to the start plus that to the second nearest found so far, a ball that shrinks
with every better find. Survivors are compared by exact integer distances, ties by the smaller number, so rounding only
ever costs a comparison.

A round is a narrow pass over a stored table of integer vectors and bounds, and one aggregation with a row for each
task and centroid; the driver holds k centroids.

Edge cases: vectors with another number of components, or with a null or non-finite one, are not kept; vectors with a
component beyond ``limit(dims)`` (2^27 of the scaled integers for 64 components), whose distances do not fit into a
long, are kept with null results and take no part; rows that repeat an id, and null ids (their hash comes last), are
vectors like any other; with fewer than k vectors each is a centroid; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from grainspark.functions.durable import durable, release
from grainspark.llm.common import fresh, named

#: Share by which bounds are widened, so that rounding never hides a centroid.
SLACK = 1e-9


def limit(dims: int) -> int:
    """The greatest component for which every squared distance of ``dims`` components stays below 2^62."""
    return min(math.isqrt((1 << 62) // max(1, dims)) // 2, (1 << 31) - 1)


class Centroids:
    """Integer centroids with each one's neighbours in order of distance, and how far each has moved."""

    def __init__(self, at: np.ndarray, before: np.ndarray | None = None):
        self.at = at.astype(np.int64)
        gap = np.sqrt(((self.at[:, None] - self.at[None]) ** 2).sum(2).astype(float))
        self.order = np.argsort(gap, axis=1, kind="stable")
        self.near = np.take_along_axis(gap, self.order, 1)
        moved = np.zeros(len(at)) if before is None else np.sqrt(((self.at - before) ** 2).sum(1).astype(float))
        self.moved = moved * (1 + SLACK)
        most = np.argsort(moved)[::-1]
        self.others = np.full(len(at), self.moved[most[0]] if len(at) else 0.0)  # the greatest move of all but this one
        if len(at):
            self.others[most[0]] = self.moved[most[1]] if len(at) > 1 else 0.0

    def squared(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        return ((x - self.at[which]) ** 2).sum(1)


def first_bounds(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, ...]:
    """(nearest, second, upper, lower) without any bound to start from: all centroids are compared."""
    n, k = len(x), len(centroids.at)
    d = np.stack([centroids.squared(x, np.full(n, j)) for j in range(k)], 1) if k else np.zeros((n, 0), np.int64)
    first = d.argmin(1)
    rows = np.arange(n)
    upper = np.sqrt(d[rows, first].astype(float)) * (1 + SLACK)
    if k == 1:
        return first, first.copy(), upper, np.full(n, np.inf)
    d[rows, first] = np.iinfo(np.int64).max
    second = d.argmin(1)
    return first, second, upper, np.sqrt(d[rows, second].astype(float)) * (1 - SLACK)


def search(x: np.ndarray, first: np.ndarray, second: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """(nearest, second, upper, lower, distances computed) after the centroids have moved."""
    first, second = first.copy(), second.copy()
    upper = (upper + centroids.moved[first]) * (1 + SLACK)
    lower = np.maximum(lower - centroids.others[first], 0.0) * (1 - SLACK)
    if len(centroids.at) < 2:
        return first, second, upper, lower, 0
    todo = np.flatnonzero(~(upper < lower))
    d1 = centroids.squared(x[todo], first[todo])
    upper[todo] = np.sqrt(d1.astype(float)) * (1 + SLACK)
    open_ = ~(upper[todo] < lower[todo])
    compared, todo, d1 = len(todo), todo[open_], d1[open_]
    if not len(todo):
        return first, second, upper, lower, compared
    x, one, two = x[todo], first[todo], second[todo]
    d2 = centroids.squared(x, two)
    compared += len(todo)
    swap = (d2 < d1) | ((d2 == d1) & (two < one))
    one, two = np.where(swap, two, one), np.where(swap, one, two)
    d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
    start, a, b = one.copy(), one.copy(), two.copy()
    reach = np.sqrt(d1.astype(float))
    live = np.arange(len(todo))
    for place in range(len(centroids.at)):
        ball = (reach[live] + np.sqrt(d2[live].astype(float))) * (1 + SLACK)
        live = live[centroids.near[start[live], place] <= ball]
        if not len(live):
            break
        which = centroids.order[start[live], place]
        new = (which != a[live]) & (which != b[live])
        rows, which = live[new], which[new]
        d = centroids.squared(x[rows], which)
        compared += len(rows)
        best = (d < d1[rows]) | ((d == d1[rows]) & (which < one[rows]))
        runner = ~best & ((d < d2[rows]) | ((d == d2[rows]) & (which < two[rows])))
        r = rows[best]
        d2[r], two[r] = d1[r], one[r]
        d1[r], one[r] = d[best], which[best]
        r = rows[runner]
        d2[r], two[r] = d[runner], which[runner]
    first[todo], second[todo] = one, two
    upper[todo], lower[todo] = np.sqrt(d1.astype(float)) * (1 + SLACK), np.sqrt(d2.astype(float)) * (1 - SLACK)
    return first, second, upper, lower, compared


def quantised(vector: Column, dims: int, scale: int) -> Column:
    """floor(scale * x) of each component; null if the vector is not kept; an empty array if a component is beyond the limit."""
    good = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    small = F.forall(vector, lambda x: F.abs(x.cast("double")) * scale < limit(dims))
    return F.when(good & small, F.transform(whole, lambda x: x.try_cast("int"))).when(good, F.array().cast("array<int>"))


_STATE = "first int, second int, upper double, lower double, distance long"


def _pass(table: DataFrame, keep: list[str], centroids: Centroids) -> DataFrame:
    """One assignment; ``table`` has the kept columns, ``v``, and the bounds of the pass before if there was one."""
    n, known = len(keep), len(table.columns) > len(keep) + 1
    out = T.StructType(table.schema.fields[: n + 1] + T._parse_datatype_string(_STATE).fields)
    arrow = to_arrow_schema(out)
    dims = centroids.at.shape[1]

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(n).flatten()).astype(np.int64).reshape(-1, dims)
            if known:
                state = search(x, *(np.asarray(batch.column(n + 1 + j)) for j in range(4)), centroids)[:4]
            else:
                state = first_bounds(x, centroids)
            state = (*state, centroids.squared(x, state[0]))
            kept = [batch.column(j) for j in range(n + 1)]
            made = [pa.array(s, f.type) for s, f in zip(state, list(arrow)[n + 1 :], strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *made], schema=pa.schema([pa.field(f.name, a.type) for f, a in zip(arrow, [*kept, *made], strict=True)]))

    return table.mapInArrow(run, out)


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", k: int = 16, dims: int = 64, scale: int = 64, rounds: int = 3, seed: str = "1", carry: tuple[str, ...] = ()) -> DataFrame:
    """Each kept vector's id, ``carry`` columns, ``cluster``, ``distance`` (squared, of integers), ``cluster_inertia``, ``inertia`` and ``centroid`` (array).

    Centroids start as the k vectors of least sha256 of ``seed:id``, in that order. Each of ``rounds`` rounds assigns
    all vectors and moves every non-empty centroid to the floor of its vectors' means; a last assignment follows.
    """
    spark = vectors.sparkSession
    keep = list(dict.fromkeys((id_col, *carry)))
    (v,) = fresh(keep, "v")
    kept = vectors.select(*(named(c) for c in keep), quantised(named(vector), dims, scale).alias(v)).where(named(v).isNotNull())
    rank = F.sha2(F.concat(F.lit(f"{seed}:"), named(id_col).cast("string")), 256)
    inside = kept.where(F.size(v) == dims)
    chosen = inside.select(v).orderBy(F.asc_nulls_last(rank), named(v)).limit(k).collect()
    at = np.array([r[0] for r in chosen], np.int64).reshape(-1, dims)
    sums = [F.sum(F.get(named(v), F.lit(j)).cast("long")) for j in range(dims)]
    before, table = None, inside
    for _ in range(rounds if len(at) else 0):
        last, table = table, durable(_pass(table, keep, Centroids(at, before)))
        release(*([last] if last is not inside else []))
        before, moved = at, at.copy()
        for r in table.groupBy("first").agg(F.count("*").alias("n"), *(s.alias(f"s{j}") for j, s in enumerate(sums))).collect():  # k rows
            moved[r["first"]] = [r[f"s{j}"] // r["n"] for j in range(dims)]
        at = moved
    last, table = table, durable(_pass(table, keep, Centroids(at, before)))
    release(*([last] if last is not inside else []))
    cost = {r["first"]: int(r["d"]) for r in table.groupBy("first").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}  # k rows
    fits = lambda x: x if x < 1 << 63 else None  # noqa: E731  a sum beyond a long is null
    rows = [(j, fits(d), fits(sum(cost.values())), at[j].tolist()) for j, d in sorted(cost.items())]
    facts = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    new = ["cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    result = table.select(*(named(c) for c in keep if c not in new), F.col("first").alias("cluster"), "distance").join(F.broadcast(facts), "cluster")  # k rows
    outside = kept.where(F.size(v) != dims).select(*(named(c) for c in keep if c not in new), *(F.lit(None).cast(kind).alias(c) for c, kind in zip(new, ("int", "long", "long", "long", "array<long>"), strict=True)))
    order = [*(c for c in keep if c not in new), *new]
    return result.select(*(named(c) for c in order)).union(outside.select(*(named(c) for c in order)))


def digest(centroid: Column) -> Column:
    """Hex sha256 of a centroid's components as decimal integers joined by commas."""
    return F.sha2(F.array_join(F.transform(centroid, lambda x: x.cast("string")), ","), 256)
