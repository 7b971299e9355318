"""Neighbour search over pivots: cells round pivot points, bounds by the triangle inequality, work in blocks of cells.

Equal vectors are one point, so copies cost nothing. Pivots are cluster centres of a bounded sample of each group; every
point lies in the cell of its nearest pivot and keeps its distance to it. A query skips a cell when the ring of the
cell's distances, or the plane half-way between its own pivot and the cell's, is further away than what it looks for.
Inside a cell only the rows whose distance to the pivot fits are looked at, by a matrix product first, and only what may
be near enough by exact sums. Cells are put together into bundles, and a query goes once to each bundle that holds a cell
it has to look at, with the list of those; so where no cell can be skipped a vector is dealt once for a bundle, not for a
cell. Bundles with many rows or queries are split into blocks, and so are the lists of cells to visit.

All bounds are widened by a share of 1e-9, so rounding only costs comparisons: results are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainspark.functions.durable import durable

#: Points that pivots are fitted on (about), points that a cell is to hold, and the most pivots of a group.
SAMPLE, CELL_ROWS, MOST_PIVOTS = 2048, 64, 1024
#: A list of visits has queries x cells entries at worst: from FEW cells on, a cell more for so many points.
FEW, WIDE = 32, 8192
#: A vector is dealt once for each bundle it goes to: bundles of a group, so that there is work for all tasks, and the least rows of one.
BUNDLES, BUNDLE_ROWS = 16, 1024
#: Rows of a block (on either side), visits that a task makes at most (about), queries that share a window, and rows of one product.
BLOCK, DEALT, CHUNK, TILE = 1 << 16, 1 << 17, 512, 2048
#: Queries of a cell whose vectors are copied at a time, and distances that are summed to their end at a time.
COPIED, SUMMED = 8192, 1 << 14
#: Neighbours found that a task holds before only the nearest of each query are kept.
HELD = 1 << 18
WIDER = 1 + 1e-9


def points(df: DataFrame, key: str, vector: str, within: str | None = None) -> DataFrame:
    """(g, key, v, vid): rows that can have neighbours; ``vid`` names the vector, ``g`` the group and the vector's length.

    Rows with a null group, or a vector that is null, empty or not wholly finite, take no part.
    """
    group = F.col(within).cast("string") if within else F.lit("all")
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    rows = df.select(group.alias("g"), F.col(key).cast("string").alias("key"), v.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("g").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & good)
    return rows.select(F.concat_ws("/", "g", F.size("v").cast("string")).alias("g"), "key", "v", F.md5(F.concat_ws(",", F.transform("v", lambda x: x.cast("string")))).alias("vid"))


def distinct_points(rows: DataFrame, most: int) -> DataFrame:
    """(g, vid, v, keys): each different vector with its first ``most`` keys; tasks send on that many at most."""
    few = rows.withColumn("__r", F.row_number().over(Window.partitionBy("g", "vid").orderBy("key"))).where(F.col("__r") <= most)
    return few.groupBy("g", "vid").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("key")).alias("keys"))


def matrix(table: pa.Table, column: str) -> np.ndarray:
    if not table.num_rows:
        return np.zeros((0, 0))
    return np.concatenate([np.asarray(c.flatten(), float) for c in table[column].chunks]).reshape(table.num_rows, -1)


def numbers(table: pa.Table, column: str) -> np.ndarray:
    return table[column].to_numpy()


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All squared distances, coordinate by coordinate (no expansion of the square, which would cancel)."""
    out = np.zeros((len(x), len(y)))
    for c in range(x.shape[1]):
        out += (x[:, c, None] - y[None, :, c]) ** 2
    return out


def _centres(x: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    at = x[:count].copy()
    for _ in range(rounds if count > 1 else 0):
        own = np.concatenate([squared(x[k : k + 256], at).argmin(1) for k in range(0, len(x), 256)])
        for j in range(count):
            if (own == j).any():
                at[j] = x[own == j].mean(0)
    return at


def _facts(distinct: DataFrame) -> DataFrame:
    """(g, n, pivots) for each group of points."""
    sizes = distinct.groupBy("g").agg(F.count("*").alias("n"))
    edge = F.lit(float(1 << 40)) * SAMPLE / F.col("n")
    picked = distinct.select("g", "vid", "v").join(sizes, "g").where(F.pmod(F.xxhash64("vid"), F.lit(1 << 40)) < edge)

    def choose(table: pa.Table) -> pa.Table:
        table = table.sort_by("vid")
        n, x = table["n"][0].as_py(), matrix(table, "v")
        found = _centres(x, min(MOST_PIVOTS, -(-n // CELL_ROWS), FEW + n // WIDE, len(x)))
        return pa.table({"g": [table["g"][0].as_py()], "n": [n], "pivots": pa.array([found.tolist()], pa.list_(pa.list_(pa.float64())))})

    return picked.groupBy("g").applyInArrow(choose, "g string, n long, pivots array<array<double>>")


def _with_group(rows: DataFrame, facts: DataFrame, work, schema: str) -> DataFrame:
    """``work(rows, fact)`` on rows dealt into tasks of about DEALT rows x pivots, each beside its group's one row of ``facts``."""
    sizes = rows.groupBy("g").agg(F.count("*").alias("__rows"))
    slots = facts.join(sizes, "g").withColumn("slots", (1 + F.floor(F.col("__rows") * F.size("pivots") / DEALT)).cast("int")).drop("__rows")
    left = rows.join(slots.select("g", "slots"), "g").withColumn("slot", F.pmod(F.xxhash64("vid"), F.col("slots")).cast("int")).drop("slots")
    right = slots.withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        parts = [work(a.slice(at, 1024), b.slice(0, 1).to_pylist()[0]) for at in range(0, a.num_rows, 1024)] if b.num_rows else []
        out = pa.concat_tables(parts).select(names) if parts else None
        return out if out is not None else pa.table({c: [] for c in names}, schema=_arrow(schema))

    return left.groupBy("g", "slot").cogroup(right.groupBy("g", "slot")).applyInArrow(run, schema)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])


class PivotIndex:
    """``rows``: (g, cell, r, vid, v, ...) of all points; ``facts``: (g, n, pivots, cells) with a row for each group.

    A bundle is a run of cells, of about ``block`` points at most unless one cell has more.
    """

    def __init__(self, distinct: DataFrame, carry: str = "", block: int = BLOCK):
        self.block = block
        facts = durable(_facts(distinct))
        extra = [c.split()[0] for c in carry.split(", ")] if carry else []

        def place(rows: pa.Table, fact: dict) -> pa.Table:
            d2 = squared(matrix(rows, "v"), np.array(fact["pivots"]))
            cell = d2.argmin(1)
            made = {"cell": pa.array(cell.astype(np.int32)), "r": pa.array(np.sqrt(d2[np.arange(len(d2)), cell]))}
            return pa.table({"g": rows["g"], **made, "vid": rows["vid"], "v": rows["v"], **{c: rows[c] for c in extra}})

        self.carry = carry
        self.rows = durable(_with_group(distinct, facts, place, "g string, cell int, r double, vid string, v array<double>" + (f", {carry}" if carry else "")))
        cells = self.rows.groupBy("g", "cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi"))
        own = Window.partitionBy("g")  # 1,024 cells at most
        wide = F.least(F.lit(block), F.greatest(F.lit(BUNDLE_ROWS), F.ceil(F.sum("n").over(own) / BUNDLES)))
        before = F.sum("n").over(own.orderBy("cell")) - F.col("n")
        self.cells = durable(cells.withColumn("bundle", F.floor(before / wide).cast("int")))
        self.facts = durable(facts.join(self.cells.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("cell", "n", "lo", "hi", "bundle"))).alias("cells")), "g"))

    def errands(self, queries: DataFrame, which: str, wanted: int = 1, probe: float | None = None, carry: str = "") -> DataFrame:
        """(g, t2, vid, v, cells, r, bundles, starts, sizes): the cells that each query (g, vid, v, and t2 unless ``which`` is own) has to look at.

        ``own``: the nearest cell alone, with a bound t2 of the squared distance of the ``wanted``-th nearest point.
        ``rest``: all others that may hold a point within sqrt(t2). ``all``: both. With ``probe`` only the nearest cells
        that together hold that share of the group's points are looked at. ``r`` are distances to the cells' pivots;
        ``sizes`` cells from ``starts`` on lie in one of ``bundles``.
        """
        extra = [c.split()[0] for c in carry.split(", ")] if carry else []

        def choose(rows: pa.Table, fact: dict) -> pa.Table:
            pivots = np.array(fact["pivots"])
            at = np.array([c["cell"] for c in fact["cells"]])
            n, lo, hi, bundle = (np.array([c[f] for c in fact["cells"]]) for f in ("n", "lo", "hi", "bundle"))
            d = np.sqrt(squared(matrix(rows, "v"), pivots))[:, at]
            every = np.arange(len(d))
            own = d.argmin(1)
            if which == "own":
                order = np.argsort(d + hi, axis=1)
                held = np.cumsum(n[order], 1) >= wanted
                place = np.take_along_axis(order, held.argmax(1)[:, None], 1)[:, 0]
                t2 = np.where(held.any(1), ((d + hi)[every, place] * WIDER) ** 2, np.inf)
                i, j = every, own
            else:
                t2 = numbers(rows, "t2")
                gap = np.sqrt(squared(pivots[at], pivots[at]))
                with np.errstate(divide="ignore", invalid="ignore"):
                    plane = (d**2 - d[every, own][:, None] ** 2) / (2 * gap[own])
                plane[~np.isfinite(plane)] = 0.0
                bound = np.maximum(np.maximum(d - hi, lo - d), plane)
                open_ = bound <= np.sqrt(t2)[:, None] * WIDER + 1e-9 * d
                if which == "rest":
                    open_[every, own] = False
                if probe is not None:
                    order = np.argsort(d, axis=1, kind="stable")
                    before = np.cumsum(n[order], 1) - n[order]
                    near = np.zeros_like(open_)
                    np.put_along_axis(near, order, before < probe * n.sum(), 1)
                    open_ &= near
                i, j = np.nonzero(open_)
            some, first = np.unique(i, return_index=True)  # by query, and by bundle as cells are
            ends = np.append(first, len(i)).astype(np.int32)
            new = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (bundle[j[1:]] != bundle[j[:-1]]))[: len(i)])
            bounds = pa.array(np.append(np.searchsorted(i[new], some), len(new)).astype(np.int32))
            starts = new - first[np.searchsorted(some, i[new])]
            sizes = np.diff(np.append(new, len(i)))
            lists = {"cells": (ends, at[j].astype(np.int32)), "r": (ends, d[i, j]), **{c: (bounds, x.astype(np.int32)) for c, x in (("bundles", bundle[j[new]]), ("starts", starts), ("sizes", sizes))}}
            take = pa.array(some)
            made = {c: pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for c, (ends, x) in lists.items()}
            return pa.table({"g": rows["g"].take(take), "t2": pa.array(t2[some]), "vid": rows["vid"].take(take), "v": rows["v"].take(take), **made, **{c: rows[c].take(take) for c in extra}})

        return _with_group(queries, self.facts, choose, "g string, t2 double, vid string, v array<double>, cells array<int>, r array<double>, bundles array<int>, starts array<int>, sizes array<int>" + (f", {carry}" if carry else ""))

    def visits(self, queries: DataFrame, which: str, wanted: int = 1, probe: float | None = None) -> DataFrame:
        """(g, vid, t2, cell): ``errands`` with a row for each cell that a query has to look at."""
        return self.errands(queries, which, wanted, probe).select("g", "vid", "t2", F.explode("cells").alias("cell"))

    def search(self, errands: DataFrame, kernel, schema: str) -> DataFrame:
        """``kernel(queries, rows)`` on blocks of the queries that visit a bundle and of the bundle's rows, each pair of blocks once; store ``errands`` before."""
        count = lambda n: F.ceil(F.col(n) / self.block).cast("int")
        asked = errands.select("g", F.explode("bundles").alias("bundle")).groupBy("g", "bundle").agg(F.count("*").alias("asked"))
        bundles = self.cells.groupBy("g", "bundle").agg(F.sum("n").alias("n"))
        split = bundles.join(asked, ["g", "bundle"]).select("g", "bundle", count("n").alias("subs"), count("asked").alias("parts"))
        # Stored, so that its size says whether the rows have to be dealt by cell to meet it.
        split = durable(self.cells.select("g", "cell", "bundle").join(split, ["g", "bundle"]))
        each = errands.withColumn("__e", F.explode(F.arrays_zip("bundles", "starts", "sizes"))).drop("bundles", "starts", "sizes")
        each = each.withColumns({"bundle": F.col("__e.bundles"), **{c: F.slice(c, F.col("__e.starts") + 1, F.col("__e.sizes")) for c in ("cells", "r")}}).drop("__e")
        left = each.join(split.drop("cell").distinct(), ["g", "bundle"]).withColumn("part", F.pmod(F.xxhash64("vid"), F.col("parts")).cast("int")).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
        right = self.rows.join(split, ["g", "cell"]).withColumn("sub", F.pmod(F.xxhash64("vid"), F.col("subs")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        keys = ["g", "bundle", "sub", "part"]
        empty = pa.table({c.split()[0]: [] for c in schema.split(", ")}, schema=_arrow(schema))

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            return kernel(a, b) if a.num_rows and b.num_rows else empty

        return left.drop("subs", "parts").groupBy(*keys).cogroup(right.drop("subs", "parts").groupBy(*keys)).applyInArrow(run, schema)


def meetings(a: pa.Table, b: pa.Table, t2: np.ndarray, wanted: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (query, row, squared distance) of ``close_pairs`` for each cell of a block's rows and the block's queries that visit it.

    ``t2`` may be lowered between two pairs of arrays; the next cell, or the next of its queries, are looked at with what it is then.
    """
    q, x, b_r, cell = matrix(a, "v"), matrix(b, "v"), numbers(b, "r"), numbers(b, "cell")
    who = np.repeat(np.arange(a.num_rows), pc.list_value_length(a["cells"]).to_numpy())
    to, far = (pc.list_flatten(a[c]).to_numpy() for c in ("cells", "r"))
    order, rows = np.lexsort((far, to)), np.argsort(cell, kind="stable")
    to, cell = to[order], cell[rows]
    for c in np.unique(cell):
        own = rows[np.searchsorted(cell, c) : np.searchsorted(cell, c, side="right")]
        at = order[np.searchsorted(to, c) : np.searchsorted(to, c, side="right")]
        for part in range(0, len(at), COPIED):
            i = who[at[part : part + COPIED]]
            for one, two, d2 in close_pairs(q[i], far[at[part : part + COPIED]], t2[i], x[own], b_r[own], wanted):
                yield i[one], own[two], d2


def _products(q: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Single-precision factors whose product gives squared distances times a unit, the squared lengths they err by a share of, and the unit.

    Vectors are taken from the rows' mean, which costs no digit of a difference, and scaled so that none is longer than one.
    """
    q, b = (x - b.mean(0) for x in (q, b))
    q_n, b_n = np.einsum("ij,ij->i", q, q), np.einsum("ij,ij->i", b, b)
    top = max(q_n.max(), b_n.max())
    scale = float(np.ldexp(1.0, -int(np.frexp(np.sqrt(top))[1]))) if np.isfinite(top) else np.nan  # nothing is known of what overflows
    q, b, q_n, b_n = q * scale, b * scale, q_n * scale * scale, b_n * scale * scale
    one, two = np.column_stack([-2 * q, q_n, np.ones(len(q))]), np.column_stack([b, np.ones(len(b)), b_n])
    return one.astype(np.float32), two.astype(np.float32), q_n, b_n, scale * scale


def close_pairs(q: np.ndarray, q_r: np.ndarray, t2: np.ndarray, b: np.ndarray, b_r: np.ndarray, wanted: int | None = None):
    """Yield (query, row, squared distance) of all pairs with a squared distance up to the query's ``t2``.

    With ``wanted`` only pairs up to the query's ``wanted``-th distance among the rows of its window are needed.
    ``q_r`` and ``b_r`` are distances to one pivot. A matrix product gives each distance but for rounding; those that
    may be near enough are summed in the order of the coordinates, so a yielded pair is a distance computed to its end.
    """
    order_q, order_b = np.argsort(q_r, kind="stable"), np.argsort(b_r, kind="stable")
    ring, reach = b_r[order_b], np.sqrt(t2) * WIDER + 1e-9 * q_r
    qt, bt = np.ascontiguousarray(q.T), np.ascontiguousarray(b.T)
    with np.errstate(over="ignore", invalid="ignore", under="ignore"):
        left, right, q_n, b_n, unit = _products(q[order_q], b[order_b])
        # Rounding of a product of d + 2 terms and of its factors is below (d + 5) eps (|q|^2 + |b|^2); twice that is allowed for, and underflow.
        slack = 2 * (q.shape[1] + 8) * float(np.finfo(np.float32).eps) * (q_n + b_n.max()) + 1e-30
        limit = t2[order_q] * unit + slack
    most_pairs = min(CHUNK, len(q)) * min(TILE, len(b))
    products, marks = np.empty(most_pairs, np.float32), np.empty(most_pairs + 8, bool)
    for at in range(0, len(q), CHUNK):
        i, most = order_q[at : at + CHUNK], limit[at : at + CHUNK]
        first, last = np.searchsorted(ring, (q_r[i] - reach[i]).min()), np.searchsorted(ring, (q_r[i] + reach[i]).max(), side="right")
        for start in range(first, last, TILE):
            stop = min(start + TILE, last)
            with np.errstate(over="ignore", invalid="ignore"):
                shape, size = (len(i), stop - start), len(i) * (stop - start)
                low = np.matmul(left[at : at + CHUNK], right[start:stop].T, out=products[:size].reshape(shape))
                open_ = _open(low, most, marks[:size].reshape(shape))
                if wanted is not None and wanted <= stop - start and np.count_nonzero(open_) > 8 * wanted * len(i):
                    kth = np.partition(low, wanted - 1, axis=1)[:, wanted - 1]
                    most = np.fmin(most, kth + 2 * slack[at : at + CHUNK])
                    open_ = _open(low, most, open_)
            marks[size : size + 8] = False
            eights = np.flatnonzero(marks[: -(-size // 8) * 8].view(np.uint64))  # few of many: looked for eight at a time
            x, y = np.nonzero(marks[: -(-size // 8) * 8].reshape(-1, 8)[eights])
            found = eights[x] * 8 + y
            for part in range(0, len(found), SUMMED):
                x, y = np.divmod(found[part : part + SUMMED], stop - start)
                one, two = i[x], order_b[start + y]
                with np.errstate(over="ignore"):
                    terms = (qt.take(one, axis=1) - bt.take(two, axis=1)) ** 2
                    d = terms[0].copy()
                    for term in terms[1:]:
                        d += term
                alive = d <= t2[one]
                yield one[alive], two[alive], d[alive]


def _open(low: np.ndarray, most: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Where a product may be up to ``most``; what has overflowed may be anything."""
    np.greater(low, np.nextafter(most.astype(np.float32), np.float32(np.inf))[:, None], out=out)
    return np.logical_not(out, out=out)


_FOUND = "g string, vid string, d2 double, keys array<string>, compared long"


def nearest(index: PivotIndex, queries: DataFrame, wanted: int, probe: float | None = None) -> DataFrame:
    """(g, vid, d2, keys, compared): of each query the ``wanted`` nearest points at least, and rows without keys that count distances.

    A query first looks at its own cell, then at the cells that the distance of its ``wanted``-th neighbour there leaves.
    """

    def kernel(a: pa.Table, b: pa.Table) -> pa.Table:
        b = b.take(pa.array(np.argsort(np.array([k[0] for k in b["keys"].to_pylist()], object), kind="stable")))
        t2, held, size, compared = numbers(a, "t2").copy(), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0, 0

        def reduce() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            i, j, d = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((j, d, i))  # rows are in the order of their first key
            i, j, d = i[order], j[order], d[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            last = place == wanted - 1
            t2[i[last]] = np.minimum(t2[i[last]], d[last])
            return i[place < wanted], j[place < wanted], d[place < wanted]

        for i, j, d in meetings(a, b, t2, wanted):
            compared += len(d)
            held.append((i, j, d))
            size += len(d)
            if size > HELD:
                held, size = [reduce()], 0
        i, j, d2 = reduce()
        rows = pa.table({"g": a["g"].take(pa.array(i)), "vid": a["vid"].take(pa.array(i)), "d2": pa.array(d2), "keys": b["keys"].take(pa.array(j)), "compared": pa.array(np.zeros(len(i), np.int64))}, schema=_arrow(_FOUND))
        return pa.concat_tables([rows, pa.table({"g": [a["g"][0].as_py()], "vid": [None], "d2": [None], "keys": [None], "compared": [compared]}, schema=_arrow(_FOUND))])

    near = durable(index.search(durable(index.errands(queries, "own", wanted)), kernel, _FOUND))
    # The bound of the own cell's visit holds too, but a query with so many points in its cell knows better.
    kth = near.where("keys IS NOT NULL").groupBy("g", "vid").agg(F.sort_array(F.collect_list("d2")).alias("d")).select("g", "vid", F.get("d", F.lit(wanted - 1)).alias("t2"))
    again = queries.join(kth.where("t2 IS NOT NULL"), ["g", "vid"], "left").select("g", "vid", "v", F.coalesce("t2", F.lit(float("inf"))).alias("t2"))
    far = index.search(durable(index.errands(again, "rest", wanted, probe)), kernel, _FOUND)
    return near.union(far)

