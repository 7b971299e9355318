"""Density clustering for many values of eps at once, without a table of pairs.

A level is the place of a value in the ascending list of eps. One pass over the blocks of the pivot index counts each
point's neighbours by level, which gives the level from which it is a core. A second pass gives every core-to-core pair
the level from which it links (the greatest of its distance's and both cores' levels); each block keeps a spanning
forest of its links by level, which connects the same points at each level, and for each other point its nearest core
by level. So a block of q queries and m rows sends on q + m rows at most for each level, whatever the number of pairs.
Forests are contracted level by level; the clusters of every eps are read from the one result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainspark.functions.durable import durable, release
from grainspark.operators import pivots
from grainspark.operators.graph import components, merge_level

#: Links that one task contracts for all levels; with more of them each level is contracted by joins.
ONE_TASK = 1 << 20
#: Links of a block that are held before they are reduced to their forest.
HELD = 1 << 20


def forest(u: np.ndarray, v: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (u, v, level) that connect the same nodes at every level, one fewer than there are nodes at most."""
    nodes, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = both[: len(u)], both[len(u) :]
    root, out = np.arange(len(nodes)), []
    for k in np.unique(level):
        own = level == k
        new = merge_level(len(nodes), root[u[own]], root[v[own]])
        moved = np.flatnonzero((root == np.arange(len(nodes))) & (new != np.arange(len(nodes))))
        out.append((nodes[moved], nodes[new[moved]], np.full(len(moved), k)))
        root = new[root]
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if out else empty for x in zip(*(out or [(empty,) * 3]), strict=True))


class Density:
    """The clusters of ``df``'s rows for each of ``eps_values``; see ``dbscan`` for what they are.

    Rows whose vectors are null, empty or not finite are noise and no neighbours; equal vectors count each.
    """

    def __init__(self, df: DataFrame, key: str, vector: str, eps_values: list[float], min_points: int):
        self.df, self.key, self.vector = df, key, vector
        self.eps = sorted(set(eps_values))
        steps, levels = np.array(self.eps), len(self.eps)
        self.rows = pivots.points(df, key, vector)
        self.points = durable(self.rows.groupBy("g", "vid").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("key").alias("first")))
        index = pivots.PivotIndex(self.points, "n long, first string")
        far = F.lit((self.eps[-1] * pivots.WIDER) ** 2)

        def by_level(a: pa.Table, b: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
            """(query, row, squared distance, level) of pairs within the greatest eps."""
            for i, j, d2 in pivots.meetings(a, b, pivots.numbers(a, "t2")):
                level = np.searchsorted(steps, np.sqrt(d2))
                near = level < levels
                yield i[near], j[near], d2[near], level[near]

        def count(a: pa.Table, b: pa.Table) -> pa.Table:
            n, total = pivots.numbers(b, "n"), np.zeros((a.num_rows, levels), np.int64)
            for i, j, _, level in by_level(a, b):
                np.add.at(total, (i, level), n[j])
            return pa.table({"g": a["g"], "vid": a["vid"], "counts": pa.array(total.tolist(), pa.list_(pa.int64()))})

        queries = self.points.select("g", "vid", "v", "first", far.alias("t2"))
        asking = durable(index.errands(queries, "all"))
        counted = index.search(asking, count, "g string, vid string, counts array<long>").groupBy("g", "vid").agg(F.array(*(F.sum(F.get("counts", F.lit(k))) for k in range(levels))).alias("counts"))
        self.counts = durable(counted)
        so_far = F.transform("counts", lambda x, k: F.aggregate(F.slice("counts", 1, k + 1), F.lit(0).cast("long"), lambda s, c: s + c) >= min_points)
        place = F.array_position(so_far, True)
        cores = self.counts.select("g", "vid", F.when(place > 0, place - 1).otherwise(levels).cast("int").alias("core"))
        self.cores = durable(cores)
        index.rows = durable(index.rows.join(self.cores, ["g", "vid"]))
        linking = durable(asking.join(queries.select("g", "vid", "first").join(self.cores, ["g", "vid"]), ["g", "vid"]))
        kinds = "u string, v string, level int, d2 double, link boolean"

        def link(a: pa.Table, b: pa.Table) -> pa.Table:
            core_a, core_b = pivots.numbers(a, "core"), pivots.numbers(b, "core")
            name_a, name_b = (np.array(t["first"].to_pylist(), object) for t in (a, b))
            held, size, borders = [], 0, []
            rank_b = np.argsort(np.argsort(name_b, kind="stable"), kind="stable")

            def reduce() -> list:
                u, v, k = (np.concatenate(x) for x in zip(*held, strict=True))
                return [forest(u, v, k)]

            for i, j, d2, level in by_level(a, b):
                own = np.maximum(np.maximum(level, core_b[j]), core_a[i])
                linked = (own < levels) & (name_a[i] < name_b[j])
                held.append((i[linked], j[linked] + a.num_rows, own[linked]))
                size += int(linked.sum())
                if size > HELD:
                    held = reduce()
                    size = len(held[0][0])
                level = np.maximum(level, core_b[j])
                open_ = (level < levels) & (level < core_a[i])
                i, j, d2, level = i[open_], j[open_], d2[open_], level[open_]
                order = np.lexsort((rank_b[j], d2, level, i))
                i, j, d2, level = i[order], j[order], d2[order], level[order]
                new = np.ones(len(i), bool)
                new[1:] = (i[1:] != i[:-1]) | (level[1:] != level[:-1])
                borders.append((i[new], j[new], level[new], d2[new]))
            u, v, k = reduce()[0] if held else (np.zeros(0, np.int64),) * 3
            names = np.concatenate([name_a, name_b])
            i, j, level, d2 = (np.concatenate(x) for x in zip(*borders, strict=True)) if borders else (np.zeros(0, np.int64),) * 4
            return pa.table(
                {
                    "u": pa.array([*names[u.astype(np.int64)], *name_a[i.astype(np.int64)]], pa.string()),
                    "v": pa.array([*names[v.astype(np.int64)], *name_b[j.astype(np.int64)]], pa.string()),
                    "level": pa.array(np.concatenate([k, level]).astype(np.int32)),
                    "d2": pa.array(np.concatenate([np.zeros(len(k)), d2]).astype(float)),
                    "link": pa.array(np.arange(len(k) + len(i)) < len(k)),
                }
            )

        self.found = durable(index.search(linking, link, kinds))
        borders = self.found.where("NOT link").groupBy("u", "level").agg(F.min(F.struct("d2", "v")).alias("near"))
        self.borders = durable(borders.groupBy("u").agg(F.collect_list(F.struct("level", "near")).alias("near")))
        names = self.points.join(self.cores, ["g", "vid"]).select("g", "vid", "n", "first", "core")
        self.names = durable(names.join(self.borders.withColumnRenamed("u", "first"), "first", "left"))
        self.labels = durable(self._labels())
        release(asking, linking, self.counts)

    def _labels(self) -> DataFrame:
        """(node, level, label): for each level with a link, the least core of each core's component, where it is not the core itself."""
        links = self.found.where("link").select("u", "v", "level").distinct()
        levels = len(self.eps)
        schema = "node string, level int, label string"
        if links.count() <= ONE_TASK:

            def contract(table: pa.Table) -> pa.Table:
                names, both = np.unique(np.array([*table["u"].to_pylist(), *table["v"].to_pylist()], object), return_inverse=True)
                u, v, level = both[: table.num_rows], both[table.num_rows :], pivots.numbers(table, "level")
                root, out = np.arange(len(names)), []
                for k in range(levels):
                    own = level == k
                    if own.any():
                        root = merge_level(len(names), root[u[own]], root[v[own]])[root]
                    moved = np.flatnonzero(root != np.arange(len(names)))
                    out.append(pa.table({"node": pa.array(names[moved], pa.string()), "level": pa.array(np.full(len(moved), k, np.int32)), "label": pa.array(names[root[moved]], pa.string())}))
                return pa.concat_tables(out)

            return links.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(contract, schema)
        out, now = None, None  # now: (node, label) of the level before
        for k in range(levels):
            own = links.where(F.col("level") == k).select("u", "v")
            if now is not None:
                for side in ("u", "v"):
                    own = own.join(now.select(F.col("node").alias(side), F.col("label").alias("__l")), side, "left").withColumn(side, F.coalesce("__l", side)).drop("__l")
            roots = components(own)
            least = roots.groupBy("root").agg(F.min("node").alias("label"))
            step = roots.join(least, "root").where("node <> label").select("node", "label")
            if now is not None:
                carried = now.join(step.select(F.col("node").alias("label"), F.col("label").alias("__l")), "label", "left").select("node", F.coalesce("__l", "label").alias("label"))
                step = carried.union(step)
            now = durable(step)
            each = now.select("node", F.lit(k).alias("level"), "label")
            out = each if out is None else out.union(each)
        return out

    def noise(self) -> list[int]:
        """Rows that are noise at each level, rows without a usable vector included."""
        reach = F.least("core", F.coalesce(F.array_min(F.transform("near", lambda x: x["level"])), F.lit(len(self.eps))))
        row = self.names.agg(F.sum("n").alias("all"), *(F.sum(F.when(reach <= k, F.col("n")).otherwise(0)).alias(f"k{k}") for k in range(len(self.eps)))).first()
        rows = self.df.count()
        return [rows - (row[f"k{k}"] or 0) for k in range(len(self.eps))]

    def _at(self, level: int) -> DataFrame:
        """(vid, core, cluster) of the points at a level."""
        near = F.array_min(F.transform(F.filter("near", lambda x: x["level"] <= level), lambda x: x["near"]))["v"]
        core = F.col("core") <= level
        marked = self.names.select("g", "vid", core.alias("core"), F.when(core, F.col("first")).otherwise(near).alias("node"))
        return marked.join(self.labels.where(F.col("level") == level).drop("level"), "node", "left").select("g", "vid", "core", F.coalesce("label", "node").alias("cluster"))

    def clusters(self, eps: float) -> DataFrame:
        """(key, core, cluster) of all rows for one of the values of eps."""
        level = self.eps.index(eps)
        placed = self.rows.join(self._at(level), ["g", "vid"]).select(F.col("key").alias("__key"), F.col("core").alias("__core"), "cluster")
        kind = self.df.schema[self.key].dataType
        out = self.df.select(self.key).join(placed, F.col(self.key).cast("string") == F.col("__key"), "left")
        return out.select(self.key, F.coalesce("__core", F.lit(False)).alias("core"), F.col("cluster").cast(kind).alias("cluster"))

    def scores(self) -> dict[float, float]:
        """eps -> simplified silhouette, for values without noise and with more than one cluster."""
        found: dict[float, float] = {}
        linked = {r["level"] for r in self.found.select("level").distinct().collect()}  # a level at most for each eps
        before = None
        vectors = self.rows.select("g", "vid", array_to_vector("v").alias("features"))
        for k, noise in enumerate(self.noise()):
            if noise:
                continue
            if before is not None and k not in linked:  # nothing changes at this level
                if before in found:
                    found[self.eps[k]] = found[before]
                before = self.eps[k]
                continue
            before = self.eps[k]
            at = durable(self._at(k))
            names = at.select("cluster").distinct()
            if names.limit(2).count() == 2:
                numbered = at.join(names.withColumn("prediction", F.monotonically_increasing_id().cast("double")).transform(durable), "cluster")
                score = ClusteringEvaluator().evaluate(vectors.join(numbered.select("g", "vid", "prediction"), ["g", "vid"]))
                found[self.eps[k]] = round(score, 9)  # equal clusters have equal scores, whatever the order of sums
        return found


def dbscan(df: DataFrame, key: str, vector: str, eps: float, min_points: int) -> DataFrame:
    """(key, core, cluster): cores have min_points rows within eps, themselves included; clusters are named by their least core.

    A border row joins the cluster of its nearest core (ties: the least key); others are noise, cluster null. Keys are
    ordered as text.
    """
    return Density(df, key, vector, [eps], min_points).clusters(eps)


def dbscan_search(df: DataFrame, key: str, vector: str, eps_values: list[float] | None = None, min_points: int | None = None, default: float = 0.5) -> tuple[DataFrame, float, dict[float, float]]:
    """(result as of ``dbscan``, eps, scores): the eps of greatest silhouette among those without noise and with several clusters.

    Defaults: 20 values from 0.1 to 2, at least a twentieth of the rows (two at least) for a core. The silhouette is the
    simplified one (squared distances to cluster means). Without a valid eps it is ``default``.
    """
    eps_values = eps_values or [round(0.1 + 0.1 * k, 10) for k in range(20)]
    min_points = min_points or max(2, df.count() // 20)
    every = Density(df, key, vector, [*eps_values, default], min_points)
    scores = {e: s for e, s in every.scores().items() if e in eps_values}
    best = max(scores, key=lambda e: (scores[e], -e), default=default)
    return every.clusters(best), best, scores
