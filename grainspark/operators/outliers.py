"""Outlier scores, uncertainty and adjusted confidence. Statistics are fitted on training rows and applied to others."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainspark.operators.neighbours import knn_join
from grainspark.operators.quantiles import quantiles
from grainspark.operators.stats import profile, unpivot


def chi2_quantile(p: float, d: int) -> float:
    """By bisection of the regularised lower gamma function (its power series)."""

    def below(x: float) -> float:
        a, h = d / 2, x / 2
        term = total = 1 / a
        k = a
        while term > total * 1e-15:
            k += 1
            term *= h / k
            total += term
        return total * math.exp(a * math.log(h) - h - math.lgamma(a)) if h else 0.0

    low, high = 0.0, d + 40 * math.sqrt(2 * d) + 40
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return (low + high) / 2


def mean_and_covariance(df: DataFrame, cols: list[str], ridge: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Means and sample covariance plus ``ridge`` on the diagonal: d x d numbers from one aggregation."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    row = df.agg(*(F.avg(c) for c in cols), *(F.covar_samp(cols[i], cols[j]) for i, j in pairs)).first()
    cov = np.zeros((len(cols), len(cols)))
    for (i, j), v in zip(pairs, row[len(cols) :], strict=True):
        cov[i, j] = cov[j, i] = v
    return np.array(row[: len(cols)], float), cov + ridge * np.eye(len(cols))


def squared_mahalanobis(cols: list[str], mean: np.ndarray, inverse: np.ndarray) -> Column:
    x = [F.col(c) - float(m) for c, m in zip(cols, mean, strict=True)]
    total = F.lit(0.0)
    for i in range(len(cols)):
        total = total + x[i] * sum((x[j] * float(inverse[i, j]) for j in range(1, len(cols))), x[0] * float(inverse[i, 0]))
    return total


def mahalanobis(train: DataFrame, test: DataFrame, cols: list[str], contamination: float = 0.1, compat: bool = False) -> DataFrame:
    """Add ``mahalanobis`` and ``mahalanobis_outlier``: the squared distance against the chi-square quantile (``compat``: the distance itself)."""
    mean, cov = mean_and_covariance(train, cols)
    d2 = squared_mahalanobis(cols, mean, np.linalg.inv(cov))
    limit = chi2_quantile(1 - contamination, len(cols))
    out = test.withColumn("mahalanobis", F.sqrt(d2))
    return out.withColumn("mahalanobis_outlier", (F.col("mahalanobis") if compat else F.col("mahalanobis") * F.col("mahalanobis")) > limit)


def range_outliers(train: DataFrame, test: DataFrame, cols: list[str]) -> DataFrame:
    """Shares of values of each feature outside the training extremes and quantiles, or beyond 2 and 3 deviations."""
    stats = F.broadcast(profile(train, cols).withColumnRenamed("feature", "f"))
    v = F.col("value")
    z = F.try_divide(v - F.col("mean"), F.col("std"))
    flags = {"outside_range": (v < F.col("min")) | (v > F.col("max")), "outside_01_99": (v < F.col("q01")) | (v > F.col("q99")), "outside_05_95": (v < F.col("q05")) | (v > F.col("q95")), "beyond_2_sd": F.coalesce(F.abs(z) > 2, F.lit(False)), "beyond_3_sd": F.coalesce(F.abs(z) > 3, F.lit(False))}
    long = unpivot(test, [], cols).where("value IS NOT NULL").join(stats, F.col("feature") == F.col("f"))
    return long.groupBy("feature").agg(*(F.avg(c.cast("double")).alias(n) for n, c in flags.items()))


def _path_norm(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def _tree_hashes(h: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """rows x trees numbers, one random order of the rows for each tree."""
    with np.errstate(over="ignore"):
        x = h.view(np.uint64)[:, None] ^ (np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))[None]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(1)


def tree_samples(train: DataFrame, cols: list[str], key: str, trees: int, psi: int, seed: int = 42) -> DataFrame:
    """(tree, k, cols): for each tree the ``psi`` complete rows that come first in an order of its own.

    One pass: a task keeps the psi least hashes of each tree and sends on those rows alone, so what is shuffled is
    trees x psi rows a task, whatever the table. Rows with a null key have no place in the order and are not sampled.
    """
    base = train.select(F.col(key).cast("string").alias("k"), *(F.col(c).cast("double").alias(c) for c in cols)).dropna()
    rows = base.select(F.xxhash64("k", F.lit(seed)).alias("__h"), "k", *cols)
    schema = "tree int, place long, k string, " + ", ".join(f"`{c}` double" for c in cols)

    def keep(batches):
        held, place, tree = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)  # rows, and what has them by tree
        most = np.full(trees, np.iinfo(np.uint64).max)
        for batch in batches:
            if not batch.num_rows:
                continue
            order = _tree_hashes(np.ascontiguousarray(batch.column(0).to_numpy()), trees, seed)
            at, t = np.nonzero(order < most[None])
            if not len(at):
                continue
            new = pa.table(batch.select(list(range(1, batch.num_columns))).take(pa.array(at)))
            held = new if held is None else pa.concat_tables([held, new])
            place, tree = np.concatenate([place, order[at, t]]), np.concatenate([tree, t])
            if len(tree) > 4 * trees * psi or batch.num_rows > trees * psi:
                order = np.lexsort((place, tree))
                first = order[np.arange(len(order)) - np.searchsorted(tree[order], tree[order]) < psi]
                held, place, tree = held.take(pa.array(first)).combine_chunks(), place[first], tree[first]
                full = np.bincount(tree, minlength=trees) == psi
                most[full] = np.array([place[tree == k].max() for k in np.flatnonzero(full)], np.uint64)
        if held is not None:
            order = np.lexsort((place, tree))
            first = order[np.arange(len(order)) - np.searchsorted(tree[order], tree[order]) < psi]
            out = held.take(pa.array(first)).combine_chunks()
            columns = [pa.array(tree[first].astype(np.int32)), pa.array(place[first].astype(np.int64)), *(c.combine_chunks() for c in out.columns)]
            yield from pa.table(columns, names=["tree", "place", *out.column_names]).to_batches()

    best = F.row_number().over(Window.partitionBy("tree").orderBy("place", "k"))
    return rows.mapInArrow(keep, schema).withColumn("__r", best).where(F.col("__r") <= psi).drop("place", "__r")


#: A forest: tree -> node -> (feature, cut, length); feature -1 is a leaf, node k's children are 2k + 1 (below the cut) and 2k + 2.
Forest = dict[int, dict[int, tuple[int, float, float]]]


def path_lengths(df: DataFrame, cols: list[str], forest: Forest, name: str = "path_length") -> DataFrame:
    """Add the mean depth at which the trees isolate a row; missing values count as 0."""

    def lengths(x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in forest.values():
            todo = [(0, np.arange(len(x)))]
            while todo:
                node, at = todo.pop()
                if not len(at):
                    continue
                f, cut, length = tree.get(node, (-1, 0.0, 0.0))
                if f < 0:
                    total[at] += length
                else:
                    left = x[at, f] < cut
                    todo += [(2 * node + 1, at[left]), (2 * node + 2, at[~left])]
        return total / max(1, len(forest))

    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), f"`{name}` double"])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(**{name: lengths(np.nan_to_num(pdf[cols].to_numpy(float)))})

    return df.mapInPandas(run, schema)


def isolation_forest(train: DataFrame, test: DataFrame, cols: list[str], key: str, trees: int = 50, psi: int = 256, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Add ``iforest_score`` (offset minus anomaly: negative is an outlier) and ``iforest_outlier``.

    Each tree grows in one group of the ``psi`` rows of ``tree_samples``; all trees together are trees x 2 psi nodes.
    The offset is the training quantile of the scores at ``contamination``.
    """
    sample = tree_samples(train, cols, key, trees, psi, seed)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("k", kind="stable")
        tree, x = int(pdf["tree"].iloc[0]), pdf[cols].to_numpy(float)
        random, rows, deepest = np.random.default_rng((seed, tree)), [], math.ceil(math.log2(max(2, psi)))
        todo = [(0, np.arange(len(x)), 0)]
        while todo:
            node, at, depth = todo.pop()
            low, high = x[at].min(0), x[at].max(0)
            usable = np.flatnonzero(high > low)
            if depth >= deepest or len(at) <= 1 or not len(usable):
                rows.append((tree, node, -1, 0.0, depth + _path_norm(len(at))))
                continue
            f = int(random.choice(usable))
            cut = float(random.uniform(low[f], high[f]))
            left = x[at, f] < cut
            if left.all() or not left.any():  # a cut at the very edge of the range
                cut = float(high[f])
                left = x[at, f] < cut
            rows.append((tree, node, f, cut, 0.0))
            todo += [(2 * node + 1, at[left], depth + 1), (2 * node + 2, at[~left], depth + 1)]
        return pd.DataFrame(rows, columns=["tree", "node", "f", "cut", "length"])

    nodes = sample.groupBy("tree").applyInPandas(grow, "tree int, node long, f int, cut double, length double").toPandas()
    forest = {t: {r.node: (r.f, r.cut, r.length) for r in g.itertuples()} for t, g in nodes.groupby("tree")}
    norm = _path_norm(psi)

    def score(df: DataFrame) -> DataFrame:
        return path_lengths(df, cols, forest, "iforest_raw").withColumn("iforest_raw", -F.pow(F.lit(2.0), -F.col("iforest_raw") / norm))

    offset = quantiles(score(train.select(*cols)), [], [contamination], "iforest_raw").first()["q"][0]
    out = score(test).withColumn("iforest_score", F.col("iforest_raw") - F.lit(offset)).drop("iforest_raw")
    return out.withColumn("iforest_outlier", F.col("iforest_score") < 0)


def _squared(x: np.ndarray, mean: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Squared distances, summed in the same order whatever the rows of a batch, so that two passes find the same number."""
    off, total = x - mean, np.zeros(len(x))
    for i in range(x.shape[1]):
        part = np.zeros(len(x))
        for j in range(x.shape[1]):
            part += off[:, j] * inverse[j, i]
        total += part * off[:, i]
    return total


def _columns(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The d columns of a batch of counted rows, and how many rows each stands for."""
    x = np.stack([np.asarray(c, float) for c in batch.columns[:d]], 1) if batch.num_rows else np.zeros((0, d))
    return x, np.asarray(batch.columns[d], np.int64)


def _sums(counted: DataFrame, cols: list[str], means: np.ndarray, inverses: np.ndarray, limits: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each chain (n, mean, covariance) of the rows within its limit, from one pass with a vector of sums for each task."""
    m, d = means.shape

    def run(batches):
        total = np.zeros((m, 1 + d + d * d))
        for batch in batches:
            x, n = _columns(batch, d)
            for k in range(m):
                off, w = x - means[k], n.astype(float)
                if limits is not None:
                    near = _squared(x, means[k], inverses[k]) <= limits[k]
                    off, w = off[near], w[near]
                weighted = off * w[:, None]
                total[k] += np.concatenate([[w.sum()], weighted.sum(0), (off.T @ weighted).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    parts = counted.select(*cols, "__n").mapInArrow(run, "sums array<double>")
    found = parts.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()  # m x (1 + d + d^2) numbers
    total = np.zeros(m * (1 + d + d * d))
    for r in found:
        total[r["i"]] = r["v"]
    total = total.reshape(m, -1)
    n = np.maximum(total[:, 0], 1)
    shift, square = total[:, 1 : 1 + d] / n[:, None], (total[:, 1 + d :] / n[:, None]).reshape(m, d, d)
    return total[:, 0], means + shift, square - shift[:, :, None] * shift[:, None, :]


#: Different rows that a task of a concentration step reads at least.
TASK_ROWS = 100_000
#: Bits of a distance that are below those of a level of its selection; the levels have 20, 22 and 22 bits.
LEVELS = (44, 22, 0)


def _limits(counted: DataFrame, cols: list[str], means: np.ndarray, inverses: np.ndarray, rank: int) -> np.ndarray:
    """For each chain the ``rank``-th least squared distance, exactly.

    A distance is read as a whole number of 64 bits, which has the same order. Each level counts rows by the next bits of
    those distances that begin like the wanted one; a task sends on a row for each different value of these bits.
    """
    m, d = means.shape
    begins, left = np.zeros(m, np.int64), np.full(m, rank, np.int64)
    above = 64
    for shift in LEVELS:

        def run(batches, begins=begins.copy(), shift=shift, above=above):
            held: list[list] = [[] for _ in range(m)]
            sizes = [0] * m

            def merged(k: int) -> tuple[np.ndarray, np.ndarray]:
                digits, at = np.unique(np.concatenate([h[0] for h in held[k]]), return_inverse=True)
                return digits, np.bincount(at, np.concatenate([h[1] for h in held[k]]), len(digits)).astype(np.int64)

            for batch in batches:
                x, n = _columns(batch, d)
                for k in range(m):
                    bits = (np.maximum(_squared(x, means[k], inverses[k]), 0.0) + 0.0).view(np.int64)
                    own = np.ones(len(bits), bool) if above == 64 else bits >> above == begins[k]
                    held[k].append((bits[own] >> shift, n[own]))
                    sizes[k] += int(own.sum())
                    if sizes[k] > max(1 << 20, len(held[k][0][0])):
                        held[k], sizes[k] = [merged(k)], 0
            for k in range(m):
                if held[k]:
                    digits, counts = merged(k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(digits), k, np.int32)), pa.array(digits), pa.array(counts)], names=["k", "digits", "n"])

        found = counted.select(*cols, "__n").mapInArrow(run, "k int, digits long, n long").groupBy("k", "digits").agg(F.sum("n").alias("n"))
        wanted = F.element_at(F.array(*(F.lit(int(v)) for v in left)), F.col("k") + 1)
        end = F.sum("n").over(Window.partitionBy("k").orderBy("digits"))  # 4 million digits at most, those of a 256th of an octave
        for r in found.withColumn("end", end).where((F.col("end") >= wanted) & (F.col("end") - F.col("n") < wanted)).collect():  # one for each chain
            begins[r["k"]], left[r["k"]] = r["digits"], left[r["k"]] - (r["end"] - r["n"])
        above = shift
    return begins.view(np.float64)


def robust_covariance(train: DataFrame, cols: list[str], starts: int = 10, steps: int = 30, kept: int = 3, key: str | None = None, ridge: float = 1e-6, seed: int = 42) -> tuple[np.ndarray, np.ndarray, float]:
    """(mean, covariance, determinant of the concentrated half's covariance) by concentration steps from several starts.

    Every chain starts at the mean and covariance of d + 1 rows of its own (``tree_samples``; one of all rows), takes
    two steps, and the ``kept`` chains of least determinant go on until none moves. A step takes the h = (n + d + 1) div 2
    rows nearest to the last mean and covariance; all chains advance in the same passes, three for the exact h-th distance
    and one for sums. Equal rows are counted once and read as one with a weight. The covariance is made consistent for
    Gaussian data by the median of the squared distances over that of chi-square.
    """
    values = train.select(*([key] if key else []), *(F.col(c).cast("double").alias(c) for c in cols)).dropna(subset=cols)
    stored = values.groupBy(*cols).agg(F.count("*").alias("__n")).persist()
    (n, different), d = stored.agg(F.sum("__n"), F.count("*")).first(), len(cols)
    if (n or 0) <= d + 1:
        stored.unpersist()
        raise ValueError(f"{n or 0} complete rows are too few for {d} columns")
    counted = stored.coalesce(-(-different // TASK_ROWS))
    h = min(n, (n + d + 1) // 2)
    marked = values if key else counted.withColumn("__k", F.concat_ws("|", *cols))
    rows = tree_samples(marked, cols, key or "__k", starts, d + 1, seed).toPandas()  # starts x (d + 1) rows
    flat = lambda c: c + ridge * np.eye(d)
    first = [(g[cols].to_numpy(float).mean(0), np.cov(g[cols].to_numpy(float).T, bias=True).reshape(d, d)) for _, g in rows.groupby("tree") if len(g) > 1]
    zero = np.zeros((1, d))
    _, mean, cov = _sums(counted, cols, zero, zero, None)
    first.append((mean[0], cov[0]))
    means, covs = (np.array(x) for x in zip(*first, strict=True))
    dets = np.full(len(means), np.inf)
    for step in range(steps):
        inverses = np.array([np.linalg.pinv(flat(c)) for c in covs])
        limits = _limits(counted, cols, means, inverses, h)
        _, new_means, new_covs = _sums(counted, cols, means, inverses, limits)
        still = all(np.allclose(a, b, rtol=1e-9, atol=1e-12) for a, b in ((means, new_means), (covs, new_covs)))
        means, covs = new_means, new_covs
        dets = np.array([np.linalg.det(flat(c)) for c in covs])
        if step == 1:
            best = np.argsort(dets, kind="stable")[:kept]
            means, covs, dets = means[best], covs[best], dets[best]
        elif still:
            break
    best = int(np.argmin(dets))
    mean, cov, det = means[best], flat(covs[best]), float(dets[best])
    middle = _limits(counted, cols, means[best : best + 1], np.linalg.inv(cov)[None], -(-n // 2))[0]
    stored.unpersist()
    return mean, cov * (middle / chi2_quantile(0.5, d) if middle > 0 else 1.0), det


def robust_envelope(train: DataFrame, test: DataFrame, cols: list[str], contamination: float = 0.1, steps: int = 30, starts: int = 10, key: str | None = None) -> DataFrame:
    """Add ``envelope_score`` (negative is an outlier) and ``envelope_outlier``; see ``robust_covariance``.

    The offset is the training quantile of the squared distances at 1 - ``contamination``.
    """
    mean, cov, _ = robust_covariance(train, cols, starts, steps, key=key)
    d2 = squared_mahalanobis(cols, mean, np.linalg.inv(cov))
    offset = quantiles(train.select(*cols).dropna().select(d2.alias("__d")), [], [1 - contamination], "__d").first()["q"][0]
    return test.withColumn("envelope_score", F.lit(offset) - d2).withColumn("envelope_outlier", F.col("envelope_score") < 0)


def lof(train: DataFrame, test: DataFrame, key: str, vector: str, k: int = 20, exact: bool = True) -> DataFrame:
    """(key, lof, lof_outlier): the local outlier factor of test rows among training rows; above 1.5 is an outlier.

    With ``exact=False`` neighbours come from the cells nearest to a row (see ``knn_join``).
    """
    near = knn_join(train, train, k, key, vector, exact=exact)
    kdist = near.groupBy(F.col("a_key").alias("b_key")).agg(F.max("distance").alias("kdist"))

    def density(pairs: DataFrame) -> DataFrame:
        reach = pairs.join(kdist, "b_key").select("a_key", "b_key", F.greatest("kdist", "distance").alias("reach"))
        return reach.groupBy("a_key").agg((1 / (F.avg("reach") + 1e-10)).alias("lrd"))

    own = density(near).select(F.col("a_key").alias("b_key"), F.col("lrd").alias("b_lrd"))
    found = knn_join(test, train, k, key, vector, exact=exact)
    ratio = found.join(own, "b_key").groupBy("a_key").agg(F.avg("b_lrd").alias("around")).join(density(found), "a_key")
    return ratio.select(F.col("a_key").alias(key), (F.col("around") / F.col("lrd")).alias("lof")).withColumn("lof_outlier", F.col("lof") > 1.5)


def combine_uncertainty(df: DataFrame, iforest: str, envelope: str, lof_score: str, distance: str, compat: bool = False) -> DataFrame:
    """``uncertainty``: 0.3, 0.3, 0.2 and 0.2 of the logistic scores and of the distance relative to the greatest one.

    Scores are negative for outliers; ``compat`` turns the sign of the third one round.
    """
    top = df.agg(F.max(distance).alias("__top"))

    def logistic(c: Column) -> Column:
        return 1 / (1 + F.exp(c))

    third = logistic(-F.col(lof_score) if compat else F.col(lof_score))
    u = 0.3 * logistic(F.col(iforest)) + 0.3 * logistic(F.col(envelope)) + 0.2 * third + 0.2 * F.col(distance) / (F.col("__top") + 1e-6)
    return df.crossJoin(F.broadcast(top)).withColumn("uncertainty", u).drop("__top")


def outlier_vote(df: DataFrame, flags: list[str], least: int = 2) -> DataFrame:
    votes = sum((F.coalesce(F.col(f).cast("int"), F.lit(0)) for f in flags[1:]), F.coalesce(F.col(flags[0]).cast("int"), F.lit(0)))
    return df.withColumn("votes", votes).withColumn("is_outlier", F.col("votes") >= least)


def adjust_confidence(df: DataFrame, confidence: str, uncertainty: str, method: str = "linear") -> DataFrame:
    c, u = F.col(confidence), F.col(uncertainty)
    ways = {"linear": lambda: c * (1 - u), "exponential": lambda: c * F.exp(-2 * u), "threshold": lambda: F.when(u > 0.5, c / 2).otherwise(c)}
    if method not in ways:
        raise ValueError(f"unknown method {method}")
    return df.withColumn("adjusted_confidence", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ways[method]())))


def uncertainty_report(df: DataFrame, true: str, predicted: str, confidence: str, threshold: float = 0.5) -> DataFrame:
    """Accuracy, rows and mean confidences of the certain and the uncertain rows, and their outlier share."""
    ok = (F.col(true) == F.col(predicted)).cast("double")
    level = F.when(F.col("uncertainty") > threshold, "high").otherwise("low")
    return df.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.avg(ok).alias("accuracy"), F.avg(confidence).alias("mean_confidence"), F.avg("adjusted_confidence").alias("mean_adjusted"), F.avg(F.col("is_outlier").cast("double")).alias("outlier_rate"))
