"""Toxicity: a factorisation machine over hashed terms.

A text's terms are its distinct lower-cased words and their beginnings, hashed into cells; the cells most associated
with the label are chosen from a count over the labelled sample (selected.py). The machine then learns a bias, a weight for each
selected cell and a short factor vector for each, so that pairs (an insult beside a mention of a group) weigh more
than their sum. Scoring is one pass over whole texts without a shuffle.

Edge cases: null and empty texts get the score of the bias; without labels of both kinds every score is 0; labels of
unknown rows, null labels and null ids are ignored; repeated label rows count once (the greatest label); extra
columns are carried along untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainspark.llm.common import WordHasher, in_sample, map_texts, small_batches
from grainspark.llm.selected import among, choose, chosen_rows, term_cells


@dataclass
class FactorisationMachine:
    """Bias, selected cells (sorted), their weights and factors; its size is set by the parameters alone."""

    bias: float
    cells: np.ndarray
    weight: np.ndarray
    factor: np.ndarray

    def score(self, owner: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Probabilities for ``n`` texts from (text, position of a selected cell) pairs."""
        linear = np.bincount(owner, self.weight[at], n)
        pairs = np.zeros(n)
        for v in self.factor.T:
            x = v[at]
            pairs += np.bincount(owner, x, n) ** 2 - np.bincount(owner, x * x, n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + pairs / 2, -30, 30)))

    def predict(self, hasher: WordHasher, texts) -> np.ndarray:
        owner, found, _ = term_cells(hasher, texts)
        return self.score(*among(self.cells, owner, found), len(texts))


def fit(rows: list[np.ndarray], y: np.ndarray, cells: np.ndarray, factors: int = 4, epochs: int = 5, rate: float = 0.15, l2: float = 1e-4, seed: int = 11) -> FactorisationMachine:
    """Adaptive-gradient steps on the logistic loss; rows hold positions of selected cells."""
    random = np.random.default_rng(seed)
    w, v = np.zeros(len(cells)), random.normal(0, 0.03, (len(cells), factors))
    gw, gv = np.full(len(cells), 1e-2), np.full((len(cells), factors), 1e-2)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias, gb = float(np.log(prior / (1 - prior))), 1e-2
    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            at = rows[i]
            vs = v[at]
            total = vs.sum(0)
            margin = bias + w[at].sum() + ((total**2).sum() - (vs**2).sum()) / 2
            g = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[i]
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            if len(at):
                dw = g + l2 * w[at]
                gw[at] += dw * dw
                w[at] -= rate * dw / np.sqrt(gw[at])
                dv = g * (total - vs) + l2 * vs
                gv[at] += dv * dv
                v[at] = vs - rate * 0.3 * dv / np.sqrt(gv[at])
    return FactorisationMachine(bias, cells, w, v)


def prior_shift(sizes: dict[int, int], taken_0: float, taken_1: float) -> float:
    """Log odds of the labelled table against those of a sample with ``taken_0`` and ``taken_1`` rows of the labels."""
    return float(np.log(sizes[1] / sizes[0]) - np.log(taken_1 / taken_0))


def train(docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", id_col: str = "doc_id", label: str = "toxic", max_rows: int = 40_000, fit_rows: int = 16_000, max_cells: int = 6000) -> FactorisationMachine:
    """Learn from the labelled rows where ``learn`` (over the labels' id) holds.

    ``max_rows`` bounds the labelled rows whose terms are counted, half for each label; it also bounds the broadcast
    of (id, label) that picks their texts. ``fit_rows`` bounds the rows that the weights are fitted on;
    where it cuts one label more than the other, the bias is moved back to the odds of the whole labelled table.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(id_col).isNotNull() & learn & F.col(label).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return FactorisationMachine(-30.0, np.zeros(0, np.int64), np.zeros(0), np.zeros((0, 1)))

    def sampled(rows: int) -> DataFrame:
        chosen = F.lit(False)
        for k, n in sizes.items():
            chosen = chosen | ((F.col("label") == k) & in_sample("id", rows / 2 / n))
        return docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(known.where(chosen)), "id").select("id", "text", "label")

    cells = choose(sampled(max_rows), [min(sizes[k], max_rows / 2) for k in (0, 1)], most=max_cells)
    rows, y = chosen_rows(sampled(fit_rows), cells)
    model = fit(rows, y.astype(float), cells, epochs=int(np.clip(60_000 / max(1, len(rows)), 5, 30)))
    model.bias += prior_shift(sizes, min(sizes[0], fit_rows / 2), min(sizes[1], fit_rows / 2))
    return model


def score(docs: DataFrame, model: FactorisationMachine, text: str = "text", carry: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``score`` and ``predicted`` to the carried columns (all by default)."""
    kept = [c for c in (docs.columns if carry is None else carry) if c not in ("score", "predicted")]

    def start():
        hasher = WordHasher()

        def run(texts):
            s = model.predict(hasher, texts)
            return None, [s, (s >= 0.5).astype(np.int32)]

        return run

    return map_texts(docs, text, kept, "score double, predicted int", start)
