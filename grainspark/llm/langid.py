"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, every run of non-letters becomes one blank, and the 1- to 3-grams are hashed into a fixed
number of cells. Document frequencies are counted over every learning row on the executors. The weights are fitted
by follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties) on a bounded, documented sample of the
learning rows, and a softmax temperature is fitted on a part of the sample that the weights have not seen.

Edge cases: a null text or one without a letter gives ``und`` with score 0; without any learning row every text gives
``und``; rows with a null label or a null id are scored but never learned from; repeated rows are scored alike; input
columns other than the named ones are carried along untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainspark.llm.common import in_sample, map_texts, small_batches

CELL_BITS = 13
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_IS_LETTER = np.array([chr(c).isalpha() for c in range(0x3000)] + [True])


def letters(text: str) -> np.ndarray:
    """The lower-cased text's code points, every run of non-letters made one blank."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _IS_LETTER[np.minimum(points, 0x3000)]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.where(letter, points, np.uint32(32))[keep]


def gram_cells(points: np.ndarray) -> np.ndarray:
    """The cell of every 1-, 2- and 3-gram that ends in ``points`` (all of them for the whole of a text)."""
    shift = np.uint32(32 - CELL_BITS)
    with np.errstate(over="ignore"):
        one = points * np.uint32(0x9E3779B1)
        two = (one[:-1] ^ np.uint32(0x51ED270B)) * np.uint32(0x85EBCA6B) + one[1:]
        three = (two[:-1] ^ np.uint32(0x2545F491)) * np.uint32(0xC2B2AE35) + one[2:]
        return np.concatenate([x * np.uint32(0x27D4EB2F) >> shift for x in (one, two, three)]).astype(np.int64)


def gram_counts(texts, stretch: int = 1 << 18) -> np.ndarray:
    """Counts of the n-gram cells, one row per text; null counts as empty. Long texts are counted stretch by stretch."""
    out = np.zeros((len(texts), 1 << CELL_BITS), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        points = letters(text)
        for at in range(0, len(points), stretch):
            out[i] += np.bincount(gram_cells(points[max(0, at - 2) : at + stretch]), minlength=1 << CELL_BITS)
            if at:  # the two points before the stretch were counted with the last one
                out[i] -= np.bincount(gram_cells(points[at - 2 : at]), minlength=1 << CELL_BITS)
    return out


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, cells: int, epochs: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.002, seed: int = 7) -> np.ndarray:
    """Weights (classes x cells) of a multinomial logistic regression; rows are (cells, values) pairs."""
    z, n = np.zeros((classes, cells)), np.zeros((classes, cells))
    order = np.random.default_rng(seed)

    def weights(zs, ns):
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            zs, ns = z[:, at], n[:, at]
            w = weights(zs, ns)
            p = softmax(w @ x)
            p[labels[i]] -= 1
            g = p[:, None] * x
            more = ns + g * g
            z[:, at] = zs + g - (np.sqrt(more) - np.sqrt(ns)) / alpha * w
            n[:, at] = more
    return weights(z, n)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The softmax temperature of least negative log-likelihood, by golden-section search over its logarithm.

    Each label counts as wrong in 1 of n + 2 cases (n: the rows here), so that a model without an error among few
    rows does not become certain.
    """
    if not len(labels):
        return 1.0
    doubt = 1 / (len(labels) + 2)
    wanted = np.full(logits.shape, doubt / max(1, logits.shape[1] - 1))
    wanted[np.arange(len(labels)), labels] = 1 - doubt

    def loss(log_t: float) -> float:
        return -float((np.log(softmax(logits / np.exp(log_t)) + 1e-12) * wanted).sum(1).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(50):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass
class LanguageModel:
    """Labels, idf of each cell, weights and temperature; a few hundred kilobytes whatever the corpus."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        known = np.array([bool(t) and _LETTER.search(t) is not None for t in texts], bool)
        if not self.labels or not len(texts):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        p = softmax(tf_idf(gram_counts(texts), self.idf) @ self.weights.T / self.temperature)
        best = p.argmax(1)
        names = [self.labels[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        return names, np.where(known, np.clip(p.max(1), 0.0, 1.0), 0.0)


def _frequencies(batches):
    total = np.zeros(1 << CELL_BITS, np.int64)
    for batch in batches:
        total += (gram_counts(batch.column(0).to_pylist()) > 0).sum(0)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"cell": at.astype(np.int32), "df": total[at]})


def _sparse():
    def run(texts):
        counts = gram_counts(texts)
        cells = [np.flatnonzero(row).astype(np.uint16) for row in counts]
        values = [np.minimum(row[c], 65535).astype(np.uint16) for row, c in zip(counts, cells, strict=True)]
        return None, [[c.tobytes() for c in cells], [v.tobytes() for v in values]]

    return run


def train(docs: DataFrame, learn: Column, text: str = "text", label: str = "lang", id_col: str = "doc_id", max_rows: int = 6000, epochs: int = 3) -> LanguageModel:
    """Learn from the rows where ``learn`` holds and id and label are not null.

    ``max_rows`` bounds the sample that the weights are fitted on (dealt evenly over the labels, by a hash of the
    id); the idf covers every learning row.
    """
    small_batches(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("id"), F.col(text).cast("string").alias("text"), F.col(label).cast("string").alias("label")).where(learn & F.col("label").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull())
    sizes = {r["label"]: r["n"] for r in base.groupBy("label").agg(F.count("*").alias("n")).collect()}
    labels = sorted(sizes)
    if not labels:
        return LanguageModel([], np.zeros(1 << CELL_BITS), np.zeros((0, 1 << CELL_BITS)), 1.0)
    frequency = np.zeros(1 << CELL_BITS)
    for r in base.select("text").mapInArrow(_frequencies, "cell int, df long").groupBy("cell").agg(F.sum("df").alias("df")).collect():
        frequency[r["cell"]] = r["df"]
    idf = np.log((1 + sum(sizes.values())) / (1 + frequency)) + 1
    each = max_rows / len(labels)
    chosen = F.lit(False)
    for k in labels:
        chosen = chosen | ((F.col("label") == k) & in_sample("id", each / sizes[k]))
    picked = map_texts(base.where(chosen), "text", ["id", "label"], "cells binary, counts binary", _sparse).toPandas().sort_values("id", kind="stable")
    rows = []
    for c, v in zip(picked["cells"], picked["counts"], strict=True):
        at = np.frombuffer(c, np.uint16).astype(np.int64)
        x = np.log1p(np.frombuffer(v, np.uint16).astype(float)) * idf[at]
        rows.append((at, x / max(np.sqrt((x * x).sum()), 1e-12)))
    y = np.array([labels.index(k) for k in picked["label"]], np.int64)
    held = np.arange(len(rows)) % 5 == 4
    fitted = [i for i in range(len(rows)) if not held[i]]
    weights = fit_ftrl([rows[i] for i in fitted], y[fitted], len(labels), len(idf), epochs)
    tested = np.flatnonzero(held)
    logits = np.array([weights[:, rows[i][0]] @ rows[i][1] for i in tested]) if len(tested) else np.zeros((0, len(labels)))
    return LanguageModel(labels, idf.astype(np.float32), weights.astype(np.float32), fit_temperature(logits, y[tested]))


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", carry: tuple[str, ...] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The carried columns (all of them by default) and two new ones: the language and its score; these replace columns of their names."""
    kept = [c for c in (docs.columns if carry is None else carry) if c not in names]

    def run(texts):
        return None, list(model.predict(texts))

    return map_texts(docs, text, kept, f"`{names[0]}` string, `{names[1]}` double", lambda: run)
