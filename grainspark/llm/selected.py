"""Hashed terms of texts, and the choice of those that tell labels apart.

A text's terms are its distinct lower-cased words and their beginnings of 4 to 7 bytes (which carry inflected and
compounded forms), hashed into cells. Cells are counted for each label on the executors and chosen by the
log-likelihood ratio of cell and label; what reaches the driver is bounded by the number of chosen cells.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainspark.llm.common import WordHasher, distinct_pairs, map_texts

CELL_BITS = 21
CELLS = 1 << CELL_BITS
BEGINNINGS = (4, 5, 6, 7)


def term_cells(hasher: WordHasher, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (index of the text, cell) pairs, sorted, and the number of words of each text."""
    owners, values, words = [], [], np.zeros(len(texts), np.int64)
    for owner, starts, ends, hashes in hasher.chunks(texts):
        words += np.bincount(owner, minlength=len(texts))
        found = [(owner, hashes(starts, ends))]
        for n in BEGINNINGS:
            longer = ends - starts > n
            found.append((owner[longer], hashes(starts[longer], starts[longer] + n) ^ np.uint64(0xA5A5A5A5A5A5 + n)))
        at, cells = distinct_pairs(np.concatenate([o for o, _ in found]), np.concatenate([v for _, v in found]) % np.uint64(CELLS), CELL_BITS)
        owners.append(at)
        values.append(cells)
    at, cells = distinct_pairs(np.concatenate(owners), np.concatenate(values), CELL_BITS)
    return at, cells.astype(np.int64), words


def among(cells: np.ndarray, owner: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, position in the sorted ``cells``) of the found cells that are among them."""
    if not len(cells):
        return owner[:0], found[:0]
    at = np.minimum(np.searchsorted(cells, found), len(cells) - 1)
    known = cells[at] == found
    return owner[known], at[known]


def choose(rows: DataFrame, sizes: list[int], marks: bool = False, least_ratio: float = 6.0, least_rows: int = 3, most: int = 6000) -> np.ndarray:
    """The sorted cells of greatest ratio from rows of (text, label), a label being an index into ``sizes``."""
    names = [f"n{k}" for k in range(len(sizes))]

    def count(batches):
        hasher, total = WordHasher(marks), np.zeros((len(sizes), CELLS), np.int32)
        for batch in batches:
            owner, cells, _ = term_cells(hasher, batch.column(0).to_pylist())
            label = batch.column(1).to_numpy()[owner]
            for k in range(len(sizes)):
                total[k] += np.bincount(cells[label == k], minlength=CELLS).astype(np.int32)
        at = np.flatnonzero(total.any(0))
        yield pa.RecordBatch.from_pydict({"cell": at.astype(np.int32)} | {n: total[k, at].astype(np.int64) for k, n in enumerate(names)})

    schema = "cell int, " + ", ".join(f"{n} long" for n in names)
    counted = rows.select("text", F.col("label").cast("int")).mapInArrow(count, schema).groupBy("cell").agg(*(F.sum(n).alias(n) for n in names))
    both = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    ratio = F.lit(0.0)
    for n, size in zip(names, sizes, strict=True):
        ratio = ratio + F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / (both * F.lit(size / sum(sizes))))).otherwise(0.0)
    best = counted.where(both >= least_rows).select("cell", ratio.alias("ratio")).where(F.col("ratio") >= least_ratio)
    return np.sort(np.array([r["cell"] for r in best.orderBy(F.desc("ratio"), "cell").limit(most).collect()], np.int64))


def chosen_rows(rows: DataFrame, cells: np.ndarray, marks: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
    """For a bounded table of (id, text, label): the positions of chosen cells of each row, and the labels, by id."""

    def start():
        hasher = WordHasher(marks)

        def run(texts):
            owner, at = among(cells, *term_cells(hasher, texts)[:2])
            edges = np.searchsorted(owner, np.arange(len(texts) + 1))
            at = at.astype(np.uint16)
            return None, [[at[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]]

        return run

    got = map_texts(rows, "text", ["id", "label"], "at binary", start).toPandas().sort_values("id", kind="stable")
    return [np.frombuffer(x, np.uint16).astype(np.int64) for x in got["at"]], got["label"].to_numpy(np.int64)
