"""SimHash near-duplicates by pivot distance tables.

Every text has a 64-bit fingerprint: a bit is 1 if it is set in over half the XXH64 values (seed 42) of its word
shingles, repeats included. Fingerprints link at ``radius`` or fewer differing bits.

Links are found from a table of Hamming distances between each distinct fingerprint and fixed reference fingerprints
(pivots): one base pivot, and for each of eight 8-bit blocks a few pivots that differ from it in that block only.
The block's pivots are a resolving set of the 8-cube, so a block's distances (relative to the base) tell its value.
Two fingerprints within 2 bits agree in at least six of the eight blocks, so they agree in all distances of one of
the 28 choices of six blocks: those distances are the search key. Members of one key differ in at most 16 bits, so a
key never holds more than 65,536 fingerprints, whatever the input. Inside every key, pairs whose distances differ by
more than the radius at any pivot are discarded, survivors are verified bit by bit, and only a spanning forest of the
links leaves the task. Components come from repeated contraction.

Edge cases: a null, empty or white-space text has fingerprint zero and is linked like any other; fewer words than a
shingle give one shingle of all words; equal fingerprints are one node, so thousands of copies cost one row; a null id
never names a component unless all ids of it are null; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainspark.functions.durable import durable
from grainspark.llm.common import map_texts, mixed, named
from grainspark.operators.graph import components

BLOCKS = 8
_NATIVE = np.dtype(">u8")


def shingles(text: str | None, width: int) -> list[bytes]:
    """Runs of ``width`` words joined by a space; all words if there are fewer; none of a text without words.

    ``bytes.lower`` and ``bytes.split`` know ASCII letters and ASCII white space only, as is wanted here.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def shingle_hashes(text: str | None, width: int, seed: int) -> np.ndarray:
    """The XXH64 values of all shingles, repeats included, as rows of eight bytes, most significant first."""
    parts = shingles(text, width)
    digest, blocks = xxhash.xxh64_digest, []
    for at in range(0, len(parts), 1 << 16):
        blocks.append(b"".join([digest(p, seed) for p in parts[at : at + (1 << 16)]]))
    return np.frombuffer(b"".join(blocks), np.uint8).reshape(-1, 8)


def majority(h: np.ndarray) -> int:
    """The fingerprint of rows of hash bytes: a bit is 1 if it is set in over half the rows; zero without rows."""
    if not len(h):
        return 0
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 255):
        votes += np.add.reduce(np.unpackbits(h[at : at + 255], axis=1), 0, dtype=np.uint8)
    return int(np.packbits(votes * 2 > len(h)).view(_NATIVE)[0])


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(texts):
        return None, [np.array([fingerprint(t, width, seed) for t in texts], np.uint64).view(np.int64)]

    return map_texts(docs.select(named(id_col).cast("long").alias("doc_id"), named(text).alias("text")), "text", ["doc_id"], "fp long", lambda: run)


def resolving_codes(seed: int = 5) -> np.ndarray:
    """Bytes whose Hamming distances tell all 256 bytes apart (seven or so are enough)."""
    cube, random, codes = np.arange(256, dtype=np.uint8), np.random.default_rng(seed), np.zeros(0, np.uint8)
    while True:
        codes = random.choice(np.arange(1, 256, dtype=np.uint8), 7, replace=False)
        seen = np.bitwise_count(cube[:, None] ^ codes[None, :])
        if len(np.unique(seen, axis=0)) == 256:
            return codes


def pivots(seed: int = 3) -> tuple[np.ndarray, int]:
    """(the reference fingerprints, pivots in each block); the first is the base."""
    base, codes = int(np.random.default_rng(seed).integers(1 << 63)), resolving_codes()
    table = [base, *(base & ~(0xFF << (8 * b)) | (int(c) << (8 * b)) for b in range(BLOCKS) for c in codes)]
    return np.array(table, np.uint64), len(codes)


PIVOTS, PER_BLOCK = pivots()


def distance_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances (n x pivots) as signed bytes."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def search_keys(fp: np.ndarray, radius: int) -> np.ndarray:
    """n x choices 64-bit keys; each covers the pivot distances of all blocks but ``radius``."""
    table = distance_table(fp)
    relative = (table[:, 1:] - table[:, :1]).reshape(len(fp), BLOCKS, PER_BLOCK).astype(np.int64)
    weight = 17 ** np.arange(PER_BLOCK, dtype=np.int64)
    block = mixed(((relative + 8) @ weight).astype(np.uint64) + (np.arange(BLOCKS, dtype=np.uint64) << np.uint64(40)))
    choices = list(combinations(range(BLOCKS), BLOCKS - radius))
    with np.errstate(over="ignore"):
        return np.stack([mixed(block[:, list(c)].sum(1, dtype=np.uint64) + np.uint64(k + 1)) for k, c in enumerate(choices)], 1)


def forest(fp: np.ndarray, radius: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (positions u, v) of the links among some distinct fingerprints.

    A breadth-first walk: the whole frontier (in slices) is compared with what no tree has reached yet, first by the
    largest difference of pivot distances, then bit by bit.
    """
    table, left = distance_table(fp), np.arange(len(fp))
    us, vs = [], []
    while len(left):
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            now, frontier = frontier[:block], frontier[block:]
            reached = np.full(len(left), -1)
            for at in range(0, len(left), 4096):
                part = left[at : at + 4096]
                close = np.ones((len(part), len(now)), bool)
                for p in range(0, table.shape[1], PER_BLOCK):
                    close &= np.abs(table[part, p, None] - table[None, now, p]) <= radius
                i, j = np.nonzero(close)
                d = np.abs(table[part[i]] - table[now[j]]).max(1) <= radius
                i, j = i[d], j[d]
                true = np.bitwise_count(fp[part[i]] ^ fp[now[j]]) <= radius
                reached[at + i[true]] = now[j[true]]
            hit = reached >= 0
            us.append(reached[hit])
            vs.append(left[hit])
            frontier = np.concatenate([frontier, left[hit]])
            left = left[~hit]
    return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, int), np.zeros(0, int))


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int) -> np.ndarray:
    """Which of the pairs are within ``radius`` bits: those whose pivot distances differ more are discarded, the rest verified."""
    maybe = np.abs(distance_table(a) - distance_table(b)).max(1) <= radius if len(a) else np.zeros(0, bool)
    maybe[maybe] = np.bitwise_count(a[maybe] ^ b[maybe]) <= radius
    return maybe


def links(distinct: DataFrame, radius: int = 2, rows_a_task: int = 20_000) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (a stored table) that connect exactly what links of ``radius`` connect."""

    def keys(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            k = search_keys(fp.view(np.uint64), radius)
            yield pa.RecordBatch.from_pydict({"key": k.view(np.int64).ravel(), "fp": np.repeat(fp, k.shape[1])})

    def connect(batches):
        for batch in batches:
            members = batch.column(0)
            flat, cuts = members.flatten().to_numpy().view(np.uint64), np.concatenate([[0], np.cumsum(np.asarray(members.value_lengths()))])
            two = np.flatnonzero(np.diff(cuts) == 2)
            a, b = flat[cuts[two]], flat[cuts[two] + 1]
            near = close_pairs(a, b, radius)
            us, vs = [a[near]], [b[near]]
            for k in np.flatnonzero(np.diff(cuts) > 2):
                fp = flat[cuts[k] : cuts[k + 1]]
                u, v = forest(fp, radius)
                us.append(fp[u])
                vs.append(fp[v])
            yield pa.RecordBatch.from_pydict({"u": np.concatenate(us).view(np.int64), "v": np.concatenate(vs).view(np.int64)})

    # A row becomes 28 (for radius 2), so the few tasks of a small table are not enough.
    spread = distinct.select("fp").repartition(1 + distinct.count() // rows_a_task)
    grouped = spread.mapInArrow(keys, "key long, fp long").groupBy("key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    return grouped.select("members").mapInArrow(connect, "u long, v long")


def grouped(rows: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of a stored table (doc_id, fp): the smallest id among all fingerprints reachable by links."""
    distinct = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct, radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", width: int = 3, seed: int = 42, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every document; see ``grouped``."""
    return grouped(durable(fingerprints(docs, text, id_col, width, seed)), radius)
