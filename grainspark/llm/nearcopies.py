"""Groups of texts whose word shingles are alike: Jaccard similarity of the sets of five-word shingles of at least 0.8.

Texts with one set of shingles are one node, so thousands of copies cost one row. Nodes are candidates if the pivot
distance tables (simhash.py) put their SimHash fingerprints into one component, or if they share one of 20 band keys,
each a hash of five min-hashes. The bands are there because SimHash alone misses most pairs at this similarity: a pair
of similarity s shares a band with probability 1 - (1 - s^5)^20, 0.9996 at 0.8. Every link is verified by the exact
similarity of the two sets of shingles; candidates that are not alike stay apart.

Verification has two passes. In the first, the least node of each group of candidates (its hub) is compared with the
others, so a group of copies costs one comparison a row. Groups that links do not yet make one component come into the
second: they are cut into blocks, and each pair of blocks meets in one task with 16-bit min-hashes and shingle hashes
of its members. There pairs of different components are discarded by the min-hashes where fewer than 60 of 100 agree
(five deviations below 0.8) and by their sizes; survivors are compared. Only links leave a task.

Edge cases: texts without words (null, empty, white space) are copies of each other; a text of fewer words than a
shingle has one shingle of all words; extra columns are carried along untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainspark.functions.durable import durable, release
from grainspark.llm.common import fresh, give_back, map_texts, named
from grainspark.llm.simhash import grouped, majority, shingle_hashes
from grainspark.operators.graph import components

BANDS, ROWS = 20, 5
#: Members of a block in the second pass, and members that are compared with one copy of their hub's set in the first.
BLOCK, SLOT = 512, 4096
_RANDOM = np.random.default_rng(17)
_FACTOR = _RANDOM.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RANDOM.integers(1 << 63, size=(BANDS * ROWS, 1), dtype=np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets as ascending distinct hashes; no Python object is made for a hash."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.searchsorted(a, b)
    common = int(np.count_nonzero(a[np.minimum(at, len(a) - 1)] == b))
    return common / (len(a) + len(b) - common)


def shingle_set(h: np.ndarray) -> np.ndarray:
    return np.unique(np.ascontiguousarray(h).view(np.uint64).ravel())


def min_hashes(h: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    with np.errstate(over="ignore"):
        for at in range(0, len(h), 1024):
            least = np.minimum(least, (h[None, at : at + 1024] * _FACTOR + _SHIFT).min(1))
    return least


def node_and_keys(text: str | None, width: int) -> tuple[int, int, list[int]]:
    """(hash of the set of shingles, SimHash fingerprint, band keys), as signed longs; without words both are 0 and there are no keys."""
    every = shingle_hashes(text, width, 42)
    if not len(every):
        return 0, 0, []
    h = shingle_set(every)
    bands = [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(min_hashes(h).reshape(BANDS, ROWS))]
    node, fp, *keys = np.array([xxhash.xxh64_intdigest(h.tobytes(), 1), majority(every), *bands], np.uint64).view(np.int64).tolist()
    return node, fp, keys


def sketches(texts: DataFrame, width: int) -> DataFrame:
    """(node, least, shingles): 16 bits of each min-hash, and the hashes of the set of shingles."""

    def run(batch):
        sets = [shingle_set(shingle_hashes(t, width, 42)) for t in batch]
        return None, [[(min_hashes(h) >> np.uint64(48)).astype(np.uint16).tobytes() for h in sets], [h.tobytes() for h in sets]]

    return map_texts(texts, "text", ["node"], "least binary, shingles binary", lambda: run)


def candidates(nodes: DataFrame) -> DataFrame:
    """(group, n, hub, node): the groups of nodes with a common key, as a stored table; keys that the same nodes share are one group.

    Which nodes a key has is told by their number, the least of them and a sum of their hashes, so no list is gathered.
    """
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    told = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub"), F.bit_xor(F.xxhash64("node")).alias("x")).where("n > 1")
    groups = told.groupBy("n", "hub", "x").agg(F.min("key").alias("key"))
    return durable(keyed.join(groups, "key").select(F.col("key").alias("group"), "n", "hub", "node"))


def hub_links(parts: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(u, v): the least node of each group with those of its nodes that are alike.

    The pairs of a hub are dealt over slots of about ``SLOT``; in a slot the hub's set of shingles comes first and its
    members' sets follow in a stream, so each set is moved once a slot and a task holds the hub's set and one batch.
    """
    pairs = durable(parts.where("hub <> node").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct())
    slots = pairs.groupBy("u").agg(F.ceil(F.count("*") / SLOT).cast("int").alias("slots"))
    sets = found.select("node", "shingles")
    hubs = slots.join(sets.withColumnRenamed("node", "u"), "u").select("u", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.lit(None).cast("long").alias("v"), "shingles")
    dealt = pairs.join(slots, "u").select("u", F.pmod(F.xxhash64("v"), F.col("slots")).cast("int").alias("slot"), "v")
    members = dealt.join(sets.withColumnRenamed("node", "v"), "v").select("u", "slot", "v", "shingles")
    stream = hubs.union(members).repartition("u", "slot").sortWithinPartitions("u", "slot", F.asc_nulls_first("v"))

    def run(batches):
        hub, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for k, (u, v, s) in enumerate(zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), batch.column("shingles"), strict=True)):
                now = np.frombuffer(s.as_py(), np.uint64)
                if v is None:
                    hub, own = u, now
                elif u != hub:
                    raise RuntimeError("a member came before its hub")
                elif similarity(own, now) >= least:
                    keep.append(k)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("u").take(at), batch.column("v").take(at)], names=["u", "v"])
        give_back()

    out = durable(stream.mapInArrow(run, "u long, v long"))
    release(pairs)
    return out


def block_links(parts: DataFrame, roots: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """(u, v): links that connect what all alike pairs inside the groups (group, node) connect, beyond the components so far."""
    rooted = parts.join(roots, "node", "left").select("group", "node", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), F.coalesce("root", "node").alias("root"))
    apart = rooted.groupBy("group").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("group")
    cut = rooted.join(apart, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root").join(found, "node")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node", kind="stable")
        node, block, root = (pdf[c].to_numpy() for c in ("node", "block", "root"))
        marks = np.frombuffer(b"".join(pdf["least"]), np.uint16).reshape(len(pdf), -1)
        size = np.array([len(x) for x in pdf["shingles"]])
        across, sets, us, vs = pdf["i"].iloc[0] != pdf["j"].iloc[0], {}, [], []

        def own(k):
            if k not in sets:
                sets[k] = np.frombuffer(pdf["shingles"].iat[k], np.uint64)
            return sets[k]

        for k in range(len(pdf) - 1):
            later = slice(k + 1, None)
            maybe = (root[later] != root[k]) & (np.minimum(size[later], size[k]) >= least * np.maximum(size[later], size[k]))
            if across:
                maybe &= block[later] != block[k]
            maybe = k + 1 + np.flatnonzero(maybe)
            maybe = maybe[(marks[maybe] == marks[k]).mean(1) >= least - 0.2]
            for m in maybe:
                if root[m] != root[k] and similarity(own(k), own(m)) >= least:
                    us.append(node[k])
                    vs.append(node[m])
                    root = np.where(root == root[m], root[k], root)
        give_back()
        return pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

    return durable(cells.groupBy("group", "i", "j").applyInPandas(compare, "u long, v long"))


def grouped_rows(docs: DataFrame, text: str = "text", width: int = 5, least: float = 0.8) -> tuple[DataFrame, DataFrame, str]:
    """The documents as a stored table with a number of the row, (row, group) for each of them, and the name of the number's column."""
    row, node, fp, keys = fresh(docs.columns, "row", "node", "fp", "keys")

    def start():
        give_back()  # of the stages before, which ran in the same workers

        def run(texts):
            return None, list(zip(*(node_and_keys(t, width) for t in texts), strict=True)) or [[], [], []]

        return run

    marked = docs.withColumn(row, F.monotonically_increasing_id())
    rows = durable(map_texts(marked, text, marked.columns, f"`{node}` long, `{fp}` long, `{keys}` array<long>", start))
    plain = rows.select(named(row).alias("row"), named(node).alias("node"), named(fp).alias("fp"), named(keys).alias("keys"))
    near = grouped(plain.select(F.col("row").alias("doc_id"), "fp")).select(F.col("doc_id").alias("row"), F.xxhash64(F.lit("component"), "component_id").alias("near"))
    one = F.min(F.struct("row", "keys", "near")).alias("one")
    nodes = durable(plain.join(near, "row").groupBy("node").agg(one).select("node", "one.row", F.when(F.size("one.keys") > 0, F.concat("one.keys", F.array("one.near"))).alias("keys")))
    parts = candidates(nodes)
    shown = nodes.join(parts.select("node").distinct(), "node").select("node", "row")
    texts = rows.select(named(row).alias("row"), named(text).cast("string").alias("text")).join(shown, "row").select("node", "text")
    found = durable(sketches(texts, width))
    first = hub_links(parts, found, least)
    second = block_links(parts, components(first), found, least)
    roots = components(first.union(second))
    named_nodes = nodes.select("node").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("group"))
    groups = durable(plain.select("row", "node").join(named_nodes, "node").select("row", "group"))
    release(nodes, parts, found, first, second)
    return rows.drop(node, fp, keys), groups, row


def near_copies(docs: DataFrame, text: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """The documents with ``group`` (in place of a column of that name), a number that the rows share which links connect."""
    rows, groups, row = grouped_rows(docs, text, width, least)
    return rows.drop("group").join(groups.withColumnRenamed("row", row), row).drop(row)
