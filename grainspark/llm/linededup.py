"""Line deduplication with a sharded minimal perfect hash.

A line's key is the line without ASCII white space at its ends, A-Z lower-cased; keys of at least ``min_chars`` code
points that two documents hold lose their lines everywhere except in the document of the smallest id. Keys are hashed
to 128 bits. Keys held by two or more documents are found by one aggregation that combines before the shuffle. They
are dealt over shards by their hash, and each shard becomes a minimal perfect hash (a cascade of bit arrays) that
indexes compact arrays of fingerprints, counts and owners. Lines of documents probe the arrays of their shard; no line
text and no line table is joined. A shard that holds very frequent keys is probed in several places: its arrays are
sent to as many slots as its share of the probes asks for, and documents are dealt over those slots. So every line is
decided by a perfect hash, at any size.

Edge cases: a null or empty text is one empty line; lines are cut at \\n only and kept lines are returned unchanged;
copies of a line inside its owner all stay; rows that share an id are one document; null ids come after all others,
and rows with a null id are one document if their texts are equal (among such documents the one of the least text
hash owns a line); extra columns are carried along untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainspark.functions.durable import durable
from grainspark.llm.common import fresh, map_texts, mixed, named, small_batches

STRIPPED = " \t\n\x0b\x0c\r"
_LAST = (1 << 63) - 1
#: Repeated keys that one shard holds about.
SHARD_KEYS = 100_000


def line_keys(text: str | None, min_chars: int = 10) -> list[bytes | None]:
    """The 16-byte hash of each line's key; None where the key is too short."""
    out: list[bytes | None] = []
    for line in (text or "").split("\n"):
        key = line.strip(STRIPPED)
        out.append(xxhash.xxh3_128_digest(key.encode("utf-8", "replace").lower()) if len(key) >= min_chars else None)
    return out


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys: levels of bits, each key at the first level where it is alone."""

    SPREAD = 2.0

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(bits).astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            if len(sizes) > 200:
                raise ValueError("keys are not distinct")
            size = (int(len(keys) * cls.SPREAD) // 64 + 1) * 64
            at = cls._place(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mixed(keys + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(size)).astype(np.int64)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """A number below the count of keys for each, -1 for keys that are certainly absent; a key that was not built in may get any."""
        out, left, start = np.full(len(keys), -1), np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            bit = start + self._place(keys[left], level, size)
            byte, inside = bit >> 3, (bit & 7).astype(np.uint8)
            on = (self.bits[byte] >> inside & 1).astype(bool)
            below = np.bitwise_count(self.bits[byte] & ((1 << inside.astype(np.int64)) - 1).astype(np.uint8))
            out[left[on]] = (self.rank[byte] + below)[on]
            left = left[~on]
            start += size
        return out


def build_shards(keys: DataFrame, slots: DataFrame) -> DataFrame:
    """(slot, sizes, bits, fingerprints, owners, ties) from distinct keys (shard, h1, h2, owner, tie) and ``slots`` (shard, slot).

    Keys of one shard that agree in h1 go to arrays of their own, so a slot may get several rows.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        while len(pdf):
            again = pdf["h1"].duplicated()
            one, pdf = pdf[~again], pdf[again]
            h1 = one["h1"].to_numpy().view(np.uint64)
            perfect = PerfectHash.build(h1)
            at, arrays = perfect.index(h1), []
            for column in ("h2", "owner", "tie"):
                values = np.zeros(len(one), np.int64)
                values[at] = one[column].to_numpy()
                arrays.append(values.tobytes())
            rows.append((int(one["shard"].iloc[0]), perfect.sizes, perfect.bits.tobytes(), *arrays))
        return pd.DataFrame(rows, columns=["shard", "sizes", "bits", "fingerprints", "owners", "ties"])

    made = keys.groupBy("shard").applyInPandas(build, "shard int, sizes array<long>, bits binary, fingerprints binary, owners binary, ties binary")
    return made.join(slots, "shard").drop("shard")


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id", min_chars: int = 10) -> DataFrame:
    """The input with ``text`` reduced to its kept lines, and ``n_lines``, ``n_dropped``."""
    spark = docs.sparkSession
    small_batches(spark)
    owner = F.coalesce(named(id_col).cast("long"), F.lit(_LAST))
    tie = F.when(named(id_col).cast("long").isNull(), F.xxhash64(named(text).cast("string"))).otherwise(F.lit(0).cast("long"))
    base = docs.select(owner.alias("owner"), tie.alias("tie"), named(text).alias("text"))

    def read(texts):
        rows, halves = [], []
        for i, t in enumerate(texts):
            keys = set(line_keys(t, min_chars)) - {None}
            halves += keys
            rows.append(np.full(len(keys), i, np.int64))
        h = np.frombuffer(b"".join(halves), np.int64).reshape(-1, 2)
        return np.concatenate(rows) if rows else np.zeros(0, np.int64), [np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1])]

    lines = map_texts(base, "text", ["owner", "tie"], "h1 long, h2 long", lambda: read)
    ends = [f("owner").alias(n) for f, n in ((F.min, "owner"), (F.max, "other"))] + [f("tie").alias(n) for f, n in ((F.min, "tie"), (F.max, "far_tie"))]
    # Only keys that null ids alone hold have ties of two kinds or an owner that is one.
    grouped = lines.groupBy("h1", "h2").agg(*ends, F.count("*").alias("n"))
    repeated = durable(grouped.where("owner < other OR tie < far_tie").select("h1", "h2", "owner", F.when(F.col("owner") == _LAST, F.col("tie")).otherwise(0).alias("tie"), "n"))

    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + repeated.count() // SHARD_KEYS)
    shard = F.pmod(F.col("h1"), F.lit(shards)).cast("int")
    hits = {r["shard"]: r["n"] for r in repeated.groupBy(shard.alias("shard")).agg(F.sum("n").alias("n")).collect()}  # one row for each shard
    even = max(1.0, sum(hits.values()) / shards)
    copies = [math.ceil(hits.get(k, 0) / even) or 1 for k in range(shards)]
    first = np.concatenate([[0], np.cumsum(copies)]).tolist()
    slots = spark.createDataFrame([(k, first[k] + j) for k in range(shards) for j in range(copies[k])], "shard int, slot int")
    arrays = build_shards(repeated.withColumn("shard", shard), slots)

    def deal(batches):
        start, width = np.array(first[:-1]), np.array(copies)
        for batch in batches:
            who, h = batch.column(0).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            at = np.mod(h, shards)
            slot = start[at] + (mixed(who ^ batch.column(1).to_numpy().view(np.uint64)) % width[at].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(slot.astype(np.int32))], names=["owner", "tie", "h1", "h2", "slot"])

    def probe(asked: pd.DataFrame, layers: pd.DataFrame) -> pd.DataFrame:
        lost = np.zeros(len(asked), bool)
        h1, h2, who, own = (asked[c].to_numpy() for c in ("h1", "h2", "owner", "tie"))
        for row in layers.itertuples() if len(asked) else ():
            at = PerfectHash([int(s) for s in row.sizes], np.frombuffer(row.bits, np.uint8)).index(h1.view(np.uint64))
            known = np.flatnonzero(at >= 0)
            at = at[known]
            same = np.frombuffer(row.fingerprints, np.int64)[at] == h2[known]
            other = (np.frombuffer(row.owners, np.int64)[at] != who[known]) | (np.frombuffer(row.ties, np.int64)[at] != own[known])
            lost[known] |= same & other
        return asked.loc[lost, ["owner", "tie", "h1"]]

    probes = lines.select("owner", "tie", "h1", "h2").mapInArrow(deal, "owner long, tie long, h1 long, h2 long, slot int")
    lost = probes.groupBy("slot").cogroup(arrays.groupBy("slot")).applyInPandas(probe, "owner long, tie long, h1 long").distinct()
    new = [text, "n_lines", "n_dropped"]
    rest = [c for c in docs.columns if c not in new]
    who, own, body, gone = fresh(docs.columns, "owner", "tie", "body", "gone")
    by_document = lost.groupBy(F.col("owner").alias(who), F.col("tie").alias(own)).agg(F.collect_list("h1").alias(gone))
    joined = docs.select(*(named(c) for c in rest), named(text).alias(body), owner.alias(who), tie.alias(own)).join(by_document, [who, own], "left")

    def keep(texts, lost_keys):
        kept, n_lines, n_dropped = [], [], []
        for t, keys_gone in zip(texts, lost_keys.to_pylist(), strict=True):
            lines = (t or "").split("\n")
            n_lines.append(len(lines))
            if keys_gone:
                keys_gone = set(keys_gone)
                lines = [x for x, k in zip(lines, line_keys(t, min_chars), strict=True) if k is None or int.from_bytes(k[:8], "little", signed=True) not in keys_gone]
            kept.append("\n".join(lines))
            n_dropped.append(n_lines[-1] - len(lines))
        return None, [kept, n_lines, n_dropped]

    return map_texts(joined, body, rest, f"`{text}` string, n_lines long, n_dropped long", lambda: keep, (named(gone),))
