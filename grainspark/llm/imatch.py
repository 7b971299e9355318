"""I-Match document fingerprints over randomised lexicon subsets.

The lexicon holds the terms whose inverse document frequency lies in a chosen band: in at least ``min_df`` documents
and a share ``min_share`` of them, and in a share ``max_share`` at most. Document frequencies are exact counts of 52-bit
term hashes over all documents. As shares of all terms add up to the mean number of distinct terms of a document, the
lexicon holds at most that number divided by ``min_share``, however large the corpus: with 200 terms a document and the
default of 2e-5 that is 10 million terms or 80 MB, the proven bound of what is sent to the tasks.

A document's distinct lexicon terms are sorted and hashed as a whole, and once more for each of several random subsets
of the lexicon, from dense ones (few changed words change them) to sparse ones (whose agreement estimates the shared
part of the terms). A document without a term in the band is fingerprinted by all its terms.

Likeness of two fingerprints: 1 if the hashes of the whole agree; else the greatest share of agreeing subsets on one
level of sparseness, among the subsets that hold a term of either.

Edge cases: null is an empty text, and all texts without terms agree with each other; repeated equal rows are one
document in the order of documents and all get its result; null ids sort after all others, by a hash of the text; a
lone document is its own next one; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainspark.llm.common import WordHasher, distinct_pairs, map_texts, mixed, named, small_batches

HASH_BITS = 52
#: (subsets that partition the lexicon, how many of them are used, partitions): one line for each level.
LEVELS = ((4, 4, 6), (16, 16, 2), (64, 32, 1), (256, 32, 1), (1024, 32, 1))
SLOTS = sum(kept * times for _, kept, times in LEVELS)


def _terms(hasher: WordHasher, texts) -> tuple[np.ndarray, np.ndarray]:
    owner, value = hasher(texts)
    return distinct_pairs(owner, value >> np.uint64(64 - HASH_BITS), HASH_BITS)


def lexicon(docs: DataFrame, text: str = "text", min_df: int = 2, min_share: float = 2e-5, max_share: float = 0.2, flush: int = 1 << 20) -> np.ndarray:
    """The sorted term hashes in the band. A task counts ``flush`` terms at a time before Spark adds up the counts."""
    small_batches(docs.sparkSession)

    def count(batches):
        hasher, held, size = WordHasher(), [], 0
        for batch in batches:
            held.append(_terms(hasher, batch.column(0).to_pylist())[1])
            size += len(held[-1])
            if size >= flush:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    def counted(held):
        terms, df = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"term": terms.astype(np.int64), "df": df.astype(np.int64)})

    n = docs.count()
    sums = docs.select(named(text).cast("string").alias("text")).mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    inside = sums.where((F.col("df") >= max(min_df, min_share * n)) & (F.col("df") <= max_share * n))
    return np.sort(inside.select("term").toArrow().column(0).to_numpy().astype(np.uint64))


def in_band(terms: np.ndarray, value: np.ndarray) -> np.ndarray:
    if not len(terms):
        return np.zeros(len(value), bool)
    return terms[np.minimum(np.searchsorted(terms, value), len(terms) - 1)] == value


def fingerprints(hasher: WordHasher, texts, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of all kept terms, 16-bit hashes of the subsets) for each text; 0 marks a subset without a term."""
    n = len(texts)
    owner, value = _terms(hasher, texts)
    inside = in_band(terms, value)
    lacking = np.bincount(owner[inside], minlength=n) == 0
    keep = inside | lacking[owner]
    owner, value = owner[keep], value[keep]
    whole, sums = np.zeros(n, np.uint64), np.zeros(n * SLOTS, np.uint64)
    slot = 0
    with np.errstate(over="ignore"):
        np.add.at(whole, owner, mixed(value + np.uint64(1)))
        for level, (parts, kept, times) in enumerate(LEVELS):
            for k in range(times):
                drawn = mixed(value ^ np.uint64((level * 64 + k + 1) << 53))
                part = (drawn % np.uint64(parts)).astype(np.int64)
                used = part < kept
                np.add.at(sums, owner[used] * SLOTS + slot + part[used], mixed(drawn[used]) | np.uint64(1 << 63))
                slot += kept
    small = np.where(sums > 0, 1 + mixed(sums) % np.uint64(65535), 0).astype(np.uint16)
    return whole, small.reshape(n, SLOTS)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    either, same = (a[1] | b[1]) > 0, (a[1] == b[1]) & (a[1] > 0)
    best, slot, pooled = np.zeros(len(a[0])), 0, np.zeros(len(a[0]), bool)
    for _, kept, times in LEVELS:
        at = slice(slot, slot + kept * times)
        slot += kept * times
        n = either[:, at].sum(1)
        enough = n >= 6
        pooled |= enough
        best = np.where(enough, np.maximum(best, same[:, at].sum(1) / np.maximum(n, 1)), best)
    few = same.sum(1) / np.maximum(either.sum(1), 1)
    return np.where(a[0] == b[0], 1.0, np.where(pooled, best, few))


def as_text(fp: tuple[np.ndarray, np.ndarray]) -> list[str]:
    return [f"{w:016x}" + s.astype(">u2").tobytes().hex() for w, s in zip(fp[0].tolist(), fp[1], strict=True)]


def fingerprint(docs: DataFrame, terms: np.ndarray, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint) for every row."""

    def start():
        hasher = WordHasher()
        return lambda texts: (None, [as_text(fingerprints(hasher, texts, terms))])

    return map_texts(docs.select(named(id_col).cast("long").alias("doc_id"), named(text).alias("text")), "text", ["doc_id"], "fingerprint string", start)


def edited(text: str, following: str) -> str:
    """The text with its last half (rounded down) replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_LAST = -(1 << 63)
#: Text that one range of ids holds about, and the greatest number of ranges.
RANGE_BYTES, MOST_RANGES = 64 << 20, 20_000


@dataclass
class Waiting:
    """A document whose next one has not come yet, and how many equal rows there are of it."""

    doc_id: int | None
    key: tuple
    text: str
    whole: np.uint64
    slots: np.ndarray
    rows: int = 1


def compare_with_next(docs: DataFrame, terms: np.ndarray, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness; see ``edited``.

    The next document is that of the next lower id; after the last comes the first. Ids are cut into ranges (from
    quantiles of the ids alone, their number from the size of the texts), null ids into ranges of a text hash; texts
    move once, to their range; the head of a range is also sent to the range before it. Inside a range rows stream by
    in order, so a task holds one batch and the row before it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(named(id_col).cast("long").alias("doc_id"), F.coalesce(named(text).cast("string"), F.lit("")).alias("text"))
    base = base.select("doc_id", F.coalesce("doc_id", F.lit(_LAST)).alias("order"), "text").withColumn("h", F.xxhash64("text"))
    size = base.agg(F.count("*").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls"), F.sum(F.octet_length("text")).alias("bytes")).first()
    parts = int(min(MOST_RANGES, max(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, (size["bytes"] or 0) // RANGE_BYTES)))
    null_parts = -(-parts * size["nulls"] // max(1, size["n"]))
    cuts = base.where("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10_000, 4 * parts))).first()[0] if parts > 1 else None
    edges = np.unique(np.array(cuts or [], np.int64))

    def bucket(order: np.ndarray, h: np.ndarray, null: np.ndarray) -> np.ndarray:
        spread = ((h.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(32)) * np.uint64(null_parts) >> np.uint64(32)
        return np.where(null, len(edges) + 1 + spread.astype(np.int64), len(edges) - np.searchsorted(edges, order, side="left")).astype(np.int32)

    def placed(batch):
        order, h = batch.column("order").to_numpy(), batch.column("h").to_numpy()
        return order, h, bucket(order, h, np.asarray(batch.column("doc_id").is_null()))

    def heads_of(batches):
        for batch in batches:
            order, h, at = placed(batch)
            first = np.lexsort((h, -(order + 1), at))  # order + 1: the least long has no negative
            first = first[np.concatenate([[True], at[first][1:] != at[first][:-1]])] if len(at) else first
            yield pa.RecordBatch.from_pydict({"bucket": at[first], "order": order[first], "back": ~h[first]})

    found = base.select("doc_id", "order", "h").mapInArrow(heads_of, "bucket int, order long, back long").groupBy("bucket").agg(F.max(F.struct("order", "back")).alias("head")).collect()
    heads = sorted((r["bucket"], (r["head"]["order"], ~r["head"]["back"])) for r in found)  # one for each range
    before = {head: heads[i - 1][0] for i, (_, head) in enumerate(heads)}
    head_orders = np.array(sorted({order for order, _ in before}), np.int64)

    def deal(batches):
        for batch in batches:
            order, h, at = placed(batch)
            maybe = np.flatnonzero(np.isin(order, head_orders)).tolist()
            guests = [k for k in maybe if (int(order[k]), int(h[k])) in before]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at), pa.array(np.zeros(len(at), bool))], names=names)
            if guests:
                there = np.array([before[int(order[k]), int(h[k])] for k in guests], np.int32)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(guests)) for c in batch.columns), pa.array(there), pa.array(np.ones(len(guests), bool))], names=names)

    names = ["doc_id", "order", "text", "h", "bucket", "guest"]
    rows = base.select(*names[:4]).mapInArrow(deal, "doc_id long, order long, text string, h long, bucket int, guest boolean")
    rows = rows.repartition("bucket").sortWithinPartitions("bucket", "guest", F.desc("order"), "h")

    def run(batches):
        hasher, wait = WordHasher(), None

        def settled(pairs):
            """pairs: (waiting document, next text, its whole hash, its subset hashes)."""
            changed = [edited(w.text, following) for w, following, *_ in pairs]
            own = (np.array([w.whole for w, *_ in pairs], np.uint64), np.array([w.slots for w, *_ in pairs]))
            after = (np.array([p[2] for p in pairs], np.uint64), np.array([p[3] for p in pairs]))
            new = fingerprints(hasher, changed, terms)
            columns = [[w.doc_id for w, *_ in pairs], [len(w.text) for w, *_ in pairs], changed, as_text(own), as_text(new), likeness(own, new), likeness(own, after)]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=made)
            at = np.repeat(np.arange(len(pairs)), [w.rows for w, *_ in pairs])
            for k in range(0, len(at), 256):
                yield out if len(at) == len(pairs) and len(at) <= 256 else out.take(pa.array(at[k : k + 256]))

        for batch in batches:
            texts = batch.column("text").to_pylist()
            whole, slots = fingerprints(hasher, texts, terms)
            ids, keys = batch.column("doc_id").to_pylist(), list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "order", "h")), strict=True))
            pairs = []
            for i, guest in enumerate(batch.column("guest").to_pylist()):
                if wait and (guest or wait.key != keys[i]):
                    pairs.append((wait, texts[i], whole[i], slots[i]))
                    wait = None
                if wait:
                    wait.rows += 1
                elif not guest:
                    wait = Waiting(ids[i], keys[i], texts[i], whole[i], slots[i])
            if pairs:
                yield from settled(pairs)

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    made = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
