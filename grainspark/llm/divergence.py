"""How far the sources of each language are from each other, and which terms set a source apart, in exact integers.

Terms are runs of letters and non-ASCII characters, A-Z lower-cased. Tasks pack the terms of a batch by length: up to
eight bytes into one uint64 word, up to sixteen into two; longer terms go to buckets of their own by the next power of
two and are sorted as bytes. Words are radix-sorted by 16-bit digits and runs are counted in numpy, first for each
document (a run is one document of a term), then for each (language, source) group of all batches so far, so that a
task sends on a row for each group and term, not for each occurrence.

Spark adds the counts, keeps the terms that ``min_docs`` documents of a language have, and deals each language's terms
over slots. In a slot the counts are a terms x sources matrix; it gives partial sums of divergence for each pair of
sources and the slot's top terms of each source, which two small aggregations bring together. Terms that a source lacks
count as well, so nothing is sparse by omission. The pairs of sources of a language are the result itself, so a
language's list of sources fits where its result does.

Edge cases: null texts, languages and sources are ''; every row is one document, rows that repeat an id too; a text
without terms still names its group; a language without kept terms has value 0 for all pairs; a language of one source
has no pairs; extra columns are ignored; an empty table gives no rows. Ties are ordered by UTF-8 bytes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainspark.functions.durable import durable, release
from grainspark.llm.common import named, small_batches

#: Bytes of text that are packed at once, runs that a task holds before it sends them on, and terms of a slot.
STRETCH_BYTES, HELD_RUNS, SLOT_TERMS, LEAST_SLOTS = 4 << 20, 1 << 20, 20_000, 64
#: Entries of a terms x sources matrix that are worked on at once.
BLOCK = 1 << 20
SCALE = 1_000_000_000

_IN_TERM = np.zeros(256, bool)
_IN_TERM[ord("a") : ord("z") + 1] = _IN_TERM[ord("A") : ord("Z") + 1] = _IN_TERM[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def radix_order(*words: np.ndarray) -> np.ndarray:
    """The stable order of rows by unsigned integer columns, most significant first, in passes over 16-bit digits."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 8 * word.itemsize, 16):
            digit = (word >> word.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def merge_runs(owner: np.ndarray, key: tuple[np.ndarray, ...], *weights: np.ndarray) -> tuple:
    """(owner, key, *sums) with one row for each distinct (owner, key); keys are uint64 columns or one column of bytes."""
    if not len(owner):
        return owner, key, *weights
    if key[0].dtype.kind == "S":
        order = np.argsort(key[0], kind="stable")
        order = order[radix_order(owner[order])]
    else:
        order = radix_order(owner, *key)
    owner, key = owner[order], tuple(k[order] for k in key)
    new = np.ones(len(owner), bool)
    new[1:] = owner[1:] != owner[:-1]
    for k in key:
        new[1:] |= k[1:] != k[:-1]
    at = np.flatnonzero(new)
    return owner[at], tuple(k[at] for k in key), *(np.add.reduceat(w[order], at) for w in weights)


def _packed(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The first eight bytes from each start as one big-endian word, bytes from ``lengths`` on set to zero."""
    words = np.lib.stride_tricks.sliding_window_view(raw, 8)[starts].view(">u8").ravel().astype(np.uint64)
    drop = (8 * (8 - np.minimum(lengths, 8))).astype(np.uint64)
    return words >> drop << drop


def pack_terms(blob: bytes) -> dict[int, tuple[np.ndarray, tuple[np.ndarray, ...]]]:
    """Bucket -> (starts, key columns) of all terms of ``blob``; buckets are 1 and 2 words, or a width in bytes."""
    raw = _LOWER[np.frombuffer(blob + bytes(16), np.uint8)]
    edge = np.diff(_IN_TERM[raw].astype(np.int8), prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = ends - starts
    out = {}
    for bucket in (1, 2):
        own = (size > 8 * (bucket - 1)) & (size <= 8 * bucket)
        at, n = starts[own], size[own]
        out[bucket] = at, tuple(_packed(raw, at + 8 * w, n - 8 * w) for w in range(bucket))
    far = np.flatnonzero(size > 16)
    width = 1 << np.ceil(np.log2(np.maximum(size[far], 1))).astype(np.int64)
    for w in np.unique(width):
        own = far[width == w]
        block = np.zeros((len(own), w), np.uint8)
        for row, k in zip(block, own, strict=True):
            row[: size[k]] = raw[starts[k] : ends[k]]
        out[int(w)] = starts[own], (block.view(f"S{w}").ravel(),)
    return out


def as_strings(key: tuple[np.ndarray, ...]) -> pa.Array:
    """Packed keys as an Arrow string column; terms have no zero byte, so zeros are padding."""
    if key[0].dtype.kind == "S":
        table = np.ascontiguousarray(key[0]).view(np.uint8).reshape(len(key[0]), -1)
    else:
        table = np.stack(key, 1).astype(">u8").view(np.uint8).reshape(len(key[0]), -1)
    used = table != 0
    offsets = np.concatenate([[0], np.cumsum(used.sum(1))])
    return pa.LargeStringArray.from_buffers(len(key[0]), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(table[used].tobytes())).cast(pa.string())


class Tally:
    """Counts of terms and of their documents for each (language, source) group of a task."""

    def __init__(self, stretch: int = STRETCH_BYTES, held: int = HELD_RUNS):
        self.stretch, self.held = stretch, held
        self.clear()

    def clear(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.runs: dict[int, list[tuple]] = {}
        self.size = 0

    def _stretches(self, texts):
        """(bytes, row of each start as a function) for stretches of whole texts, or of a longer text cut between terms."""
        rows, blobs, size = [], [], 0
        for i, text in enumerate(texts):
            blob = (text or "").encode("utf-8", "replace")
            at = 0
            while len(blob) - at > self.stretch:
                end = at + self.stretch
                while end < len(blob) and _IN_TERM[blob[end]]:
                    end += 1
                yield blob[at:end], np.array([i]), np.array([0])
                at = end
            blob = blob[at:]
            if blobs and size + len(blob) > self.stretch:
                yield b" ".join(blobs), np.array(rows), np.concatenate([[0], np.cumsum([len(b) + 1 for b in blobs])[:-1]])
                rows, blobs, size = [], [], 0
            rows.append(i)
            blobs.append(blob)
            size += len(blob) + 1
        if blobs:
            yield b" ".join(blobs), np.array(rows), np.concatenate([[0], np.cumsum([len(b) + 1 for b in blobs])[:-1]])

    def add(self, texts: list[str | None], groups: list[tuple[str, str]]) -> bool:
        """Count the texts of some documents; true if the runs, merged, still take more than half of what may be held."""
        parts: dict[int, list[tuple]] = {}
        for blob, rows, begins in self._stretches(texts):
            for bucket, (starts, key) in pack_terms(blob).items():
                if len(starts):
                    owner = rows[np.searchsorted(begins, starts, side="right") - 1].astype(np.uint32)
                    parts.setdefault(bucket, []).append(merge_runs(owner, key, np.ones(len(owner), np.int64)))
        code = np.array([self.groups.setdefault(g, len(self.groups)) for g in groups], np.uint32)
        for bucket, found in parts.items():
            owner, key, n = found[0] if len(found) == 1 else merge_runs(*_joined(found))
            self._put(bucket, merge_runs(code[owner], key, n, np.ones(len(n), np.int64)))
        if self.size <= self.held:
            return False
        for bucket in list(self.runs):
            self._merge(bucket)
        return self.size > self.held // 2

    def _put(self, bucket: int, run: tuple) -> None:
        self.runs.setdefault(bucket, []).append(run)
        self.size += len(run[0])

    def _merge(self, bucket: int) -> tuple:
        runs = self.runs.pop(bucket)
        self.size -= sum(len(r[0]) for r in runs)
        one = merge_runs(*_joined(runs))
        self._put(bucket, one)
        return one

    def drain(self):
        """Record batches (lang, source, term, n, docs) of all counts; the tally is empty afterwards."""
        names = list(self.groups)
        lang, source = (pa.array([g[k] for g in names], pa.string()) for k in range(2))
        for bucket in list(self.runs):
            owner, key, n, docs = self._merge(bucket)
            for at in range(0, len(owner), 1 << 16):
                cut = slice(at, at + (1 << 16))
                who = pa.array(owner[cut].astype(np.int32))
                yield pa.RecordBatch.from_arrays([lang.take(who), source.take(who), as_strings(tuple(k[cut] for k in key)), pa.array(n[cut]), pa.array(docs[cut])], names=["lang", "source", "term", "n", "docs"])
        self.clear()


def _joined(runs: list[tuple]) -> tuple:
    """(owner, key, *weights) of several runs of one bucket, one behind the other."""
    keys = tuple(np.concatenate(k) for k in zip(*(r[1] for r in runs), strict=True))
    return np.concatenate([r[0] for r in runs]), keys, *(np.concatenate(w) for w in zip(*(r[2:] for r in runs), strict=True))


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents that have it."""
    small_batches(docs.sparkSession)

    def run(batches):
        tally = Tally()
        for batch in batches:
            if tally.add(batch.column(0).to_pylist(), list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))):
                yield from tally.drain()
        yield from tally.drain()

    texts = docs.select(named(text).cast("string").alias("text"), *(F.coalesce(named(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))))
    counted = texts.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def rates(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / whole), exact for 0 <= count <= whole < 2^53: long division, three decimal digits at a time."""
    out = np.zeros(np.broadcast(count, whole).shape, np.int64)
    rest = count + out
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 10, top: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for every other source, ``term`` rows for the ``top`` terms of each source."""
    counts = term_counts(docs, text, lang, source)
    terms = durable(counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("by")).where(F.col("docs") >= min_docs).drop("docs"))
    names = docs.select(*(F.coalesce(named(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source")))).distinct()
    sizes = terms.select("lang", F.explode("by").alias("x")).groupBy("lang", F.col("x")["source"].alias("source")).agg(F.sum(F.col("x")["n"]).alias("size"))
    groups = durable(names.join(sizes, ["lang", "source"], "left").select("lang", "source", F.coalesce("size", F.lit(0).cast("long")).alias("size")))
    slots = max(LEAST_SLOTS, math.ceil(terms.count() / SLOT_TERMS))
    kept = terms.groupBy("lang").agg(F.count("*").alias("kept"))
    langs = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "size"))).alias("sources")).join(kept, "lang")
    left = terms.withColumn("slot", F.pmod(F.xxhash64("term"), F.lit(slots)).cast("int"))
    right = langs.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))

    def compare(rows: pa.Table, facts: pa.Table) -> pa.Table:
        """The slot's share of every pair, the lesser source first, and its top terms of each source."""
        if not rows.num_rows or not facts.num_rows:
            return pa.table({"lang": [], "part": [], "source": [], "item": [], "value": []}, schema=_PARTS)
        fact = facts.slice(0, 1).to_pylist()[0]
        sources, v = [s["source"] for s in fact["sources"]], fact["kept"]
        place = {s: k for k, s in enumerate(sources)}
        whole = np.array([s["size"] for s in fact["sources"]], np.int64) + 2 * v
        by = rows["by"].combine_chunks()
        row = np.repeat(np.arange(rows.num_rows), np.asarray(by.value_lengths()))
        flat = by.flatten()
        col = np.array([place[s] for s in flat.field("source").to_pylist()], np.int64)
        n, n_lang = np.asarray(flat.field("n")), np.asarray(rows["n"])
        own = rates(n + 2, whole[col])
        absent = rates(np.full(len(sources), 2, np.int64), whole)
        total = np.zeros((len(sources), len(sources)), np.int64)
        order = np.argsort(row, kind="stable")
        step = max(1, BLOCK // len(sources))
        for at in range(0, rows.num_rows, step):
            most = min(step, rows.num_rows - at)
            p = np.repeat(absent[None], most, 0)
            now = order[np.searchsorted(row[order], at) : np.searchsorted(row[order], at + most)]
            p[row[now] - at, col[now]] = own[now]
            for a in range(len(sources) - 1):
                total[a, a + 1 :] += gaps(p[:, a, None], p[:, a + 1 :]).sum(0)
        a, b = np.triu_indices(len(sources), 1)
        q = rates(n_lang + 2, np.int64(int(whole.sum()) - 2 * v * len(sources) + 2 * v))[row]
        words = np.array([t.encode("utf-8") for t in rows["term"].to_pylist()], object)
        up = np.flatnonzero((own > q) & (n > 0))
        f = gaps(own[up], q[up])
        rank = np.argsort(words, kind="stable").argsort() if len(words) else row
        best = np.lexsort((rank[row[up]], -f, col[up]))
        who = col[up][best]
        nth = np.arange(len(best)) - np.searchsorted(who, who)
        best = best[nth < top]
        pick = lambda where: [sources[k] for k in where]
        value = np.concatenate([total[a, b], f[best]])
        return pa.table({"lang": [fact["lang"]] * len(value), "part": ["pair"] * len(a) + ["term"] * len(best), "source": pick(a) + pick(col[up][best]), "item": pick(b) + [words[row[up][k]].decode("utf-8") for k in best], "value": value}, schema=_PARTS)

    found = durable(left.groupBy("lang", "slot").cogroup(right.groupBy("lang", "slot")).applyInArrow(compare, "lang string, part string, source string, item string, value long"))
    release(terms)
    half = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    sums = half.union(half.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value"))
    every = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    pairs = every.join(sums, ["lang", "source", "item"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    both = pairs.union(found.where("part = 'term'").select("lang", "source", "part", "item", "value"))
    ranked = both.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")))
    return ranked.where((F.col("part") == "pair") | (F.col("rank") <= top))


_PARTS = pa.schema([("lang", pa.string()), ("part", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
