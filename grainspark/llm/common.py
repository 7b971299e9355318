"""What several operators of this folder need: batches of texts, folds, samples and vectorised hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows and bytes that one Arrow batch holds at most (a batch has one row at least, however long its text is).
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
#: Bytes of text that are hashed at once; the arrays of that step take some twenty times as much.
CHUNK_BYTES = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> None:
    """Keep Arrow batches small in rows and bytes, so that very long texts do not meet by the hundred in a Python worker.

    The session keeps these limits, as what is built here runs later.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = spark.conf.get(key).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive tasks, and what they hold counts for their executor."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores put before them until they clash neither with the columns nor with each other."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def named(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def map_texts(docs: DataFrame, text: str, keep: list[str], new: str, start: Callable, extra: tuple[Column, ...] = ()) -> DataFrame:
    """The ``keep`` columns, as they are, beside the columns ``new`` (a schema string) that Python makes from texts.

    ``start()`` runs once in a task and gives a function of (texts, *extra), ``extra`` being Arrow arrays. It returns
    (rows, columns): values for each of the new columns, and the positions of the rows they belong to (None: one for
    each row, in order). Kept columns never leave Arrow, so ids stay exact beside nulls.
    """
    small_batches(docs.sparkSession)
    own = T.StructType([docs.schema[c] for c in keep])
    out = T.StructType(own.fields + T._parse_datatype_string(new).fields)
    arrow, n, more = to_arrow_schema(out), len(keep), len(extra)
    names = fresh(keep, "text", *(f"extra{k}" for k in range(more)))
    source = docs.select(*(named(c) for c in keep), *(c.alias(name) for c, name in zip((named(text).cast("string"), *extra), names, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in batches:
            work = work or start()
            rows, columns = work(batch.column(n).to_pylist(), *(batch.column(n + 1 + k) for k in range(more)))
            kept = [batch.column(k) for k in range(n)]
            if rows is not None:
                at = pa.array(np.asarray(rows, np.int64))
                kept = [c.take(at) for c in kept]
            made = [c if isinstance(c, pa.Array) else pa.array(c, field.type) for c, field in zip(columns, list(arrow)[n:], strict=True)]
            yield pa.RecordBatch.from_arrays([*kept, *made], schema=pa.schema([pa.field(f.name, a.type) for f, a in zip(arrow, [*kept, *made], strict=True)]))

    return source.mapInArrow(run, out)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(column: str | Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % parts


def in_sample(column: str, share: float) -> Column:
    """True for about ``share`` of the ids, decided by a hash of the id alone, so that retries pick the same rows."""
    edge = int(min(1.0, share) * (1 << 40))
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(column)), F.lit(1 << 40)) < edge


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd multiplier modulo 2**64, and of its inverse."""
    with np.errstate(over="ignore"):
        up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), _MULTIPLIER)]))
        down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), _INVERSE)]))
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit words."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class WordHasher:
    """64-bit hashes of all words of a list of texts at once.

    A word is a run of letters, digits or non-ASCII bytes of the lower-cased text; with ``marks=True`` a run of
    other visible characters is a word too. A word's hash is a difference of prefix sums of byte * m**position,
    moved back by m**-start, so no word is touched in Python.
    """

    def __init__(self, marks: bool = False):
        kind = np.zeros(256, np.uint8)
        kind[ord("0") : ord("9") + 1] = kind[ord("a") : ord("z") + 1] = kind[128:] = 1
        if marks:
            for c in range(33, 127):
                if not kind[c] and not chr(c).isalpha():
                    kind[c] = 2
        self.kind = kind
        self.up, self.down = powers(1 << 12)

    def chunks(self, texts):
        """(index of the text, start, end, hash of byte ranges as a function) for the words of stretches of the texts, in order.

        A stretch has about ``CHUNK_BYTES`` of whole texts or of whole words of a longer text.
        """
        group, size = [], 0
        for i, t in enumerate(texts):
            blob = (t or "").lower().encode("utf-8", "replace")
            at = 0
            while len(blob) - at > CHUNK_BYTES:
                end = at + CHUNK_BYTES
                while end < len(blob) and self.kind[blob[end]] and self.kind[blob[end]] == self.kind[blob[end - 1]]:
                    end += 1
                yield self._words([(i, blob[at:end])])
                at = end
            blob = blob[at:]
            if size + len(blob) > CHUNK_BYTES and group:
                yield self._words(group)
                group, size = [], 0
            group.append((i, blob))
            size += len(blob)
        yield self._words(group)

    def _words(self, group):
        which = np.array([i for i, _ in group], np.int64)
        lengths = np.array([len(b) + 1 for _, b in group], np.int64)
        raw = np.frombuffer(b" ".join([b for _, b in group]) + b" ", np.uint8)
        if len(raw) > len(self.up):
            self.up, self.down = powers(2 * len(raw))
        kind = self.kind[raw]
        edges = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)))
        kinds = kind[edges]
        ends = np.append(edges[1:], len(raw))
        starts, ends = edges[kinds > 0], ends[kinds > 0]
        with np.errstate(over="ignore"):
            total = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=total[1:])

        def hashes(first, last):
            with np.errstate(over="ignore"):
                return mixed((total[last] - total[first]) * self.down[first])

        owner = np.searchsorted(np.cumsum(lengths), starts, side="right")
        return (which[owner] if len(which) else owner), starts, ends, hashes

    def __call__(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """(index of the text, hash) for every word, in order."""
        found = [(owner, hashes(starts, ends)) for owner, starts, ends, hashes in self.chunks(texts)]
        return np.concatenate([o for o, _ in found]), np.concatenate([h for _, h in found])


def distinct_pairs(owner: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (owner, value) pairs, sorted, for values below 2**bits; both fit into one sortable word."""
    word = np.sort((owner.astype(np.uint64) << np.uint64(bits)) | value.astype(np.uint64))
    first = np.ones(len(word), bool)
    first[1:] = word[1:] != word[:-1]
    word = word[first]
    return (word >> np.uint64(bits)).astype(np.int64), word & np.uint64((1 << bits) - 1)
