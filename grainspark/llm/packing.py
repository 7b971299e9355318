"""Packing of tokenised documents into sequences by a grouping genetic algorithm on islands.

Documents are tokenised, closed by id 0 and cut into pieces of at most one sequence. Pieces that fill a sequence are
one; the others are dealt by a hash into blocks of a few thousand, and each block is packed by several islands. An
island keeps a few packings as groupings of pieces into bins. Crossover injects whole well-filled bins of one parent
into the other, removes the bins that hold duplicates, and puts the displaced pieces back: first in place of shorter
ones that they push out, then best-fit; mutation empties the worst bins. Between rounds the best packing of each
island migrates to the next island of its block; an island rests once it meets a lower bound. Of every block's best
packing the well-filled bins are closed; the worst-filled ones of some thirty blocks make a block of the next level,
until one block is left. So the room that blocks waste is packed again, and the whole is as tight as one block.

Levels and rounds are Spark stages over one row for each island (items, lengths and bin numbers), so neither a task
nor the driver holds more than a few blocks.

Edge cases: a null or empty text is the single id 0; repeated rows are packed as separate pieces; an empty table gives
no pieces; extra columns are ignored; ids may be null and repeat, as every piece has a number of its own.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from grainspark.functions.durable import durable, release
from grainspark.llm.common import map_texts, named, small_batches

SEQUENCE = 2048
BLOCK_PIECES = 4096
#: Blocks whose worst-filled bins meet in one block of the next level.
FAN = 32


class TokenIds:
    """Ids of texts as packed little-endian 32-bit words, equal to those of ``tokenizers`` for a byte-level BPE file.

    Words (stretches between single spaces, whose boundaries are token boundaries) are looked up in a bounded table;
    those not yet known are encoded together by the faster of two libraries with the file's own vocabulary. Texts with
    runs of white space or with a special token's string go through ``tokenizers`` whole.
    """

    #: The splitting pattern of this family of tokenisers, a fixed value.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    _ODD = re.compile(r" \s|\s ")

    def __init__(self, path: str, known_words: int = 300_000):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        self.special = re.compile("|".join(map(re.escape, sorted(special)))) if special else None
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        letters = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
        ranks = {bytes(letters[c] for c in token): i for token, i in self.whole.get_vocab().items() if token not in special}
        self.encode = tiktoken.Encoding("file", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.token_bytes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.token_bytes[i] = len(token)
        self.known: dict[str, bytes] = {"": np.array(self.encode(" "), "<u4").tobytes()}
        self.limit = known_words

    def __call__(self, texts) -> list[bytes]:
        plain: list[list[str] | None] = []
        for t in texts:
            odd = self._ODD.search(t) or self.special and self.special.search(t)
            plain.append(None if odd else t.split(" "))
        new = list(set().union(*(w[1:] for w in plain if w)).difference(self.known)) if plain else []
        extra: dict[str, bytes] = {}
        if new:
            ids = np.array(self.encode(" " + " ".join(new)), "<u4")
            ends = np.cumsum(self.token_bytes[ids])
            word_ends = np.cumsum([len(w.encode("utf-8", "replace")) + 1 for w in new])
            cuts = (np.searchsorted(ends, word_ends, side="left") + 1) * 4
            raw, at = ids.tobytes(), 0
            room = self.limit - len(self.known)
            for i, (w, cut) in enumerate(zip(new, cuts.tolist(), strict=True)):
                (self.known if i < room else extra)[w] = raw[at:cut]
                at = cut
        out = []
        for t, words in zip(texts, plain, strict=True):
            if words is None:
                out.append(np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            first = np.array(self.encode(words[0]), "<u4").tobytes()
            try:
                out.append(first + b"".join(map(self.known.__getitem__, words[1:])))
            except KeyError:
                out.append(first + b"".join([self.known.get(w) or extra[w] for w in words[1:]]))
        return out


@lru_cache(maxsize=2)
def tokeniser(path: str) -> TokenIds:
    """One for each Python worker; workers outlive tasks, so the file is read and words are learned once a worker."""
    return TokenIds(path)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids; only the first may be shorter than ``size``."""
    if n <= size:
        return [(0, n)]
    first = n % size or size
    return [(0, first), *((s, size) for s in range(first, n, size))]


def pieces(docs: DataFrame, tokenizer_path: str, text: str = "text", id_col: str = "doc_id", size: int = SEQUENCE, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, item[, ids]): the pieces of every document.

    ``item`` numbers them over all tasks; it is stable once the result is stored.
    """
    closing = np.array([end_id], "<u4").tobytes()

    def start():
        tokens, item = tokeniser(tokenizer_path), TaskContext.get().partitionId() << 33

        def run(texts):
            nonlocal item
            rows, out = [], []
            for i, raw in enumerate(tokens([t or "" for t in texts])):
                raw += closing
                for k, (at, length) in enumerate(cut(len(raw) // 4, size)):
                    part = raw[4 * at : 4 * (at + length)]
                    rows.append(i)
                    out.append((k, at, length, zlib.crc32(part), item, *([part] if with_ids else [])))
                    item += 1
            return rows, list(zip(*out, strict=True)) if out else [[]] * (5 + with_ids)

        return run

    new = "piece int, start long, length long, ids_crc32 long, item long" + ", ids binary" * with_ids
    return map_texts(docs.select(named(id_col).cast("long").alias("doc_id"), named(text).alias("text")), "text", ["doc_id"], new, start)


def least_bins(lengths, size: int) -> int:
    """A lower bound: the total, or for some length the pieces that cannot share a bin and what is too much for their room."""
    n = np.bincount(np.asarray(lengths, np.int64), minlength=size + 1)
    count, total = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * np.arange(size + 1))])
    half, best = size // 2, -(-int(total[-1]) // size)
    for small in range(half + 1):
        alone = count[-1] - count[size - small + 1]  # longer than size - small: nothing of length small fits beside them
        large, inside = count[size - small + 1] - count[half + 1], total[size - small + 1] - total[half + 1]
        rest = total[half + 1] - total[small] - (large * size - inside)
        best = max(best, int(alone + large + max(0, -(-rest // size))))
    return best


class Packing:
    """Bins of item numbers with their fills; items are put back best-fit by their lengths."""

    def __init__(self, lengths: list[int], size: int):
        self.lengths, self.size = lengths, size
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    @classmethod
    def of(cls, lengths: list[int], size: int, bins) -> Packing:
        self = cls(lengths, size)
        groups: dict[int, list[int]] = {}
        for item, b in enumerate(bins):
            groups.setdefault(b, []).append(item)
        for group in groups.values():
            self.add(group)
        return self

    def add(self, group: list[int]) -> None:
        self.bins.append(group)
        self.fill.append(sum(self.lengths[i] for i in group))

    def best_fit(self, items) -> Packing:
        """Place ``items`` in the given order, each in the fullest bin that still holds it."""
        by_room: list[list[int]] = [[] for _ in range(self.size + 1)]
        mask = 0
        for b, fill in enumerate(self.fill):
            room = self.size - fill
            by_room[room].append(b)
            mask |= 1 << room
        for i in items:
            need = self.lengths[i]
            fitting = mask >> need
            if fitting:
                room = need + (fitting & -fitting).bit_length() - 1
                b = by_room[room].pop()
                if not by_room[room]:
                    mask ^= 1 << room
                self.bins[b].append(i)
            else:
                room, b = self.size, len(self.bins)
                self.bins.append([i])
                self.fill.append(0)
            self.fill[b] += need
            left = room - need
            by_room[left].append(b)
            mask |= 1 << left
        return self

    def replace(self, loose: list[int]) -> list[int]:
        """Put loose items in place of one shorter item of a bin, or of two that are shorter together; return the items then loose."""
        at = [self.lengths[i] for i in loose]
        order = sorted(range(len(loose)), key=at.__getitem__)
        sizes, items = [at[k] for k in order], [loose[k] for k in order]
        for b, group in enumerate(self.bins):
            room = self.size - self.fill[b]
            if not room or not sizes:
                continue
            best = None
            for out in (*combinations(group, 1), *(combinations(group, 2) if len(group) < 7 else ())):
                freed = sum(self.lengths[i] for i in out)
                k = bisect_right(sizes, freed + room) - 1
                if k >= 0 and sizes[k] > freed and (best is None or sizes[k] - freed > best[0]):
                    best = (sizes[k] - freed, k, out)
            if best:
                gain, k, out = best
                self.bins[b] = [i for i in group if i not in out] + [items[k]]
                self.fill[b] += gain
                del sizes[k], items[k]
                for i in out:
                    k = bisect_right(sizes, self.lengths[i])
                    sizes.insert(k, self.lengths[i])
                    items.insert(k, i)
        return items[::-1]

    def cost(self) -> tuple[int, float]:
        """Fewer bins first; among equals, fuller full bins (the rest is then easier to save)."""
        return len(self.bins), -float(np.square(np.array(self.fill, float) / self.size).sum())

    def numbered(self) -> list[int]:
        out = [0] * len(self.lengths)
        for b, group in enumerate(self.bins):
            for i in group:
                out[i] = b
        return out


def crossover(a: Packing, b: Packing, random: np.random.Generator) -> Packing:
    """Inject well-filled bins of ``b`` into ``a``; the displaced pieces replace shorter ones or go back best-fit, longest first."""
    fills = np.array(b.fill)
    good = np.flatnonzero(fills >= np.quantile(fills, 0.3))
    chosen = good[random.random(len(good)) < random.uniform(0.2, 0.6)]
    taken = np.zeros(len(a.lengths), bool)
    for k in chosen:
        taken[b.bins[k]] = True
    child, displaced = Packing(a.lengths, a.size), []
    for k in chosen:
        child.bins.append(list(b.bins[k]))
        child.fill.append(b.fill[k])
    for group, fill in zip(a.bins, a.fill, strict=True):
        hit = [bool(taken[i]) for i in group]
        if any(hit):
            displaced += [i for i, h in zip(group, hit, strict=True) if not h]
        else:
            child.bins.append(list(group))
            child.fill.append(fill)
    return child.best_fit(child.replace(displaced))


def mutate(a: Packing, random: np.random.Generator) -> Packing:
    """Empty the worst-filled bins and some random ones, and put their pieces back as after a crossover."""
    n = len(a.bins)
    worst = set(np.argsort(a.fill)[: max(2, n // 50)].tolist()) | set(random.integers(0, n, max(2, n // 25)).tolist())
    child, loose = Packing(a.lengths, a.size), []
    for k in random.permutation(n).tolist():
        if k in worst:
            loose += a.bins[k]
        else:
            child.bins.append(list(a.bins[k]))
            child.fill.append(a.fill[k])
    return child.best_fit(child.replace(loose))


def evolve(lengths: list[int], population: list[list[int]], seed: int, size: int, generations: int, people: int) -> list[list[int]]:
    """The population after some generations, best first; a short one is filled with best-fit-decreasing packings, the later ones shaken."""
    random, floor = np.random.default_rng(seed), least_bins(lengths, size)
    pool = [Packing.of(lengths, size, p) for p in population]
    while len(pool) < people and not any(len(p.bins) <= floor for p in pool):
        order = np.argsort(-np.array(lengths) * (random.uniform(0.9, 1.0, len(lengths)) if pool else 1.0), kind="stable")
        pool.append(Packing(lengths, size).best_fit(order.tolist()))
    ranked = sorted(((p.cost(), k, p) for k, p in enumerate(pool)), key=lambda x: x[:2])
    count = len(pool)
    for _ in range(generations):
        if ranked[0][0][0] <= floor:
            break
        i, j = random.choice(len(ranked), 2, replace=False) if len(ranked) > 1 else (0, 0)
        child = crossover(ranked[min(i, j)][2], ranked[max(i, j)][2], random)
        if random.random() < 0.5:
            child = mutate(child, random)
        ranked.append((child.cost(), count, child))
        count += 1
        ranked = sorted(ranked, key=lambda x: x[:2])[: max(people, 1)]
    return [p.numbered() for _, _, p in ranked[:people]]


def _worked(frame: DataFrame, schema: str, work) -> DataFrame:
    """Rows made by ``work`` (a row as a dict to some rows), block by block."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                made = work(row)
                if made:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, m, strict=True)) for m in made], schema=pa.schema(types))

    types = list(to_arrow_schema(T._parse_datatype_string(schema)))
    return frame.mapInArrow(run, schema)


STATE = "block long, items array<long>, lengths array<int>, island int, population array<array<int>>, n_bins int"


def pack_blocks(dealt: DataFrame, blocks: int, size: int, islands: int, rounds: int, generations: int, people: int, seed: int) -> DataFrame:
    """(block, items, lengths, bins): the best packing of each block of (block, item, length), as a stored table."""
    tasks = max(1, min(blocks * islands, int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    gathered = dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("length", "item")), asc=False).alias("all"))
    state = (
        gathered.select("block", F.col("all.item").alias("items"), F.col("all.length").cast("array<int>").alias("lengths"))
        .withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
        .withColumn("population", F.array().cast("array<array<int>>"))
        .repartition(tasks, "block", "island")
    )
    for number in range(rounds):

        def grow(row, number=number):
            mix = np.random.SeedSequence([seed, row["block"], row["island"], number]).generate_state(1)[0]
            found = evolve(row["lengths"], row["population"], int(mix), size, generations, people)
            return [(row["block"], row["items"], row["lengths"], row["island"], found, max(found[0]) + 1)]

        state = _worked(state, STATE, grow)
        if number + 1 < rounds:
            ring = Window.partitionBy("block").orderBy("island")
            guest = F.coalesce(F.lead(F.col("population")[0]).over(ring), F.first(F.col("population")[0]).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
            state = state.select("block", "items", "lengths", "island", F.concat(F.array(guest), F.slice("population", 1, people - 1)).alias("population")).repartition(tasks, "block", "island")
    # Islands of a block hold the same items in the same order.
    one = F.struct("n_bins", "island")
    return durable(state.groupBy("block").agg(F.min_by("items", one).alias("items"), F.min_by("lengths", one).alias("lengths"), F.min_by(F.col("population")[0], one).alias("bins")))


def split_bins(row: dict, carry: bool, fan: int) -> list[tuple]:
    """(item, length, sequence_id, offset) of a packed block's pieces; the worst-filled bins are carried: their last two are null.

    A bin is named by the least item in it.
    """
    groups: dict[int, list[int]] = {}
    for k, b in enumerate(row["bins"]):
        groups.setdefault(b, []).append(k)
    fill = {b: sum(row["lengths"][k] for k in g) for b, g in groups.items()}
    left = set(sorted(fill, key=lambda b: (fill[b], b))[: min(-(-len(fill) // fan), len(fill) // 2)] if carry else ())  # at most half, so levels end
    out = []
    for b, group in groups.items():
        name, at = min(row["items"][k] for k in group), 0
        for k in group:
            out.append((row["items"][k], row["lengths"][k], None, None) if b in left else (row["items"][k], row["lengths"][k], name, at))
            at += row["lengths"][k]
    return out


def pack(parts: DataFrame, size: int = SEQUENCE, block_pieces: int = BLOCK_PIECES, islands: int = 2, rounds: int = 2, generations: int = 10, people: int = 3, fan: int = FAN, seed: int = 1) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (as of ``pieces``; it must be a stored table, read more than once)."""
    small_batches(parts.sparkSession)
    todo = parts.where(F.col("length") < size).select("item", "length")
    spots = parts.where(F.col("length") >= size).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    while True:
        n = todo.count()
        if not n:
            break
        blocks = -(-n // block_pieces)
        dealt = todo.withColumn("block", F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(blocks)))
        best = pack_blocks(dealt, blocks, size, islands, rounds, generations, people, seed)
        carry = blocks > 1
        done = durable(_worked(best, "item long, length int, sequence_id long, offset long", lambda row, carry=carry: split_bins(row, carry, fan)))
        release(best)
        spots = spots.unionByName(done.where("sequence_id IS NOT NULL").select("item", "sequence_id", "offset"))
        if not carry:
            break
        todo = done.where("sequence_id IS NULL").select("item", F.col("length").cast("long").alias("length"))
    return parts.join(spots, "item").select(*parts.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Tokenise, store the pieces' lengths once, and pack them."""
    return pack(durable(pieces(docs, tokenizer_path)), **options)
