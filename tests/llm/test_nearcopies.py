"""Near copies of the pipeline against brute force, and the row that stays of each group."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import corpus_pipeline
from grainspark.llm import nearcopies, simhash

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def edited(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.randrange(10**9)}"
    return out


def family(seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([4, 30, 60, 200, 500]))]
    return [" ".join(base), *(" ".join(edited(rng, base, min(n, len(base)))) for n in (1, 1, 2, 4, 8, 11))]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "xx", "s", len(t or "")) for i, t in rows], COLUMNS).repartition(3)


def sets_of(groups):
    return sorted(sorted(g) for g in groups)


def test_groups_equal_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(t for seed in range(25) for t in family(seed))]
    parts = [set(simhash.shingles(t, 5)) for _, t in rows]
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if len(parts[a] & parts[b]) >= 0.8 * len(parts[a] | parts[b]) and group[a] != group[b]:
            old, new = group[a], group[b]
            group = [new if g == old else g for g in group]
    want, got = defaultdict(set), defaultdict(set)
    for (i, _), g in zip(rows, group, strict=True):
        want[g].add(i)
    for r in nearcopies.near_copies(frame(spark, rows)).collect():
        got[r["group"]].add(r.doc_id)
    assert sets_of(got.values()) == sets_of(want.values()) and 25 < len(want) < len(rows)
    kept = corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g) for g in want.values())


def test_a_candidate_group_needs_more_than_its_first_hub(spark):
    """A chain of versions: neighbours are alike, the ends are not, and all share band keys with some others."""
    rng = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for k in range(12):
        rows.append((k, " ".join(words)))
        words = edited(rng, words, 5)
    assert corpus_pipeline.near_dedup(spark, frame(spark, rows), "").count() == 1


def test_groups_larger_than_a_block(spark, monkeypatch):
    """Variants of one text that are mostly not alike: blocks of 16 must find the links that all pairs find."""
    monkeypatch.setattr(nearcopies, "BLOCK", 16)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(80)]
    rows = [(k, " ".join(edited(rng, base, rng.choice([1, 2, 3])))) for k in range(90)]
    parts = [set(simhash.shingles(t, 5)) for _, t in rows]
    group = list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if len(parts[a] & parts[b]) >= 0.8 * len(parts[a] | parts[b]) and group[a] != group[b]:
            old, new = group[a], group[b]
            group = [new if g == old else g for g in group]
    want, got = defaultdict(set), defaultdict(set)
    for (i, _), g in zip(rows, group, strict=True):
        want[g].add(i)
    for r in nearcopies.near_copies(frame(spark, rows)).collect():
        got[r["group"]].add(r.doc_id)
    assert sets_of(got.values()) == sets_of(want.values())


def test_one_word_of_sixty_goes(spark):
    base = family(11)[0].split()
    base = [f"w{k}" for k in range(60)] if len(base) != 60 else base
    rows = [(5, " ".join(base)), (102, " ".join([*base[:30], "other", *base[31:]])), (7, "a wholly different text of its own words")]
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()) == [5, 7]


def test_null_ids_and_repeated_rows(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(40)) for x in "abcd")
    rows = [(None, a), (None, b), (None, b), (3, c), (3, c), (3, d), (None, c), (9, d + " x")]
    out = corpus_pipeline.near_dedup(spark, frame(spark, rows), "").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in out) == sorted([(True, 0, a), (True, 0, b), (False, 3, c), (False, 3, d)])


def test_a_hub_of_very_many_members(spark, monkeypatch):
    """One template, each copy with words of its own: a hub's set goes to each slot once, whatever their number."""
    monkeypatch.setattr(nearcopies, "SLOT", 100)
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = [(k, " ".join([*base, f"own{k}"])) for k in range(3000)] + [(3000 + k, " ".join(f"x{k}y{j}" for j in range(60))) for k in range(50)]
    kept = corpus_pipeline.near_dedup(spark, frame(spark, rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(3000, 3050)]
