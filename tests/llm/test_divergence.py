"""The divergence audit against plain dictionaries and SQL; packing, radix order and stretches against Python."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from grainspark.llm import divergence, queries

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute_force(rows, min_docs=10, top=10):
    """(lang, source, part, item, value, rank) from rows of (text, lang, source)."""
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        terms = [t.translate(LOWER) for t in TERM.findall(text or "")]
        count[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in docs:
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=str.encode)
        own = {s: c for (x, s), c in count.items() if x == lang}
        total = Counter()
        for c in own.values():
            total.update({t: c[t] for t in kept})

        def p(c, kept=kept):
            whole = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // whole for t in kept}

        rate, q = {s: p(c) for s, c in own.items()}, p(total)
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(-sum(f(rate[s][t], rate[x][t]) for t in kept), x) for x in own if x != s]
            terms = [(-f(rate[s][t], q[t]), t) for t in kept if own[s][t] and rate[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                ordered = sorted(items, key=lambda x: (x[0], x[1].encode()))
                out |= {(lang, s, part, x, -v, k) for k, (v, x) in enumerate(ordered, 1) if part == "pair" or k <= top}
    return out


def rows_of(found):
    got = [(r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in found.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_query_equals_dictionaries_and_sql(spark, sf_dir, duck):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = rows_of(queries.op13_source_divergence(spark, sf_dir))
    assert got == brute_force(rows) and len(got) > 100
    assert got == set(duck.sql(f"SELECT lang, source, part, item, value, rank FROM ({queries.oracle_sql()['op13_source_divergence']})").fetchall())


def test_terms_of_every_length(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abzAZé文\U0001f600") for _ in range(n)) for n in (1, 2, 7, 8, 9, 15, 16, 17, 31, 32, 33, 64, 65, 300) for _ in range(4)]
    rows = [("1 ".join(rng.choices(words, k=60)), rng.choice(["x", "y"]), rng.choice("pqr")) for _ in range(120)]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    assert rows_of(divergence.audit(frame)) == brute_force(rows)
    assert rows_of(divergence.audit(frame, min_docs=60, top=3)) == brute_force(rows, 60, 3)


def test_stretches_and_small_tallies():
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("abcDé", k=rng.randint(1, 20))) for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "zz" * 500]
    groups = [("l", str(i % 3)) for i in range(len(texts))]
    want = Counter()
    docs = Counter()
    for t, g in zip(texts, groups, strict=True):
        own = Counter(x.translate(LOWER) for x in TERM.findall(t or ""))
        want.update({(*g, x): n for x, n in own.items()})
        docs.update([(*g, x) for x in own])
    for stretch, held in ((10, 50), (200, 1 << 20), (1 << 20, 10)):
        tally = divergence.Tally(stretch, held)
        n, d = Counter(), Counter()
        for at in range(0, len(texts), 7):
            over = tally.add(texts[at : at + 7], groups[at : at + 7])
            assert over or tally.size <= held
            for batch in tally.drain() if over else ():
                for r in batch.to_pylist():
                    n[r["lang"], r["source"], r["term"]] += r["n"]
                    d[r["lang"], r["source"], r["term"]] += r["docs"]
        for batch in tally.drain():
            for r in batch.to_pylist():
                n[r["lang"], r["source"], r["term"]] += r["n"]
                d[r["lang"], r["source"], r["term"]] += r["docs"]
        assert n == want and d == docs


def test_radix_order_and_rates():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, 2000).astype(np.uint32), rng.integers(0, 1 << 63, 2000).astype(np.uint64) * np.uint64(2)
    assert (divergence.radix_order(a, b) == np.lexsort((b, a))).all()
    c = rng.integers(0, 1 << 50, 500)
    whole = c + rng.integers(1, 1 << 51, 500)
    assert divergence.rates(c, whole).tolist() == [1 + 10**9 * x // y for x, y in zip(c.tolist(), whole.tolist(), strict=True)]


def test_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, term string, n string, docs string, slot string, by string"
    more = ("t", "n", "d", "s", "b")
    rows = [(1, "Alpha beta", "en", "a")] * 10 + [(1, "alpha", "en", "b")] * 3 + [(None, None, "en", None), (2, "", None, "a"), (3, "12 34", "de", "a"), (4, "gamma " * 40_000, "de", "b"), (5, "delta", "fr", "only")]
    frame = spark.createDataFrame([(*r, *more) for r in rows], schema)
    got = rows_of(divergence.audit(frame))
    assert got == brute_force([r[1:] for r in rows])
    assert {(x[0], x[1], x[3]) for x in got if x[2] == "pair"} == {("en", a, b) for a in ("", "a", "b") for b in ("", "a", "b") if a != b} | {("de", "a", "b"), ("de", "b", "a")}
    assert all(x[4] == 0 for x in got if x[0] == "de")
    assert divergence.audit(frame.where("false")).collect() == []
    assert divergence.audit(frame.where(F.col("lang") == "fr")).collect() == []
