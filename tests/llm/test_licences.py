"""The licence scan against plain Python and SQL: rules, gate, tiers, containment and awkward rows."""

from __future__ import annotations

import random
import re
import re._parser as parser

import pytest

from grainspark.llm import licences, queries
from grainspark.llm.licences import Rule

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_force(text, rules=licences.RULES):
    """(words, base spans, kept spans) of a text: every rule at every word, every pair of matches compared."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = []
    for i, w in enumerate(words):
        window = " ".join(words[i : i + licences.WINDOW]) + " "
        lead = re.match(licences.LEAD, window)
        key = w if w not in licences.LEADS else "+" + (words[i:] + [""])[lead[0].count(" ")] if lead else None
        for r in rules:
            if r.keyword == key and (m := re.search(r.pattern, window)):
                found.append((i, i + m[0].count(" "), r))
    place = lambda x: (x[0], -x[1], -x[2].tier, x[2].no)
    inside = lambda a, b: b[2].tier >= a[2].tier and b[0] <= a[0] and b[1] >= a[1] and place(b) < place(a)
    method = [x for x in found if x[2].tier]
    kept = [x for x in method if not any(inside(x, y) for y in method)]
    spans = lambda xs: [(s, e, r.label, r.no) for s, e, r in sorted(xs, key=place)]
    return len(words), spans([x for x in found if not x[2].tier]), spans(kept)


def scanned(spark, texts, rules=licences.RULES):
    frame = spark.createDataFrame(list(enumerate(texts)), "k long, text string")
    out = {}
    for r in licences.scan(frame, rules=rules).collect():
        out[r.k] = (r.n_words, *([(s.start, s.end, s.label, s.rule) for s in x] for x in (r.base, r.spans)))
    return [out[k] for k in range(len(texts))]


def labels_of(result):
    return ",".join(sorted({x[2] for part in result[1:] for x in part}))


LINES = {
    "All rights reserved.": "reserved",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0",
    "Released under the MIT License.": "mit",
    "Licensed under CC BY-NC 4.0.": "cc-by,cc-by-nc-4.0",
    "GPLv3 or later": "gpl-3.0-or-later",
    "SPDX-License-Identifier: LGPL-2.1-or-later": "lgpl-2.1-or-later",
    "// SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "Creative Commons Attribution-ShareAlike 4.0 International": "cc-by-sa-4.0",
    "https://creativecommons.org/licenses/by-nd/3.0/": "cc-by-nd-3.0",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.": "gpl,gpl-2.0-or-later",
    "Copyright (c) 2019 Somebody. Proprietary and confidential.": "copyright,proprietary",
    "permission to be here was granted, all right? The general public, licensed or not": "",
}


def test_labels_of_notices(spark):
    assert {t: labels_of(r) for t, r in zip(LINES, scanned(spark, list(LINES)), strict=True)} == LINES


def sample(pattern, rng):
    """A text that a rule's regular expression matches."""

    def walk(items):
        return "".join(one(op, arg) for op, arg in items)

    def one(op, arg):
        name = str(op)
        if name == "LITERAL":
            return chr(arg)
        if name == "NOT_LITERAL":
            return "q"
        if name == "IN":
            kind, value = arg[rng.randrange(len(arg))]
            return "q" if str(kind) == "NEGATE" or str(arg[0][0]) == "NEGATE" else chr(value if str(kind) == "LITERAL" else rng.randint(*value))
        if name == "BRANCH":
            return walk(rng.choice(arg[1]))
        if name == "SUBPATTERN":
            return walk(arg[-1])
        if name == "MAX_REPEAT":
            return "".join(walk(arg[2]) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 2))))
        assert name == "AT", name
        return ""

    return walk(parser.parse(pattern)).strip()


def test_the_gate_lets_every_rule_through_and_keywords_begin_matches():
    rng, gate = random.Random(1), re.compile(licences.gate(licences.RULES).replace("(?<![^ ])", "(?:^|(?<= ))"))
    assert len({r.pattern for r in licences.RULES}) >= 300
    tried = 0
    for r in licences.RULES:
        for _ in range(12):
            text = sample(r.pattern, rng)
            assert len(text.split()) < licences.WINDOW
            if re.sub(f"^{licences.LEAD}", "+", text).split(" ")[0] == r.keyword:
                tried += 1
                assert gate.search(text), text
    assert tried > 3 * len(licences.RULES)


def test_query_equals_plain_python_and_sql(spark, sf_dir, duck):
    got = {r.doc_id: tuple(r)[1:7] for r in queries.op12_licence_scan(spark, sf_dir).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        n, base, spans = brute_force(r.text)
        starts = [x[0] for x in base]
        want[r.doc_id] = (n, len(base), min(starts, default=None), max(starts, default=None), labels_of((0, base, [])), labels_of((0, base, spans)))
    assert got == want
    sql = duck.sql(queries.oracle_sql()["op12_licence_scan"])
    at = [sql.columns.index(c) for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels")]
    assert got == {r[at[0]]: tuple(r[k] for k in at[1:]) for r in sql.fetchall()}


def test_texts_full_of_matches(spark):
    rng = random.Random(2)
    texts = [" ".join(sample(rng.choice(licences.RULES).pattern, rng) if rng.random() < 0.6 else rng.choice(["of", "the", "ünï", "12"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    for text, got in zip(texts, scanned(spark, texts), strict=True):
        n, base, spans = brute_force(text)
        assert got == (n, base, spans)


def test_tiers_and_containment(spark):
    rules = [Rule(0, "a", "^(?:a b c d) ", "low", 1, 0.1), Rule(1, "b", "^(?:b c) ", "high", 3, 0.9), Rule(2, "b", "^(?:b c) ", "same", 3, 0.9), Rule(3, "c", "^(?:c) ", "inner", 2, 0.5), Rule(4, "c", "^(?:c d e) ", "cross", 1, 0.2), Rule(5, "d", "^(?:d) ", "base", 0, 0.3)]
    text = "A b, c d. E"
    got = scanned(spark, [text], rules)[0]
    assert got == brute_force(text, rules) == (5, [(3, 4, "base", 5)], [(0, 4, "low", 0), (1, 3, "high", 1), (2, 5, "cross", 4)])


def test_very_many_matches_in_one_text(spark):
    text = "released under the MIT license; cc by\n" * 30_000
    n, base, spans = scanned(spark, [text])[0]
    assert n == 30_000 * 7 and len(base) == len(spans) / 2 == 30_000
    assert spans[0][:3] == (0, 5, "mit") and spans[-1][:3] == (n - 2, n, "cc-by")


@pytest.mark.parametrize("rules", [licences.RULES, licences.RULES[:5]])
def test_awkward_rows(spark, rules):
    schema = "doc_id long, text string, n_words string, base string, spans string, joined string, found string, kept string"
    rows = [(1, None), (1, ""), (None, "...!?"), (2, "CC\x00BY"), (2, "CC\x00BY"), (3, "Kelvin ccé by İ 文字"), (4, "cc  by" + " x" * 200_000)]
    frame = spark.createDataFrame([(*r, *"nbsjfk") for r in rows], schema)
    out = licences.scan(frame, rules=rules)
    assert out.columns == ["doc_id", "text", "joined", "found", "kept", "n_words", "base", "spans"]
    assert sorted(r.n_words for r in out.collect()) == [0, 0, 0, 2, 2, 5, 200_002]
    if rules is licences.RULES:
        assert sorted(len(r.base) for r in out.collect()) == [0, 0, 0, 0, 1, 1, 1]
    assert licences.scan(frame.where("false"), rules=rules).collect() == []
