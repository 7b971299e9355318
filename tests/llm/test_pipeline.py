"""The pipeline's stages by their effects on planted documents, and its run against brute force."""

from __future__ import annotations

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grainspark.llm import packing
from grainspark.llm.common import documents

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n=60):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(["ba", "ko", "ti", "re", "su", "mo"]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture
def docs(spark):
    rows = [(i, "\n".join([prose(i * 7 + k) for k in range(3)]), "xx", "s", 0) for i in range(1, 31)]
    body = rows[4][1]
    rows += [(101, body, "xx", "s", 0), (102, body.replace(body.split()[10], "other", 1), "xx", "s", 0), (103, "12 34 !!", "xx", "s", 0), (104, None, "xx", "s", 0)]
    return spark.createDataFrame(rows, COLUMNS)


def test_stages_have_effect(spark, docs, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mix_sources", "best_fit_packing"]
    named = corpus_pipeline.language_id(spark, docs, sf_dir)
    assert named.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in named.collect()} == {103, 104}
    lines = corpus_pipeline.line_dedup(spark, named, sf_dir)
    kept = {r.doc_id: r.text for r in lines.collect()}
    assert 101 not in kept and set(range(1, 31)) <= set(kept) and len(kept[102]) < len(kept[5])
    near = corpus_pipeline.near_dedup(spark, named, sf_dir)
    assert near.columns == docs.columns
    assert {r.doc_id for r in named.collect()} - {r.doc_id for r in near.collect()} >= {101}
    assert set(range(1, 31)) <= {r.doc_id for r in near.collect()}


def brute_line_dedup(rows):
    strip = " \t\n\x0b\x0c\r"
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(strip))
    holders = defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == i]
        if len(kept) == len(lines) or "".join(kept).strip(strip):
            out.append((i, "\n".join(kept)))
    return out


def brute_near_dedup(rows):
    def parts(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets, group = [parts(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = min(i, least.get(g, i))
    return [(i, t) for (i, t), g in zip(rows, group, strict=True) if least[g] == i]


def test_run_by_brute_force(spark, sf_dir):
    """Line dedup, near dedup, tokens and cuts are recomputed plainly; the trained stages are held to what they promise."""
    docs = documents(spark, sf_dir)
    named = corpus_pipeline.language_id(spark, docs, sf_dir)
    rows = [(r.doc_id, r.text) for r in named.orderBy("doc_id").collect()]
    every = {r.doc_id: r.text for r in docs.collect()}
    assert all(every[i] == t for i, t in rows) and len(rows) >= 0.9 * sum(1 for t in every.values() if t and any(c.isalpha() for c in t))
    assert all(any(c.isalpha() for c in t) for _, t in rows)
    want = brute_line_dedup(rows)
    lines = corpus_pipeline.line_dedup(spark, named, sf_dir)
    assert sorted((r.doc_id, r.text) for r in lines.collect()) == want
    want = brute_near_dedup(want)
    near = corpus_pipeline.near_dedup(spark, lines, sf_dir)
    assert sorted((r.doc_id, r.text) for r in near.collect()) == want
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = {}
    for i, t in want:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        pieces[i] = sorted((start, n, zlib.crc32(ids[start : start + n].tobytes())) for start, n in packing.cut(len(ids), 2048))
    got, total, ends = defaultdict(list), defaultdict(int), defaultdict(int)
    for r in corpus_pipeline.run(spark, sf_dir).collect():
        got[r.doc_id].append((r.start, r.length, r.ids_crc32))
        total[r.sequence_id] += r.length
        ends[r.sequence_id] = max(ends[r.sequence_id], r.offset + r.length)
    assert total == ends and max(total.values()) <= 2048 and set(got) <= set(pieces)
    for i, found in got.items():
        copies = len(found) // len(pieces[i])
        assert sorted(found) == sorted(pieces[i] * copies) and copies >= 1
    mixed = {r.doc_id: r["count"] for r in corpus_pipeline.mix_sources(spark, near, sf_dir).groupBy("doc_id").count().collect()}
    assert {i: len(found) // len(pieces[i]) for i, found in got.items()} == mixed


def test_awkward_documents(spark, sf_dir):
    """Clashing names, null ids and texts, blank remnants and repeated rows, through all stages."""
    columns = COLUMNS + ", score double, __copy int, row string, n_dropped int, copies string, document string"
    more = (0.5, 1, "mine", 9, "mine", "mine")
    rows = [(i, prose(i, 80), "xx", "s", 0, *more) for i in range(1, 41)]
    rows += [(None, prose(200, 80), "xx", "s", 0, *more), (None, prose(200, 80), "xx", "s", 0, *more), (3, prose(3, 80), "xx", "s", 0, *more), (60, None, "xx", "s", 0, *more), (61, "", None, None, None, *more)]
    rows += [(70, " \t\n\n" + prose(5, 80) + "\n\t \r", "xx", "s", 0, *more), ((1 << 53) + 1, prose(300, 30_000), "xx", "s", 0, *more)]
    docs = spark.createDataFrame(rows, columns).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == [c.split()[0] for c in columns.split(", ")]
        found = docs.collect()
        assert all((r["score"], r["__copy"], r["row"], r["n_dropped"], r["copies"], r["document"]) == more for r in found), name
        ids = [r.doc_id for r in found]
        assert set(range(1, 41)) - {5} <= set(ids) | {5} and (1 << 53) + 1 in ids and None in ids or name == "mix_sources"
        if name == "line_dedup":
            assert 70 not in ids
        if name == "near_dedup":
            assert ids.count(3) == 1 and ids.count(None) == 1
    assert corpus_pipeline.best_fit_packing(spark, docs, sf_dir).count() >= len(found)


def test_empty_documents_table(spark, sf_dir):
    none = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf_dir)
        assert none.count() == 0


def test_mixture_keeps_columns(spark, sf_dir):
    docs = documents(spark, sf_dir)
    mixed = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert mixed.columns == docs.columns and mixed.join(docs, "doc_id", "left_anti").count() == 0
    assert mixed.groupBy("doc_id").count().where(F.col("count") > 5).count() == 0


def test_run_leaves_only_its_result(spark, sf_dir):
    from grainspark.functions.durable import shared_folder

    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = lambda: {s.getPath().getName() for s in files.listStatus(path)} if files.exists(path) else set()
    before = names()
    out = corpus_pipeline.run(spark, sf_dir)
    left = names() - before
    assert out.count() > 0 and len(left) == 1 and {n.split("-")[0] for n in left} == {"pipeline"}
