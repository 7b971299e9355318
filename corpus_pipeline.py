"""A corpus pipeline of five operators; each stage reads what the one before wrote.

All stages: columns beside those of documents are carried along, whatever their names; an empty table gives an empty
one; rows that repeat a document are separate rows until near_dedup keeps one of them.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainspark.functions.durable import delete_folder, shared_folder, temporary
from grainspark.llm import langid, linededup, mixing, nearcopies, packing
from grainspark.llm.common import documents, fresh, named
from grainspark.llm.queries import TARGETS, domain_of_labels

#: A document is rejected where no language is recognised or another one is likelier than the one named.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters or without a language that is likelier than not.

    The model learns from all rows with text, lang and doc_id; null texts have no letter. Without any label nothing
    is recognised and every document is rejected.
    """
    model = langid.train(docs, F.lit(True))
    name, score = fresh(docs.columns, "lang_pred", "score")
    found = langid.predict(docs, model, names=(name, score))
    return found.where((named(name) != langid.UNKNOWN) & (named(score) >= MIN_LANGUAGE_SCORE)).select(*(named(c) for c in docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines stay in the document of the smallest id only; n_chars follows the text.

    Documents of whose lines all that is not white space went elsewhere are copies and go; a document that lost
    nothing stays, even if it is empty. Null ids come after all others.
    """
    dropped, total = fresh(docs.columns, "n_dropped", "n_lines")
    renamed = docs.withColumnsRenamed({c: n for c, n in (("n_dropped", dropped), ("n_lines", total)) if c in docs.columns})
    found = linededup.dedup_lines(renamed).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    back = found.drop("n_dropped", "n_lines").withColumnsRenamed({dropped: "n_dropped", total: "n_lines"})
    return back.withColumn("n_chars", F.char_length("text").cast("long")).select(*(named(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, similarity of at least 0.8.

    It is the one of the smallest id, null ids last, then of the smallest text hash, then the first stored row; so of
    rows that repeat an id or have none one stays for each group too.
    """
    rows, groups, row = nearcopies.grouped_rows(docs)
    order = F.struct(F.col("id").isNull(), "id", "h", "row")
    keys = rows.select(named(row).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    kept = keys.join(groups, "row").groupBy("group").agg(F.min(order).alias("first")).select(F.col("first.row").alias(row))
    return rows.join(kept, row, "left_semi").select(*(named(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in as many copies as their rate asks for; the mixture has as many tokens as came in.

    Null and empty texts have rate 1; labels of unknown ids and null labels teach nothing; without labels every rate is 1.
    """
    model = mixing.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), domain_of_labels())
    base = docs.select("doc_id", "text", F.struct(*(named(c) for c in docs.columns)).alias("document"))
    mixed = mixing.mix(base, model, TARGETS).where("copies > 0")
    return mixed.select("document", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("document.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture's pieces in sequences of 2048 tokens; a null or empty text is one piece of one token."""
    packed = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mix_sources", mix_sources),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot express the trained stages; a test holds run() against a brute-force version of the others.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. Tables inside and between stages lie in the cluster's shared checkpoint folder until the next stage is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES:
        with temporary(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{name}"
    return docs
