"""Corpus pipeline: documents to packed training sequences, in stages that are each written and read again.

Special cases: a null text or one without a letter is of no language and goes; very long texts are read whole by every stage and cut
by packing alone; rows that repeat an id are one document: they are kept or dropped together as a near-duplicate and by the
benchmark, and packed each; of near-duplicates the smallest id stays, so copies that tie leave one; a row without an id can't be
named, so only its language can drop it; an empty table gives an empty result; further columns go along to the last stage,
whatever their names.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_file
from pyspark.sql import DataFrame, SparkSession

from lumenqc.llm import decontam, language, packing, secret_scan, simhash
from lumenqc.llm.common import discard, new_path, table, written

#: A document goes if no language takes at least this share of the likelihood, or if it has no letter.
LEAST_SCORE = 0.5
#: It goes too if its letters are less likely than this in the best language (mean log-likelihood).  At sf0.01 learned
#: languages reach -2.36 to -1.22; with one of the four left out of the training, 99 of 100 of its texts are under -2.9.
LEAST_FIT = -2.6
#: Rows and bytes of the batches that Spark hands to Python.  Whole documents go along: in batches of the usual 10,000 rows, the
#: buffers of both sides take some 100 MB more a task.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batches to ``BATCH``; so they stay, as a stage's rows are made only when they are asked for."""
    for key, most in BATCH.items():
        spark.conf.set(key, most)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no recognisable language go.  The model learns from the labelled documents given; without any, all stay."""
    small_batches(spark)
    model = language.train(docs, tokenizer_file("piece_bpe_32k.model"))
    return language.keep_known(docs, model, LEAST_SCORE, fit=LEAST_FIT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays."""
    small_batches(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by their kind; every document stays."""
    small_batches(spark)
    return secret_scan.redact_secrets(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids by piece, each with its place in the sequences of 4096."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language id", language_id),
    ("simhash near-duplicates", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scan", secrets),
    ("best-fit packing", best_fit_packing),
]

#: Language models, fingerprints and tokenizers have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table documents.  A stage's table is deleted once the next one is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        docs = written(stage(spark, docs, sf_dir), name, path)
        if last:
            discard(spark, last)
        last = path
    return docs
