"""Corpus pipeline: language, near duplicates, benchmark passages, secrets, pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next one's ``docs``. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm import decontaminate, langid, merge_dropout, secrets, simhash
from gleanspark.llm.common import fitted, small_batches
from gleanspark.session import stored

#: A document whose language is less sure than this, or that has none, is rejected.
LEAST_SCORE = 0.25
#: Documents that a task takes at least: a table of many small parts is written in few files.
ROWS_A_TASK = 5_000


def dealt(docs: DataFrame) -> DataFrame:
    return fitted(docs, docs.count(), ROWS_A_TASK)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is recognised, by a model of the labelled ones that are not held out."""
    small_batches(spark)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    found = langid.identify(dealt(docs), model)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, of least id, of each class of near duplicates: five-word shingles, similarity 0.8.

    SimHash makes the first classes, and an exact join finds the links that fingerprints miss.
    """
    small_batches(spark)
    return simhash.keep_one_of_each(dealt(docs), width=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold 0.8 or more of a benchmark item's five-word shingles."""
    small_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontaminate.without_items(dealt(docs), items, shingle=5, threshold=0.8)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays."""
    return secrets.redact(dealt(docs))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text with merge-dropout 0.1."""
    import public_tokenizers

    small_batches(spark)
    return merge_dropout.encode_documents(dealt(docs), public_tokenizers.path("piece_bpe_32k.model"), dropout=0.1, seed=2024)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("pieces", pieces),
]

#: Classifiers, fingerprints and merge-dropout have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
