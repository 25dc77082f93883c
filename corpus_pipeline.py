"""A training corpus from raw documents: language, duplicates, secrets, mixture, tokens.

``STAGES`` lists (name, function); each function takes (spark, docs, folder of the tables) and
returns what goes on. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seamstat.llm import language_id, mixing, near_dup, secret_scan, sentencepiece_backend
from seamstat.sources.scratch import stored


ROWS_AT_ONCE = 1000  # of whole texts that go to a Python worker in one batch


def _long_rows(spark: SparkSession) -> None:
    """Texts are long rows: batches of Spark's usual 10,000 of them would take most of a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ROWS_AT_ONCE))


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; those without a letter or a clear language go."""
    _long_rows(spark)
    return language_id.keep_known(docs, language_id.fit(docs))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    _long_rows(spark)
    return near_dup.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked by their kind."""
    _long_rows(spark)
    return secret_scan.mask(docs, secret_scan.fit(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of the sources takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, checked for parity and round trip."""
    _long_rows(spark)
    return sentencepiece_backend.encode(docs, sentencepiece_backend.PieceCodec.load())


STAGES = [
    ("language_id", known_language),
    ("near_dedup", one_of_each),
    ("secret_scan", without_secrets),
    ("mix_sources", mixed_sources),
    ("sentencepiece", tokens),
]

#: Fitted models and lattices of hashes have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
