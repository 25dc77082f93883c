"""Registered queries of the corpus operators and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from seamstat.llm import (
    html_text,
    language_id,
    lattice_dup,
    mixing,
    near_dup,
    nearest,
    phrases,
    repeated_spans,
    secret_scan,
    sentencepiece_backend,
    token_alignment,
    url_rules,
    warc,
)
from seamstat.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op3_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf, "documents"))


# The rules of the check.
RULES = """
('org', '/', 'allow'),
('example.org', '/es/', 'block'),
('example.org', '/en/1', 'block'),
('com', '/fr/', 'allow'),
('com', '/de/', 'block')
"""
# End of fixed values.


@query
def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rules = spark.sql(f"SELECT * FROM VALUES {RULES} AS rules(host, path, verdict)")
    return url_rules.judge(table(spark, sf, "pages"), rules)


@query
def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = language_id.predict(docs, language_id.fit(docs))
    held_out = language_id.held_out(F.col("doc_id"))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op6_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


@query
def op2_minhash_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.groups(table(spark, sf, "documents"))


@query
def op7_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return sentencepiece_backend.encode(docs, sentencepiece_backend.PieceCodec.load())


@query
def op10_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


@query
def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return repeated_spans.remove(docs)


@query
def op8_embedding_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    return lattice_dup.groups(table(spark, sf, "embeddings"))


@query
def op9_nearest_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return nearest.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0)


@query
def op11_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return token_alignment.alignment(docs, token_alignment.Aligner.load())


@query
def op12_warc(spark: SparkSession, sf: str) -> DataFrame:
    return warc.archived(table(spark, sf, "pages"))


@query
def op13_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return phrases.collocations(table(spark, sf, "documents").select("lang", "text"))


QUERIES["pipeline"] = corpus_pipeline.run
