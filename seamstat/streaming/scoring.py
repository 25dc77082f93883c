"""Scoring of review files as they arrive.

Every step of the scoring plan works on one row at a time, so the batch plan runs unchanged
on a stream and keeps no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from seamstat.operators.rules import batch_signals
from seamstat.plans.scoring import Scorer, batch_score
from seamstat.sources.reviews import missing_to_null


def review_stream(spark: SparkSession, folder: str, columns: list[str]) -> DataFrame:
    """New CSV files in ``folder``, every field as text."""
    schema = T.StructType([T.StructField(name, T.StringType()) for name in columns])
    reader = spark.readStream.schema(schema).options(header=True, escape='"', multiLine=True)
    return missing_to_null(reader.csv(folder))


def score_stream(reviews: DataFrame, scorer: Scorer, out: str, progress: str) -> StreamingQuery:
    """Score everything that has arrived and append it to ``out`` exactly once."""
    scored = batch_signals(batch_score(reviews, scorer))
    writer = scored.writeStream.format("parquet").outputMode("append")
    return writer.option("checkpointLocation", progress).trigger(availableNow=True).start(out)
