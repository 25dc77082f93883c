"""Saving and loading of fitted recommenders on any file system Spark can reach."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from seamstat.plans.training import Recommender
from seamstat.schema import CATEGORICAL_COLUMNS, NUMERIC_COLUMNS

# Layout version of stored models.
MODEL_VERSION = 2
# End of fixed values.


def save_model(model: Recommender, spark: SparkSession, path: str, version: int = MODEL_VERSION) -> None:
    model.text_stages.write().overwrite().save(f"{path}/text")
    model.table_stages.write().overwrite().save(f"{path}/table")
    metadata = {
        "version": version,
        "feature_count": model.feature_count,
        "numeric_columns": NUMERIC_COLUMNS,
        "categorical_columns": CATEGORICAL_COLUMNS,
        "stop_words": model.stop_words,
        "constant_weights": model.constant_weights,
        "bias_shift": model.bias_shift,
    }
    # Last, so that a model without metadata is recognised as incomplete.
    row = spark.createDataFrame([(json.dumps(metadata),)], "value string")
    row.coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load_model(spark: SparkSession, path: str) -> Recommender:
    """A model without a version counts as version 1."""
    try:
        stored = spark.read.text(f"{path}/metadata").first()
    except AnalysisException as error:
        raise FileNotFoundError(f"Model not found: {path}. Train and save one first.") from error
    metadata = json.loads(stored["value"])
    if metadata.get("version", 1) < MODEL_VERSION:
        raise ValueError("Stale model artifact. Train it again.")
    return Recommender(
        text_stages=PipelineModel.load(f"{path}/text"),
        table_stages=PipelineModel.load(f"{path}/table"),
        constant_weights=metadata["constant_weights"],
        bias_shift=metadata["bias_shift"],
        feature_count=metadata["feature_count"],
        stop_words=metadata["stop_words"],
    )
