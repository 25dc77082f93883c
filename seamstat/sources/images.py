"""Product pictures read through Spark's image source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamstat.operators.image_stats import image_stats


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """JPEG and PNG files below ``path``; files that cannot be decoded keep height -1."""
    reader = spark.read.format("image").option("dropInvalid", False)
    return reader.option("recursiveFileLookup", True).load(path)


def read_image_features(spark: SparkSession, path: str, key: str = "review_id") -> DataFrame:
    """Statistics keyed by the file's base name, e.g. ``.../1234.png`` for review 1234."""
    stats = image_stats(read_images(spark, path))
    name = F.regexp_extract("origin", r"([^/]+?)(\.[^./]*)?$", 1)
    return stats.withColumn(key, name)
