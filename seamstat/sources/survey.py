"""Survey answer tables: parquet, JSON or CSV, one row per review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from seamstat.schema import ANSWER_KINDS, ID_COLUMN

_TYPES = {
    "choice": T.StringType(),
    "bool": T.BooleanType(),
    "days": T.LongType(),
    "count": T.LongType(),
    "likert5": T.LongType(),
    "durability": T.LongType(),
    "hours": T.DoubleType(),
    "pct": T.DoubleType(),
}


def answer_schema(key: str = ID_COLUMN, key_type: T.DataType | None = None) -> T.StructType:
    """Key plus the 26 nullable answers in question order."""
    fields = [T.StructField(key, key_type or T.LongType())]
    return T.StructType(fields + [T.StructField(n, _TYPES[k]) for n, k in ANSWER_KINDS.items()])


def read_survey_answers(
    spark: SparkSession, path: str, file_format: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    reader = spark.read.schema(schema or answer_schema())
    if file_format == "csv":
        reader = reader.options(header=True, escape='"')
    return reader.format(file_format).load(path)
