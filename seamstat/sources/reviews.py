"""Review files: CSV in, scored CSV or parquet out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamstat.functions.partitioning import spread
from seamstat.sources.csv_records import read_csv_records

# Spellings of a missing field in review files (case-sensitive).
MISSING = [
    "", "NA", "N/A", "n/a", "None", "null", "NULL", "NaN", "nan", "-NaN", "-nan", "<NA>",
    "#N/A", "#N/A N/A", "#NA", "1.#IND", "-1.#IND", "1.#QNAN", "-1.#QNAN",
]
# End of fixed values.

_QUOTING = {"header": True, "quote": '"', "escape": '"'}


def missing_to_null(df: DataFrame) -> DataFrame:
    """Null for every spelling of a missing field in string columns."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns(
        {n: F.when(~F.col(f"`{n}`").isin(MISSING), F.col(f"`{n}`")) for n in text}
    )


def read_reviews_csv(
    spark: SparkSession, path: str | list[str], multi_line: bool = True
) -> DataFrame:
    """Every field as text; cleaning decides on types later, so no inference pass is needed.

    Files may have line breaks inside quotes and are still read by many tasks each, after one pass over
    their lines that finds out which of Spark's splits begin inside a field. Set ``multi_line=False``
    where no field has line breaks, to save that pass. A few files are spread over all cores once read.
    """
    if multi_line:
        return missing_to_null(read_csv_records(spark, path))
    reader = spark.read.options(**_QUOTING, enforceSchema=False)
    return missing_to_null(spread(reader.csv(path)))


def write_scored_csv(scored: DataFrame, path: str, mode: str = "overwrite") -> None:
    """UTF-8 with header, quotes doubled, missing and empty fields left empty."""
    scored.write.mode(mode).options(**_QUOTING, emptyValue="", nullValue="").csv(path)


def write_scored_parquet(scored: DataFrame, path: str, mode: str = "overwrite") -> None:
    scored.write.mode(mode).parquet(path)
