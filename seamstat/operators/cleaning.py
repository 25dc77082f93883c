"""Cleaning of raw review tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamstat.functions.numeric import number_or_zero
from seamstat.schema import (
    CATEGORICAL_COLUMNS,
    CORE_NUMERIC_COLUMNS,
    FORM_COLUMNS,
    ID_COLUMN,
    TARGET_COLUMN,
    TEXT_COLUMNS,
)


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise KeyError(f"review table lacks columns: {', '.join(missing)}")


def fill_columns(df: DataFrame) -> DataFrame:
    """Fill and coerce text, numeric and category columns; keeps every row."""
    require_columns(df, TEXT_COLUMNS + CORE_NUMERIC_COLUMNS + CATEGORICAL_COLUMNS)
    filled = {name: F.coalesce(F.col(name).cast("string"), F.lit("")) for name in TEXT_COLUMNS}
    for name in CORE_NUMERIC_COLUMNS:
        filled[name] = number_or_zero(F.col(name), df.schema[name].dataType)
    for name in CATEGORICAL_COLUMNS:
        filled[name] = F.coalesce(F.col(name).cast("string"), F.lit("Unknown"))
    return df.withColumns(filled)


def clean_reviews(df: DataFrame) -> DataFrame:
    """``fill_columns`` plus, where a target exists, only rows that have one, as integer."""
    filled = fill_columns(df)
    if TARGET_COLUMN not in df.columns:
        return filled
    target = F.col(TARGET_COLUMN).cast("double")
    return filled.where(target.isNotNull() & ~F.isnan(target)).withColumn(
        TARGET_COLUMN, target.cast("int")
    )


def from_form(entries: DataFrame) -> DataFrame:
    """A table of form entries with the names of the review columns; further columns stay."""
    missing = [name for name in FORM_COLUMNS if name not in entries.columns]
    if missing:
        raise KeyError(f"form entries lack fields: {', '.join(missing)}")
    return entries.withColumnsRenamed(FORM_COLUMNS)


def with_review_id(df: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """Give a table without a key one made from the row's content.

    A content hash survives recomputation on another executor, which numbering rows by
    partition does not when the input is split differently.
    """
    if key in df.columns:
        return df
    content = F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns]))
    return df.withColumn(key, F.md5(content))
