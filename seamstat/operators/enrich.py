"""Assembly of the model frame: text, image and survey blocks next to the review."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seamstat.operators import survey as sv
from seamstat.operators.cleaning import clean_reviews, fill_columns
from seamstat.operators.text_features import text_features
from seamstat.schema import ID_COLUMN, IMAGE_FEATURES, SURVEY_DEFAULTS


def attach_survey(
    df: DataFrame, survey: DataFrame | Mapping[str, float] | None, key: str = ID_COLUMN
) -> DataFrame:
    """Survey block: from a raw answers table, one encoded record for all rows, or defaults."""
    if isinstance(survey, DataFrame):
        return sv.join_encoded(df, sv.encode_survey(survey), key)
    block = SURVEY_DEFAULTS | dict(survey or {})
    return df.withColumns({name: F.lit(float(block[name])) for name in SURVEY_DEFAULTS})


def attach_images(
    df: DataFrame, images: DataFrame | Mapping[str, float] | None, key: str = ID_COLUMN
) -> DataFrame:
    """Image block: from a statistics table keyed like ``df``, one record, or zeros.

    Keys are read as the type of ``df``'s key; those that do not fit belong to no review
    (``unfit_names`` counts them). Of several pictures of one review the smallest record counts.
    """
    if isinstance(images, DataFrame):
        fitting = images.withColumn(key, F.col(key).try_cast(df.schema[key].dataType))
        joined = df.join(sv.one_per_key(fitting.select(key, *IMAGE_FEATURES), key), key, "left")
        return joined.withColumns(
            {n: F.coalesce(F.col(n), F.lit(0.0)) for n in IMAGE_FEATURES}
        )
    block = dict.fromkeys(IMAGE_FEATURES, 0.0) | dict(images or {})
    return df.withColumns({name: F.lit(float(block[name])) for name in IMAGE_FEATURES})


def unfit_names(images: DataFrame, df: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """How many pictures have a name that cannot be the key of a review."""
    unfit = F.col(key).try_cast(df.schema[key].dataType).isNull()
    return images.agg(F.count_if(unfit).alias("unfit"))


def enrich(
    df: DataFrame,
    survey: DataFrame | Mapping[str, float] | None = None,
    images: DataFrame | Mapping[str, float] | None = None,
    key: str = ID_COLUMN,
) -> DataFrame:
    """Append all 72 engineered columns and the augmented ``text``.

    The joins run before the text block so that the joined rows are narrow: Spark shuffles
    raw reviews, not reviews with 35 more columns.
    """
    joined = attach_images(attach_survey(df, survey, key), images, key)
    return sv.with_augmented_text(text_features(joined))


def model_frame(
    df: DataFrame,
    survey: DataFrame | Mapping[str, float] | None = None,
    images: DataFrame | Mapping[str, float] | None = None,
    key: str = ID_COLUMN,
) -> DataFrame:
    """Clean and enrich: the training view, which keeps only rows with a target."""
    return enrich(clean_reviews(df), survey, images, key)


def scoring_frame(
    df: DataFrame,
    survey: DataFrame | Mapping[str, float] | None = None,
    images: DataFrame | Mapping[str, float] | None = None,
    key: str = ID_COLUMN,
) -> DataFrame:
    """Fill and enrich without dropping rows: a review needs no target to be scored."""
    return enrich(fill_columns(df), survey, images, key)
