"""Scoring plans: from a feature frame to score, prediction and label."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamstat.operators.cleaning import fill_columns, with_review_id
from seamstat.operators.enrich import enrich, scoring_frame
from seamstat.operators.rules import recommended_label
from seamstat.schema import ID_COLUMN

# The star ratings of the sensitivity curve.
RATINGS = [1.0, 2.0, 3.0, 4.0, 5.0]
# End of fixed values.

Scorer = Callable[[DataFrame], DataFrame]


def with_outcome(df: DataFrame, margin: Column) -> DataFrame:
    """Append score, prediction and label for a linear margin."""
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))
    scored = df.withColumn("score", score)
    scored = scored.withColumn("prediction", (F.col("score") > 0.5).cast("int"))
    return scored.withColumn("recommended_label", recommended_label(F.col("prediction")))


def linear_score(df: DataFrame, weights: Mapping[str, float], intercept: float) -> DataFrame:
    """Logistic score with given weights over feature columns."""
    margin = F.lit(intercept)
    for name, weight in weights.items():
        margin = margin + F.lit(weight) * F.col(name).cast("double")
    return with_outcome(df, margin)


def batch_score(
    raw: DataFrame,
    scorer: Scorer,
    survey: DataFrame | None = None,
    images: DataFrame | None = None,
    key: str = ID_COLUMN,
) -> DataFrame:
    """Original columns of every row plus prediction, score and label, in one plan."""
    keyed = raw if survey is None and images is None else with_review_id(raw, key)
    # Kept aside under other names, because scoring works on the filled columns.
    packed = keyed.withColumn("raw", F.struct(*[F.col(f"`{c}`") for c in raw.columns]))
    scored = scorer(scoring_frame(packed, survey, images, key))
    return scored.select(
        *[F.col("raw").getField(name).alias(name) for name in raw.columns],
        "prediction",
        "score",
        "recommended_label",
    )


def rating_sensitivity(
    raw: DataFrame,
    scorer: Scorer,
    prepare: Scorer = lambda frame: frame,
    key: str = ID_COLUMN,
) -> DataFrame:
    """Score of each review at every star rating, with default survey and no picture.

    Features and the ``prepare`` step (text vectors) do not depend on the rating, so they
    are computed once per review, before the five ratings are unfolded.
    """
    frame = prepare(enrich(fill_columns(raw)))
    rated = frame.drop("Rating").withColumn(
        "Rating", F.explode(F.array(*[F.lit(r) for r in RATINGS]))
    )
    return scorer(rated).select(key, "Rating", "score")
