"""Segment analytics over cleaned or scored reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamstat.functions.quantiles import quantiles_of_counts
from seamstat.schema import (
    AGE_BINS,
    CATEGORICAL_COLUMNS,
    ID_COLUMN,
    TARGET_COLUMN,
)

# Sizes and seeds of the reports.
MARKET_SAMPLE, MARKET_SEED = 2500, 42
BATCH_SAMPLE, BATCH_SEED = 500, 0
TOP_DEPARTMENTS = 8
LANDSCAPE_DEPARTMENTS = 12
HISTOGRAM_BINS = 20
PREVIEW_ROWS = 20
# End of fixed values.


def corpus_kpis(reviews: DataFrame) -> DataFrame:
    return reviews.agg(
        F.count(F.lit(1)).alias("reviews"),
        F.avg(TARGET_COLUMN).alias("recommend_rate"),
        F.avg("Rating").alias("avg_rating"),
    )


def _volume_and_rate(reviews: DataFrame, *by: str) -> DataFrame:
    return reviews.groupBy(*by).agg(
        F.count(TARGET_COLUMN).alias("reviews"), F.avg(TARGET_COLUMN).alias("recommend")
    )


def catalog_hierarchy(reviews: DataFrame) -> DataFrame:
    """Volume and recommend rate of each division / department / class."""
    return _volume_and_rate(reviews, *CATEGORICAL_COLUMNS)


def catalog_rollup(reviews: DataFrame) -> DataFrame:
    """The hierarchy with its parent totals; ``level`` counts the named columns.

    Rolled up from the leaf totals, so the reviews themselves are never multiplied.
    """
    leaves = reviews.groupBy(*CATEGORICAL_COLUMNS).agg(
        F.count(TARGET_COLUMN).alias("n"), F.sum(TARGET_COLUMN).alias("positive")
    )
    named = [1 - F.grouping(c) for c in CATEGORICAL_COLUMNS]
    level = sum(named[1:], named[0])
    return leaves.rollup(*CATEGORICAL_COLUMNS).agg(
        level.cast("int").alias("level"),
        F.sum("n").alias("reviews"),
        (F.sum("positive") / F.nullif(F.sum("n"), F.lit(0))).alias("recommend"),
    )


def department_volume(reviews: DataFrame) -> DataFrame:
    return _volume_and_rate(reviews, "Department Name")


def _age_bin() -> Column:
    label = F.lit(None).cast("string")
    for name, low, high in AGE_BINS:
        label = F.when((F.col("Age") > low) & (F.col("Age") <= high), name).otherwise(label)
    return label


def age_rating(reviews: DataFrame) -> DataFrame:
    """Recommend rate per age cohort and rating, one row each; ages over 100 fall outside."""
    binned = reviews.where(F.col("Age") > 0).withColumn("age_bin", _age_bin())
    return (
        binned.where(F.col("age_bin").isNotNull())
        .groupBy("age_bin", "Rating")
        .agg(F.avg(TARGET_COLUMN).alias("recommend"))
    )


def age_rating_pivot(reviews: DataFrame, ratings: list[float]) -> DataFrame:
    """The same as a grid with one column per given rating."""
    cells = age_rating(reviews)
    return cells.groupBy("age_bin").agg(
        *[
            F.max(F.when(F.col("Rating") == r, F.col("recommend"))).alias(f"rating_{r:g}")
            for r in ratings
        ]
    )


def department_landscape(reviews: DataFrame) -> DataFrame:
    """Averages of the first departments by name that have a known age."""
    return (
        reviews.groupBy("Department Name")
        .agg(
            F.avg("Rating").alias("avg_rating"),
            F.avg("Age").alias("avg_age"),
            F.avg(TARGET_COLUMN).alias("recommend"),
            F.count(TARGET_COLUMN).alias("n"),
        )
        .where(F.col("avg_age") > 0)
        .orderBy("Department Name")
        .limit(LANDSCAPE_DEPARTMENTS)
    )


def department_rating_box(reviews: DataFrame) -> DataFrame:
    """Rating distribution per outcome in the departments with most reviews."""
    by = ["Department Name", TARGET_COLUMN]
    # The reviews are read once; all that follows works on counts by rating.
    counts = reviews.groupBy(*by, "Rating").agg(F.count(F.lit(1)).alias("n"))
    top = (
        counts.groupBy("Department Name")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "Department Name")
        .limit(TOP_DEPARTMENTS)
        .select("Department Name")
    )
    # Broadcast of at most TOP_DEPARTMENTS names.
    counts = counts.join(F.broadcast(top), "Department Name", "left_semi")
    quartiles = quantiles_of_counts(counts, by, "Rating", "n", [0.25, 0.5, 0.75])
    q = {p: F.max(F.when(F.col("q") == p, F.col("Rating"))) for p in (0.25, 0.5, 0.75)}
    boxes = quartiles.groupBy(*by).agg(
        q[0.25].alias("q1"), q[0.5].alias("median"), q[0.75].alias("q3")
    )
    joined = counts.join(boxes, by)
    reach = (F.col("q3") - F.col("q1")) * 1.5
    outside = (F.col("Rating") < F.col("q1") - reach) | (F.col("Rating") > F.col("q3") + reach)
    return joined.groupBy(*by, "q1", "median", "q3").agg(
        F.sum("n").alias("n"),
        F.min("Rating").alias("lowest"),
        F.max("Rating").alias("highest"),
        F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outliers"),
    )


def shuffled(df: DataFrame, size: int, seed: int, key: str = ID_COLUMN) -> DataFrame:
    """A repeatable sample of at most ``size`` rows, in hash order of the key.

    Sort and limit become one top-k per task, so at most ``size`` rows leave each of them.
    """
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return df.orderBy(order, key).limit(size)


def market_sample(reviews: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """The market scatter: a sample first, then only rows with a known age."""
    sample = shuffled(reviews, MARKET_SAMPLE, MARKET_SEED, key).where(F.col("Age") > 0)
    return sample.select(key, "Age", "Rating", "Positive Feedback Count", TARGET_COLUMN)


def batch_sample(scored: DataFrame, key: str = ID_COLUMN) -> DataFrame | None:
    """The batch scatter; none for files without a rating."""
    if "Rating" not in scored.columns:
        return None
    sample = shuffled(scored, BATCH_SAMPLE, BATCH_SEED, key)
    return sample.select(key, "Rating", "score", "prediction", "recommended_label")


def random_review(reviews: DataFrame, seed: int, key: str = ID_COLUMN) -> DataFrame:
    return shuffled(reviews, 1, seed, key)


def batch_kpis(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg((F.col("prediction") == 1).cast("double")).alias("recommend_rate"),
        F.avg("score").alias("avg_score"),
    )


def score_histogram(scored: DataFrame) -> DataFrame:
    """Counts of scores in 20 equal bins per predicted label."""
    slot = F.least(F.floor(F.col("score") * HISTOGRAM_BINS), F.lit(HISTOGRAM_BINS - 1))
    return scored.groupBy("recommended_label", slot.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


def category_options(reviews: DataFrame) -> DataFrame:
    """Distinct values of the category columns in one scan; absent columns offer Unknown."""
    entries = [
        F.struct(
            F.lit(name).alias("field"),
            (F.col(name).cast("string") if name in reviews.columns else F.lit("Unknown")).alias(
                "option"
            ),
        )
        for name in CATEGORICAL_COLUMNS
    ]
    options = reviews.select(F.inline(F.array(*entries)))
    return options.where(F.col("option").isNotNull()).distinct()


def batch_preview(scored: DataFrame, rows: int = PREVIEW_ROWS, key: str = ID_COLUMN) -> DataFrame:
    """The output columns of the first rows by key."""
    wanted = ["recommended_label", "score", "business_emoji", "local_ai_insight"]
    first = scored.orderBy(key).limit(rows)
    return first.select(key, *[c for c in wanted if c in scored.columns])
