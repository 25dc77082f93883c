"""Survey answers: encoding, defaults, text tags and per-respondent profiles.

The input is a table keyed by review with one nullable column per answer key. A null means
the question was not answered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamstat.functions import text as tx
from seamstat.functions.rule_tables import first_text
from seamstat.schema import (
    ANSWER_KEYS,
    CHOICE_CODES,
    ID_COLUMN,
    LIKERT_PROFILE,
    SURVEY_DEFAULTS,
    SURVEY_FEATURES,
    SURVEY_PROFILE,
)


def _encoded(answers: DataFrame, key: str) -> Column:
    default = F.lit(SURVEY_DEFAULTS[f"survey_{key}"])
    if key not in answers.columns:
        return default
    answer, dtype = F.col(key), answers.schema[key].dataType
    if key in CHOICE_CODES:
        code = F.lit(0.0)  # an answer outside the list
        for label, number in CHOICE_CODES[key].items():
            code = F.when(answer == label, F.lit(number)).otherwise(code)
    elif isinstance(dtype, T.StringType):
        code = (answer != "").cast("double")  # free text only says that something was given
    else:
        code = answer.cast("double")
    return F.when(answer.isNull(), default).otherwise(code)


def encode_survey(answers: DataFrame, keep_answers: bool = False) -> DataFrame:
    """Replace the answer columns by (or extend them with) 26 numeric ``survey_*`` columns."""
    encoded = answers.withColumns({f"survey_{key}": _encoded(answers, key) for key in ANSWER_KEYS})
    return encoded if keep_answers else encoded.drop(*ANSWER_KEYS)


def survey_defaults(df: DataFrame) -> DataFrame:
    """Append the neutral survey block to every row."""
    return df.withColumns({name: F.lit(value) for name, value in SURVEY_DEFAULTS.items()})


# Tag names and thresholds.
TAG_RULES = [
    [([("survey_return_likelihood", ">=", 0.7)], "high_return_intent")],
    [([("survey_repurchase_likelihood", ">=", 0.7)], "high_repurchase_intent")],
    [([("survey_fit_vs_expectation", "<=", 2)], "poor_fit_experience")],
    [([("survey_color_accuracy", "<=", 2)], "color_mismatch_reported")],
    [([("survey_size_vs_usual", "<", 0)], "runs_small"), ([("survey_size_vs_usual", ">", 0)], "runs_large")],
    [([("survey_photo_uploaded", ">=", 1)], "product_photo_provided")],
]
JOURNEY_STAGES = ["Purchase", "Fit", "Quality", "Logistics", "Recommend"]
JOURNEY_ANSWERS = ["fit_vs_expectation", "material_vs_price", "shipping_satisfaction"]
NEUTRAL_ANSWER, NEUTRAL_INTENT, BEST_ANSWER = 3, 0.5, 5.0
JOURNEY_LINKS = [
    ("Purchase", "Fit", "fit_vs_expectation", 0.1),
    ("Purchase", "Quality", "material_vs_price", 0.1),
    ("Fit", "Logistics", "shipping_satisfaction", 0.1),
    ("Quality", "Intent", "repurchase_likelihood", 0.1),
    ("Logistics", "Intent", "repurchase_likelihood", 0.1),
    ("Intent", "Recommend", "score", 0.05),
]
# End of fixed values.


def survey_tags() -> Column:
    """Space-separated tags for the survey columns of the row, maybe none."""
    inputs = {name: F.col(name) for rules in TAG_RULES for conditions, _ in rules for name, _, _ in conditions}
    return F.concat_ws(" ", *[first_text(rules, inputs) for rules in TAG_RULES])


def with_augmented_text(
    df: DataFrame, title: str = "Title", review: str = "Review Text"
) -> DataFrame:
    """Append ``text``: stripped title and review, then the survey tags."""
    empty = F.lit("")
    return (
        df.withColumn("__joined", tx.combined(F.col(title), F.col(review)))
        .withColumn("__left", tx.left_stripped(F.col("__joined")))
        .withColumn("__base", tx.right_stripped(F.col("__left")))
        .withColumn("__tags", survey_tags())
        .withColumn(
            "text",
            F.concat_ws(" ", F.nullif("__base", empty), F.nullif("__tags", empty)),
        )
        .drop("__joined", "__left", "__base", "__tags")
    )


def _long(df: DataFrame, keep: list[str], entries: list[Column]) -> DataFrame:
    """One output row per struct in ``entries``; narrow, no shuffle."""
    return df.select(*keep, F.inline(F.array(*entries)))


def survey_profile(encoded: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """Ten dimensions as percentages of their caps; empty if fewer than three are present."""
    known = [entry for entry in SURVEY_PROFILE if entry[0] in encoded.columns]
    if len(known) < 3:
        nothing = F.lit(None)
        return encoded.where(F.lit(False)).select(
            key, nothing.cast("string").alias("dimension"), nothing.cast("double").alias("strength")
        )
    return _long(
        encoded,
        [key],
        [
            F.struct(
                F.lit(label).alias("dimension"),
                F.least(
                    F.lit(100.0),
                    F.greatest(F.lit(0.0), F.col(name) / F.lit(cap) * F.lit(100.0)),
                ).alias("strength"),
            )
            for name, label, cap in known
        ],
    )


def survey_likert(answers: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """Five satisfaction scores; unanswered counts as 3."""
    return _long(
        answers,
        [key],
        [
            F.struct(
                F.lit(label).alias("dimension"),
                F.coalesce(F.col(name).cast("double").cast("int"), F.lit(3)).alias("score"),
            )
            for name, label in LIKERT_PROFILE
        ],
    )


def _answer(name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(float(default)))


def _answer_share(name: str) -> Column:
    return _answer(name, NEUTRAL_ANSWER) / F.lit(BEST_ANSWER)


def journey_funnel(scored_answers: DataFrame, keep: list[str]) -> DataFrame:
    """Five stages from purchase to recommendation, as percentages."""
    shares = [F.lit(1.0), *map(_answer_share, JOURNEY_ANSWERS), F.col("score")]
    stages = [(stage, share * F.lit(100.0)) for stage, share in zip(JOURNEY_STAGES, shares, strict=True)]
    return _long(
        scored_answers,
        keep,
        [
            F.struct(F.lit(i).alias("ord"), F.lit(stage).alias("stage"), value.alias("value"))
            for i, (stage, value) in enumerate(stages, start=1)
        ],
    )


def journey_by_segment(scored_answers: DataFrame, segment: str = "Department Name") -> DataFrame:
    """Average funnel per segment.

    The wide averages are taken before the stages are unfolded, so the shuffle carries one
    row per segment and task.
    """
    wide = scored_answers.groupBy(segment).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.avg(_answer(name, NEUTRAL_ANSWER)).alias(name)
            for name in JOURNEY_ANSWERS
        ],
        F.avg("score").alias("score"),
    )
    return journey_funnel(wide, [segment, "n"])


def journey_links(scored_answers: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """Six weighted edges of the survey path."""
    values = {name: _answer_share(name) for name in JOURNEY_ANSWERS} | {
        "repurchase_likelihood": _answer("repurchase_likelihood", NEUTRAL_INTENT),
        "score": F.col("score"),
    }
    return _long(
        scored_answers,
        [key],
        [
            F.struct(
                F.lit(source).alias("source"),
                F.lit(target).alias("target"),
                F.greatest(F.lit(floor), values[name]).alias("value"),
            )
            for source, target, name, floor in JOURNEY_LINKS
        ],
    )


def intent_gauges(scored_answers: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """Three gauges in percent, and the (return, repurchase, fit) retention point."""
    return scored_answers.select(
        key,
        (F.col("score") * 100.0).alias("recommend_gauge"),
        (_answer("repurchase_likelihood", 0.5) * 100.0).alias("repurchase_gauge"),
        ((1.0 - _answer("return_likelihood", 0.2)) * 100.0).alias("retention_gauge"),
        _answer("return_likelihood", 0.15).alias("return_risk"),
        _answer("repurchase_likelihood", 0.5).alias("repurchase_intent"),
        _answer("fit_vs_expectation", 3).alias("fit_satisfaction"),
    )


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """Of several rows of one key, the smallest by its other columns in order; nulls come first.

    The join that follows uses the same partitioning by key, so this costs no further shuffle.
    """
    others = [F.col(f"`{c}`") for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*others)).alias("__first")).select(key, "__first.*")


def answers_for(df: DataFrame, answers: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """Left-join raw answers, one record for each review; reviews without any keep nulls."""
    known = [name for name in ANSWER_KEYS if name in answers.columns]
    missing = {name: F.lit(None).cast("double") for name in ANSWER_KEYS if name not in known}
    joined = df.join(one_per_key(answers.select(key, *known), key), key, "left")
    return joined.withColumns(missing) if missing else joined


def join_encoded(df: DataFrame, encoded: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """Left-join the encoded block, one record for each review; others get the defaults."""
    joined = df.join(one_per_key(encoded.select(key, *SURVEY_FEATURES), key), key, "left")
    return joined.withColumns(
        {n: F.coalesce(F.col(n), F.lit(v)) for n, v in SURVEY_DEFAULTS.items()}
    )
