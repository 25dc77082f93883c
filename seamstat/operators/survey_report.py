"""The readable survey report: one row per respondent and question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seamstat.functions.numeric import fixed, percent
from seamstat.schema import (
    DURABILITY_LABELS,
    ID_COLUMN,
    LIKERT_LABELS,
    SURVEY_SECTIONS,
)

# How each kind of encoded column is shown.
UNANSWERED = "—"
CODE_LABELS = {
    "survey_purchase_channel": {0.0: "Online", 1.0: "In-store", 2.0: "Gift"},
    "survey_size_vs_usual": {-1.0: "Runs small", 0.0: "True to size", 1.0: "Runs large"},
}
CODE_DIGITS = {"survey_purchase_channel": 0, "survey_size_vs_usual": 1}
SHARE_COLUMNS = """
survey_return_likelihood survey_repurchase_likelihood survey_occasion_formality
survey_season_match survey_care_difficulty survey_sustainability_importance
survey_price_sensitivity survey_brand_loyalty
""".split()
YES_NO_COLUMNS = """
survey_first_time_buyer survey_compared_alternatives survey_alterations_needed
survey_odor_issue survey_support_contact survey_gift_purchase survey_photo_uploaded
""".split()
UNIT_COLUMNS = {
    "survey_days_since_purchase": (0, " days"),
    "survey_comfort_hours": (1, " h"),
    "survey_worn_before_review": (0, " wears"),
}
# End of fixed values.



def _labelled(value: Column, labels: dict, other: Column) -> Column:
    shown = other
    for code, label in labels.items():
        shown = F.when(value == F.lit(code), F.lit(label)).otherwise(shown)
    return shown


def _truth(answer: Column, dtype: T.DataType) -> Column:
    """Yes-or-no reading of an answer as 1 or 0."""
    if isinstance(dtype, T.StringType):
        return (answer != "").cast("double")
    return (answer.cast("double") != 0.0).cast("double")


def _by(name: Column, cases: dict[str, Column], other: Column) -> Column:
    chosen = other
    for key, shown in cases.items():
        chosen = F.when(name == key, shown).otherwise(chosen)
    return chosen


def shown_answer(kind: Column, number: Column, text: Column) -> Column:
    """A raw answer as text, by kind of question; ``—`` where it is missing."""
    whole = number.cast("bigint")
    shown = _by(
        kind,
        {
            "bool": F.when(number == 1.0, "Yes").otherwise("No"),
            "likert5": _labelled(whole, LIKERT_LABELS, text),
            "durability": _labelled(whole, DURABILITY_LABELS, text),
            "pct": percent(number, 0),
            "hours": F.concat(fixed(number, 1), F.lit(" h")),
            "days": F.concat(whole.cast("string"), F.lit(" days")),
            "count": F.concat(whole.cast("string"), F.lit(" times")),
        },
        text,
    )
    return F.when(text.isNull(), F.lit(UNANSWERED)).otherwise(shown)


def code_style(name: str) -> str:
    """Which of the styles of ``shown_code`` an encoded column uses."""
    if name in CODE_LABELS or name in UNIT_COLUMNS:
        return name
    if name in SHARE_COLUMNS:
        return "share"
    return "yes_no" if name in YES_NO_COLUMNS else "likert"


def shown_code(style: Column, value: Column) -> Column:
    """An encoded value as text."""
    likert = {float(code): label for code, label in LIKERT_LABELS.items()}
    cases = {
        "share": F.when(value <= 1, percent(value, 0)).otherwise(fixed(value, 2)),
        "yes_no": F.when(value >= 0.5, "Yes").otherwise("No"),
    }
    for name, labels in CODE_LABELS.items():
        cases[name] = _labelled(value, labels, fixed(value, CODE_DIGITS[name]))
    for name, (digits, unit) in UNIT_COLUMNS.items():
        cases[name] = F.concat(fixed(value, digits), F.lit(unit))
    return _by(style, cases, _labelled(value, likert, fixed(value, 3)))


def survey_report(wide: DataFrame, key: str = ID_COLUMN) -> DataFrame:
    """26 rows per respondent, from raw answers and their encoded columns side by side.

    Answers are unfolded first and formatted afterwards, so the generated code holds each
    format once and not once per question.
    """
    entries = []
    for section, fields in SURVEY_SECTIONS.items():
        for question_key, question, kind in fields:
            name, answer = f"survey_{question_key}", F.col(question_key)
            dtype = wide.schema[question_key].dataType
            number = F.lit(None) if kind == "choice" else answer
            entries.append(
                F.struct(
                    F.lit(len(entries) + 1).alias("ord"),
                    F.lit(section).alias("section"),
                    F.lit(question).alias("question"),
                    F.lit(kind).alias("kind"),
                    (_truth(answer, dtype) if kind == "bool" else number.cast("double")).alias(
                        "number"
                    ),
                    answer.cast("string").alias("text"),
                    F.lit(code_style(name)).alias("style"),
                    F.col(name).cast("double").alias("code"),
                    F.lit(name).alias("feature"),
                )
            )
    long = wide.select(key, F.inline(F.array(*entries)))
    return long.select(
        key,
        "ord",
        "section",
        "question",
        shown_answer(F.col("kind"), F.col("number"), F.col("text")).alias("answer"),
        shown_code(F.col("style"), F.col("code")).alias("signal"),
        "feature",
    )


def section_counts(report: DataFrame) -> DataFrame:
    """Questions and report rows per section.

    Questions repeat for every respondent, so they are counted per question first and the
    distinct count is taken over at most 26 rows.
    """
    per_question = report.groupBy("section", "question").agg(F.count(F.lit(1)).alias("n"))
    return per_question.groupBy("section").agg(
        F.count(F.lit(1)).alias("questions"), F.sum("n").alias("answers")
    )
