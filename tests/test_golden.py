"""Literal values for the three presets, counted by hand from their texts."""

import pytest
from pyspark.sql import functions as F

from seamstat.operators.rules import recommended_label
from seamstat.operators.text_features import text_features
from seamstat.schema import SURVEY_DEFAULTS

GOLDEN = [
    {"nlp_char_count": 165, "nlp_word_count": 27, "nlp_sentence_count": 2, "nlp_unique_word_ratio": 24 / 27, "nlp_sentiment_pos": 3,
     "nlp_sentiment_neg": 0, "nlp_intensifier_count": 1, "nlp_negation_count": 0, "nlp_first_person_count": 3, "nlp_fit_mentions": 3,
     "nlp_quality_mentions": 2, "nlp_price_mentions": 0, "nlp_avg_sentence_len": 13.5},
    {"nlp_char_count": 143, "nlp_word_count": 23, "nlp_sentence_count": 3, "nlp_unique_word_ratio": 20 / 23, "nlp_sentiment_pos": 1,
     "nlp_sentiment_neg": 2, "nlp_intensifier_count": 1, "nlp_negation_count": 2, "nlp_first_person_count": 0, "nlp_fit_mentions": 3,
     "nlp_quality_mentions": 2, "nlp_price_mentions": 2, "nlp_avg_sentence_len": 23 / 3},
    {"nlp_char_count": 80, "nlp_word_count": 13, "nlp_sentence_count": 2, "nlp_unique_word_ratio": 12 / 13, "nlp_sentiment_pos": 1,
     "nlp_sentiment_neg": 0, "nlp_intensifier_count": 0, "nlp_negation_count": 1, "nlp_first_person_count": 0, "nlp_fit_mentions": 0,
     "nlp_quality_mentions": 0, "nlp_price_mentions": 2, "nlp_avg_sentence_len": 6.5},
]


def test_presets_have_the_counted_features(presets):
    for row in text_features(presets).collect():
        want = GOLDEN[row["review_id"]]
        assert {name: row[name] for name in want} == pytest.approx(want, abs=1e-9)


def test_labels_and_neutral_answers(spark):
    found = spark.createDataFrame([(1,), (0,), (None,)], "p int").select(recommended_label(F.col("p")))
    assert [r[0] for r in found.collect()] == ["Recommended", "Not recommended", None]
    assert len(SURVEY_DEFAULTS) == 26
    assert SURVEY_DEFAULTS["survey_return_likelihood"] == 0.2 and SURVEY_DEFAULTS["survey_days_since_purchase"] == 14.0
    assert SURVEY_DEFAULTS["survey_care_difficulty"] == 0.3 and SURVEY_DEFAULTS["survey_fit_vs_expectation"] == 3.0
