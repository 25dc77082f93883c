"""Linguistic and visual-language features of (title, review) pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seamstat.functions import lexicons as lex
from seamstat.functions import text as tx
from seamstat.schema import NLP_FEATURES, VISUAL_FEATURES

_TEXT, _LOWER, _MARKS, _WORDS, _KNOWN = "__text", "__lower", "__marks", "__words", "__known"
_STAGED = [_TEXT, _LOWER, _MARKS, _WORDS, _KNOWN]


def _staged(df: DataFrame, title: str, review: str) -> DataFrame:
    """Tokenise once, then keep the few tokens that belong to any word list.

    The short list is what the list counts scan, so the whole token array is walked once
    instead of once for each of the word lists.
    """
    return (
        df.withColumn(_TEXT, tx.combined(F.col(title), F.col(review)))
        .withColumns({_LOWER: F.lower(F.col(_TEXT)), _MARKS: tx.marked_chars(F.col(_TEXT))})
        .withColumn(_WORDS, tx.words(F.col(_LOWER)))
        .withColumn(_KNOWN, tx.only_known(_WORDS, lex.VOCABULARY))
    )


def _linguistic() -> dict[str, Column]:
    text, lowered, words = F.col(_TEXT), F.col(_LOWER), F.col(_WORDS)
    marks = F.col(_MARKS)
    n_words = F.size(words)
    n_chars = F.greatest(F.length(text), F.lit(1))
    unique = F.size(F.array_distinct(words)) / F.greatest(n_words, F.lit(1))
    sentences = tx.sentence_count(text)
    mean_length = F.length(F.array_join(words, "")) / F.nullif(n_words, F.lit(0))
    counted = {n: tx.occurrences(_KNOWN, ws) for n, ws in lex.COUNTED.items() if n in NLP_FEATURES}
    return counted | {
        "nlp_char_count": F.length(text),
        "nlp_word_count": n_words,
        "nlp_sentence_count": sentences,
        "nlp_avg_word_len": F.coalesce(mean_length, F.lit(0.0)),
        "nlp_unique_word_ratio": unique,
        "nlp_exclamation_count": tx.char_count(text, "!"),
        "nlp_question_count": tx.char_count(text, "?"),
        "nlp_uppercase_ratio": tx.chars_left_after(marks, tx.NOT_UPPERCASE) / n_chars,
        "nlp_digit_count": tx.chars_left_after(marks, tx.NOT_DIGIT),
        "nlp_sentiment_net": counted["nlp_sentiment_pos"] - counted["nlp_sentiment_neg"],
        "nlp_recommend_signal": tx.phrases_present(lowered, lex.RECOMMEND_PHRASES),
        "nlp_avg_sentence_len": n_words / sentences,
        "nlp_repetition_ratio": F.lit(1.0) - unique,
        "nlp_emoji_count": tx.chars_left_after(marks, tx.NOT_EMOJI),
        "nlp_hashtag_count": tx.char_count(text, "#"),
    }


def _visual() -> dict[str, Column]:
    lowered = F.col(_LOWER)
    counted = {n: tx.occurrences(_KNOWN, ws) for n, ws in lex.COUNTED.items() if n in VISUAL_FEATURES}
    present = {n: tx.distinct_present(_KNOWN, ws) for n, ws in lex.PRESENT.items()}
    return counted | present | {
        "vis_photo_accuracy_signal": tx.phrases_present(lowered, lex.PHOTO_MATCH_PHRASES)
        - tx.phrases_present(lowered, lex.PHOTO_MISMATCH_PHRASES),
        "vis_multicolor_signal": (counted["vis_color_mentions"] >= 2).cast("int"),
    }


_FRACTIONS = {
    "nlp_avg_word_len", "nlp_unique_word_ratio", "nlp_uppercase_ratio",
    "nlp_avg_sentence_len", "nlp_repetition_ratio",
}


def _typed(name: str, value: Column) -> Column:
    return value.cast("double" if name in _FRACTIONS else "bigint")


def _attach(df: DataFrame, title: str, review: str, names: list[str]) -> DataFrame:
    built = _linguistic() | _visual()
    staged = _staged(df, title, review)
    return staged.withColumns({n: _typed(n, built[n]) for n in names}).drop(*_STAGED)


def nlp_features(df: DataFrame, title: str = "Title", review: str = "Review Text") -> DataFrame:
    """Append the 25 linguistic columns. Works for any pair of text columns."""
    return _attach(df, title, review, NLP_FEATURES)


def visual_text_features(
    df: DataFrame, title: str = "Title", review: str = "Review Text"
) -> DataFrame:
    """Append the 10 visual-language columns."""
    return _attach(df, title, review, VISUAL_FEATURES)


def text_features(df: DataFrame, title: str = "Title", review: str = "Review Text") -> DataFrame:
    """Append both blocks from one tokenisation."""
    return _attach(df, title, review, NLP_FEATURES + VISUAL_FEATURES)
