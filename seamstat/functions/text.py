"""Column expressions over free text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes that define the counts.
WORD = r"[a-zA-Z']+"
# Starts at the first visible character of a sentence and runs to its end mark, so the
# number of matches is the number of non-blank sentences, found in one linear scan.
SENTENCE = r"(?U)[^\s\x1c-\x1f.!?][^.!?]*"
NOT_UPPERCASE = r"\P{IsUppercase}+"
# ASCII without capitals and digits: characters no class below can match.
PLAIN = r"[\x00-/:-@\[-\x7F]+"
# Decimal digits plus the superscript, circled and ancient digit characters.
NOT_DIGIT = (
    r"[^\p{Nd}\x{B2}-\x{B3}\x{B9}\x{1369}-\x{1371}\x{19DA}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247C}\x{2488}-\x{2490}\x{24EA}"
    r"\x{24F5}-\x{24FD}\x{24FF}\x{2776}-\x{277E}\x{2780}-\x{2788}\x{278A}-\x{2792}"
    r"\x{10A40}-\x{10A43}\x{10E60}-\x{10E68}\x{11052}-\x{1105A}\x{1F100}-\x{1F10A}]+"
)
NOT_EMOJI = r"[^\x{2601}-\x{27BE}]+"
BLANK = r"(?U)[\s\x1c-\x1f]"
LEADING_BLANKS = r"(?U)^[\s\x1c-\x1f]++"
TRAILING_BLANKS = r"(?U)(?<![\s\x1c-\x1f])[\s\x1c-\x1f]++\z"
# End of fixed values.


def combined(title: Column, review: Column) -> Column:
    """Title, one space, review; missing parts count as empty."""
    return F.concat(
        F.coalesce(title.cast("string"), F.lit("")),
        F.lit(" "),
        F.coalesce(review.cast("string"), F.lit("")),
    )


def words(lowered: Column) -> Column:
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def sentence_count(text: Column) -> Column:
    return F.greatest(F.regexp_count(text, F.lit(SENTENCE)), F.lit(1))


def marked_chars(text: Column) -> Column:
    """The few characters that can be capitals, digits or symbols, found in one fast scan."""
    return F.regexp_replace(text, PLAIN, "")


def chars_left_after(text: Column, removed: str) -> Column:
    """Characters that remain once every run matching ``removed`` is cut out."""
    return F.length(F.regexp_replace(text, removed, ""))


def char_count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _quoted(values: Iterable[str]) -> str:
    return ", ".join('"' + value + '"' for value in values)


# Word lists are passed as one SQL text: one call to the JVM instead of one per word.


def only_known(tokens: str, vocabulary: Iterable[str]) -> Column:
    return F.expr(f"filter({tokens}, word -> word IN ({_quoted(vocabulary)}))")


def occurrences(tokens: str, vocabulary: Iterable[str]) -> Column:
    return F.size(only_known(tokens, vocabulary))


def distinct_present(tokens: str, vocabulary: Iterable[str]) -> Column:
    return F.expr(f"size(array_intersect(array({_quoted(vocabulary)}), {tokens}))")


def phrases_present(lowered: Column, phrases: Iterable[str]) -> Column:
    hits = [F.contains(lowered, F.lit(p)).cast("int") for p in phrases]
    return sum(hits[1:], hits[0])


def left_stripped(text: Column) -> Column:
    """Without leading Unicode blanks; the text is searched only if it starts with one."""
    return F.when(
        F.left(text, F.lit(1)).rlike(BLANK), F.regexp_replace(text, LEADING_BLANKS, "")
    ).otherwise(text)


def right_stripped(text: Column) -> Column:
    return F.when(
        F.right(text, F.lit(1)).rlike(BLANK), F.regexp_replace(text, TRAILING_BLANKS, "")
    ).otherwise(text)
