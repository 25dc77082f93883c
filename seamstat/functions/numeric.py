"""Numeric coercion, guarded comparison and fixed-point formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Spellings accepted as numbers in review files and in answers.
TABLE_NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
LOOSE_NUMBER = (
    r"^\s*[+-]?((\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?"
    r"|(?i:inf|infinity|nan))\s*$"
)
# End of fixed values.

NEAR_TIE = 1e-6


def _parsed(text: Column, accepted: str) -> Column:
    # Spark alone would also take Java suffixes such as "5d", hence the pattern first.
    return F.when(text.rlike(accepted), F.trim(F.replace(text, F.lit("_"))).try_cast("double"))


def number_or_zero(col: Column, dtype: T.DataType) -> Column:
    """Coerce to double; anything missing, NaN or unreadable becomes 0."""
    value = _parsed(col, TABLE_NUMBER) if isinstance(dtype, T.StringType) else col.cast("double")
    return F.coalesce(F.nanvl(value, F.lit(0.0)), F.lit(0.0))


def number_or_default(col: Column, dtype: T.DataType, default: float) -> Column:
    """Coerce to double; missing or unreadable becomes ``default``, NaN stays NaN."""
    value = _parsed(col, LOOSE_NUMBER) if isinstance(dtype, T.StringType) else col.cast("double")
    return F.coalesce(value, F.lit(float(default)))


def at_least(value: Column, bound: float) -> Column:
    """``value >= bound`` where NaN is never large (Spark sorts NaN above all numbers)."""
    return (value >= F.lit(bound)) & ~F.isnan(value)


def fixed(value: Column, digits: int) -> Column:
    """Text with ``digits`` decimals, rounded on the exact binary value, ties to even.

    A decimal cast rounds the shortest decimal spelling half-up, which is right except
    close to a tie. There the product with 10**digits is split into a rounded part and its
    exact error (two-product), so that a value just below or above a tie is told apart from
    a true tie.
    """
    scale = F.lit(float(10**digits))
    size = F.abs(value)
    product = size * scale
    whole = F.floor(product).cast("double")
    beyond_half = product - whole - 0.5
    shifted = size * F.lit(134217729.0)  # 2**27 + 1 splits a double into two halves
    high = shifted - (shifted - size)
    error = (high * scale - product) + (size - high) * scale
    odd = F.pmod(whole, F.lit(2.0)) == 1.0
    up = F.when(beyond_half != 0, beyond_half > 0).when(error != 0, error > 0).otherwise(odd)
    near_tie = (whole + up.cast("double")) / scale
    rounded = F.when(F.abs(beyond_half) > NEAR_TIE, size).otherwise(near_tie)
    text = F.coalesce(
        rounded.try_cast(f"decimal(30, {digits})").cast("string"),
        F.format_string(f"%.{digits}f", size),  # thirty digits and more
    )
    return F.concat(F.when(value < 0, "-").otherwise(""), text)


def percent(value: Column, digits: int) -> Column:
    return F.concat(fixed(value * F.lit(100.0), digits), F.lit("%"))
