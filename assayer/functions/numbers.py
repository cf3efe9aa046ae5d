"""Numeric expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: text that counts as a number. Narrower than Spark's own cast, which
# also takes "1d" and "0x1p3".
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"

INTEGER_PATTERN = r"^\s*[+-]?\d+\s*$"

_LONG_SAFE = 9.0e18


def round_half_up(x: Column, digits: int) -> Column:
    """Round with plain double arithmetic, so that other engines give the same bits.

    Values too large to carry ``digits`` decimals (or infinite) stay as they are.
    """
    k = float(10**digits)
    return F.when(F.abs(x) < F.lit(_LONG_SAFE / k), F.floor(x * k + 0.5) / F.lit(k)).otherwise(x)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part / whole * 100``, 0 when there is nothing to divide by."""
    share = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0)) * 100.0
    return F.coalesce(round_half_up(share, digits), F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(float(high)), F.greatest(F.lit(float(low)), x))


def is_number(c: Column) -> Column:
    """Whether a string holds a finite number.

    Only an exponent or hundreds of digits can overflow, so other text is never parsed here.
    """
    safe = (F.length(c) < 300) & ~c.contains("e") & ~c.contains("E")
    return c.rlike(NUMBER_PATTERN) & (safe | (F.abs(c.try_cast("double")) < F.lit(float("inf"))))


def text_to_number(c: Column) -> Column:
    """Number held by a string, null if there is none."""
    return F.when(is_number(c), c.try_cast("double"))


def count_where(test: Column) -> Column:
    """Rows that pass a test. Compiles to half the work of ``count_if``."""
    return F.count(F.when(test, 1))


def plain_number(x: Column) -> Column:
    """Decimal text of a double without exponent: at most 4 decimals, at least one."""
    return F.regexp_replace(x.cast("decimal(38,4)").cast("string"), r"(\.\d+?)0+$", "$1")


def outside_fences(x: Column, q1: Column | float, q3: Column | float, factor: float) -> Column:
    """Tukey fence test, strict on both sides, false for null."""
    if not isinstance(q1, Column):
        iqr = q3 - q1
        low, high = F.lit(q1 - factor * iqr), F.lit(q3 + factor * iqr)
    else:
        iqr = q3 - q1
        low, high = q1 - factor * iqr, q3 + factor * iqr
    return F.coalesce((x < low) | (x > high), F.lit(False))
