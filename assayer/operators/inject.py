"""Repeatable defects for testing detectors.

Every injector is a projection or filter driven by an integer hash of key columns, so
the same rows are hit whatever the partitioning, and another engine can repeat it.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.columns import quoted

# Multipliers that spread keys, and the resolution of rates.
SPREAD, STEP, RESOLUTION = 7919, 104729, 1000


def hit(key: str, rate: float, salt: int = 0) -> Column:
    """True for about ``rate`` of the keys; other salts hit other keys."""
    place = F.pmod(quoted(key).cast("bigint"), F.lit(RESOLUTION))  # small, so the product cannot overflow
    mixed = F.pmod(place * SPREAD + salt * STEP, F.lit(RESOLUTION))
    return mixed < int(rate * RESOLUTION)


def _change(df: DataFrame, column: str, where: Column, value: Column) -> DataFrame:
    return df.withColumn(column, F.when(where, value).otherwise(quoted(column)))


def missing(df: DataFrame, column: str, where: Column) -> DataFrame:
    return df.withColumn(column, F.when(~F.coalesce(where, F.lit(False)), quoted(column)))


def duplicates(df: DataFrame, where: Column) -> DataFrame:
    return df.unionByName(df.where(where))


def outliers(df: DataFrame, column: str, where: Column, big: Column) -> DataFrame:
    return _change(df, column, where, big)


def date_cluster(df: DataFrame, column: str, time: str, where: Column, big: Column, start: datetime, hours: Column) -> DataFrame:
    """Outliers that all fall a few hours after ``start``."""
    base = F.lit(start.isoformat(sep=" ")).cast("timestamp_ntz")
    moved = F.timestamp_add("HOUR", hours.cast("int"), base)
    return _change(_change(df, column, where, big), time, where, moved)


def unit_bug(df: DataFrame, column: str, where: Column, factor: float) -> DataFrame:
    return _change(df, column, where, quoted(column) * F.lit(factor))


def mixed_type(df: DataFrame, column: str, where: Column, prefix: str) -> DataFrame:
    text = quoted(column).cast("string")
    return df.withColumn(column, F.when(where, F.concat(F.lit(prefix), text)).otherwise(text))


def invalid_range(df: DataFrame, column: str, negative: Column, zero: Column, above: Column, limit: float) -> DataFrame:
    c = quoted(column)
    return df.withColumn(
        column,
        F.when(negative, -F.abs(c)).when(zero, F.lit(0.0)).when(above, F.abs(c) + F.lit(float(limit))).otherwise(c),
    )


def casing(df: DataFrame, column: str, low: Column, high: Column) -> DataFrame:
    c = quoted(column)
    return df.withColumn(column, F.when(low, F.lower(c)).when(high, F.upper(c)).otherwise(c))


def invalid_category(df: DataFrame, column: str, where: Column, values: Sequence[str], pick: Column) -> DataFrame:
    bad = F.element_at(F.array(*[F.lit(v) for v in values]), (pick % len(values) + 1).cast("int"))
    return _change(df, column, where, bad)


def empty_column(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.lit(None).cast("string"))


def stale_dates(df: DataFrame, column: str, where: Column, days: int) -> DataFrame:
    return _change(df, column, where, F.timestamp_add("DAY", F.lit(-days), quoted(column)))


def duplicate_keys(df: DataFrame, key: str, where: Column) -> DataFrame:
    """Give the hit rows the key of their neighbour."""
    return _change(df, key, where & (quoted(key) > 0), quoted(key) - 1)


def phone_formats(df: DataFrame, key: str, name: str = "phone") -> DataFrame:
    """A phone number per key in one of four layouts."""
    number = (F.lit(6_000_000_000) + quoted(key) * SPREAD % 3_999_999_999).cast("string")
    part = lambda start, n: F.substring(number, start, n)
    style = quoted(key) % 4
    text = (
        F.when(style == 0, F.concat(F.lit("+91-"), part(1, 5), F.lit("-"), part(6, 5)))
        .when(style == 1, number)
        .when(style == 2, F.concat(F.lit("91"), number))
        .otherwise(F.concat(F.lit("("), part(1, 3), F.lit(") "), part(4, 5), F.lit("-"), part(9, 2)))
    )
    return df.withColumn(name, text)


def fractional(df: DataFrame, column: str, where: Column) -> DataFrame:
    c = quoted(column).cast("double")
    return df.withColumn(column, F.when(where, c / 1000.0).otherwise(c))


def column_order(df: DataFrame, column: str, other: str, where: Column, factor: float) -> DataFrame:
    """Push ``column`` below ``other``, which it should never be."""
    return _change(df, column, where, quoted(other) * F.lit(factor))
