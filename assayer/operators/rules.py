"""Validation rules: any number of row rules in one aggregate."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.numbers import count_where, percent
from assayer.functions.texts import EMAIL_PATTERN, PHONE_PATTERN
from assayer.operators.columns import quoted
from assayer.operators.duplicates import split_repeated

#: Types whose values can be longer than a fingerprint.
_WIDE = ("string", "varchar", "char", "binary", "array", "struct")


@dataclass(frozen=True)
class Rule:
    """A named test of one column; ``broken`` is true on rows that fail."""

    name: str
    column: str
    broken: Column


def upper_bound(column: str, most: float) -> Rule:
    return Rule("upper_bound", column, quoted(column) > F.lit(most))


def lower_bound(column: str, least: float) -> Rule:
    return Rule("lower_bound", column, quoted(column) < F.lit(least))


def non_negative(column: str) -> Rule:
    return Rule("non_negative", column, quoted(column) < 0)


def non_zero(column: str) -> Rule:
    return Rule("non_zero", column, quoted(column) == 0)


def denied_values(column: str, values: Sequence) -> Rule:
    return Rule("denied_values", column, quoted(column).isin(list(values)))


def allowed_values(column: str, values: Sequence) -> Rule:
    return Rule("allowed_values", column, ~quoted(column).isin(list(values)))


def column_order(smaller: str, larger: str) -> Rule:
    """``larger`` must not be below ``smaller``."""
    return Rule("column_order", f"{larger}<{smaller}", quoted(larger) < quoted(smaller))


def max_age(column: str, as_of: datetime, days: int) -> Rule:
    limit = F.lit((as_of - timedelta(days=days)).isoformat(sep=" ")).cast("timestamp_ntz")
    return Rule("stale_rows", column, quoted(column).cast("timestamp_ntz") < limit)


def not_null(column: str) -> Rule:
    return Rule("not_null", column, quoted(column).isNull())


def pattern(column: str, regex: str, name: str = "pattern") -> Rule:
    return Rule(name, column, ~quoted(column).cast("string").rlike(regex))


def digits(column: str) -> Rule:
    return pattern(column, r"^[0-9]+\z")


def email(column: str) -> Rule:
    return pattern(column, EMAIL_PATTERN, "email")


def phone(column: str) -> Rule:
    return pattern(column, PHONE_PATTERN, "phone")


def validate(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(rule, column, failed_rows, failed_pct), one row per rule, from one scan.

    A null value breaks ``not_null`` only.
    """
    counts = df.agg(
        F.count(F.lit(1)).alias("total"), *[count_where(r.broken).alias(f"r{i}") for i, r in enumerate(rules)]
    )
    rows = [
        F.struct(
            F.lit(r.name).alias("rule"),
            F.lit(r.column).alias("column"),
            F.col(f"r{i}").alias("failed_rows"),
            percent(F.col(f"r{i}"), F.col("total")).alias("failed_pct"),
        )
        for i, r in enumerate(rules)
    ]
    return counts.select(F.inline(F.array(*rows)))


def broken_rows(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rows that break any rule, with the names of the rules they break."""
    names = F.array_compact(F.array(*[F.when(r.broken, F.lit(f"{r.name}:{r.column}")) for r in rules]))
    return df.withColumn("broken_rules", names).where(F.size("broken_rules") > 0)


def unique_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first per key; nulls in keys equal each other.

    Keys of fixed width are counted before the shuffle, so a hot key is cheap. Of wider keys only fingerprints
    are counted, and then the keys whose fingerprint occurs again.
    """
    df = df.select(*[quoted(k) for k in keys])
    wide = any(kind.startswith(_WIDE) for _, kind in df.dtypes)
    counted = split_repeated(df, df.columns)[1] if wide else df
    groups = counted.groupBy(*[quoted(k) for k in keys]).agg(F.count(F.lit(1)).alias("n"))
    failed = groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("failed_rows"), F.sum("n").alias("counted"))
    # The rows of narrow keys have all been counted; those of wide ones are counted without reading them.
    total = F.lit(df.count()) if wide else F.coalesce("counted", F.lit(0))
    return failed.select(
        F.lit("unique_key").alias("rule"),
        F.lit(",".join(keys)).alias("column"),
        "failed_rows",
        percent(F.col("failed_rows"), total).alias("failed_pct"),
    )
