"""What each issue may cost: rows, money, and downstream risks."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.functions.numbers import plain_number, round_half_up
from assayer.operators import wording as w
from assayer.operators.columns import DEFAULT_CURRENCY

if TYPE_CHECKING:
    from assayer.operators.profile import ValueColumn

# Fixed value: share of row value assumed at risk when nothing better is known.
GENERIC_SHARE = 0.1


def downstream_risks(dimension: Column) -> Column:
    known = F.create_map(
        *[x for name, risks in w.RISKS.items() for x in (F.lit(name), F.array(*[F.lit(r) for r in risks]))]
    )
    return F.coalesce(F.try_element_at(known, dimension), F.array(F.lit(w.UNKNOWN_RISK)))


def outlier_exposure(value: ValueColumn) -> float | None:
    """Distance of the far outliers' sum from what the median would give."""
    return abs(value.far_sum - value.median * value.far_count) if value.far_count else None


def exposure(dimension: Column, rows: Column, value: ValueColumn | None) -> Column:
    """Money at stake of one issue; null without a value column or affected rows."""
    if value is None:
        return F.lit(None).cast("double")
    full = rows.cast("double") * F.lit(value.mean)
    generic = full * F.lit(GENERIC_SHARE)
    outliers = outlier_exposure(value)
    amount = (
        F.when(dimension == "validity", generic if outliers is None else F.lit(outliers))
        .when(dimension.isin("uniqueness", "completeness"), full)
        .otherwise(generic)
    )
    return F.when(rows > 0, round_half_up(amount, 2))


def _note(dimension: Column, rows: Column, value: ValueColumn | None) -> Column:
    if value is None:
        return F.lit(w.NOTE_NO_VALUE)
    name = F.lit(value.name)
    generic = F.format_string(w.NOTE_GENERIC, name)
    return (
        F.when(rows == 0, w.NOTE_NO_ROWS)
        .when(dimension == "validity", F.format_string(w.NOTE_OUTLIERS, name) if value.far_count else generic)
        .when(dimension == "uniqueness", F.format_string(w.NOTE_DUPLICATES, name, rows, name))
        .when(dimension == "completeness", F.format_string(w.NOTE_MISSING, rows, name))
        .otherwise(generic)
    )


def impact_estimates(issues: DataFrame, value: ValueColumn | None) -> DataFrame:
    dimension, rows = F.col("dimension"), F.col("affected_rows")
    return issues.select(
        "ord",
        F.col("title").alias("issue_title"),
        "dimension",
        "severity",
        "affected_rows",
        "affected_pct",
        exposure(dimension, rows, value).alias("monetary_impact"),
        F.lit(value.currency if value else DEFAULT_CURRENCY).alias("currency_symbol"),
        _note(dimension, rows, value).alias("monetary_note"),
        F.format_string(w.RECORD_TEXT, rows, F.col("affected_pct")).alias("record_impact_description"),
        downstream_risks(dimension).alias("downstream_risks"),
        F.col("severity").alias("risk_level"),
    )


def impact_summary(estimates: DataFrame, total_rows: int, value: ValueColumn | None) -> DataFrame:
    """One row of totals. Rows and money are summed over issues, so a row with two issues
    counts twice; ``outlier rows`` of the profile gives a true union."""
    money, currency = F.col("money"), value.currency if value else DEFAULT_CURRENCY
    totals = estimates.agg(
        F.count(F.lit(1)).alias("estimate_count"),
        F.count_if(F.col("risk_level") == "HIGH").alias("high_risk"),
        F.coalesce(F.sum("monetary_impact"), F.lit(0.0)).alias("money"),
        F.coalesce(F.sum("affected_rows"), F.lit(0)).cast("bigint").alias("total_affected_rows"),
    ).withColumn(
        "summed_affected_pct",
        round_half_up(F.least(F.col("total_affected_rows") / F.lit(float(max(total_rows, 1))) * 100.0, F.lit(100.0)), 1),
    )
    if value:
        amount = F.when(money > 0, F.format_string(w.IMPACT_MONEY, F.lit(currency), money)).otherwise(w.IMPACT_NO_MONEY)
        exposure_total = round_half_up(money, 2)
    else:
        amount, exposure_total = F.lit(w.IMPACT_NO_MONEY), F.lit(None).cast("double")
    return totals.select(
        "estimate_count",
        "high_risk",
        exposure_total.alias("total_monetary_exposure"),
        F.lit(currency).alias("currency_symbol"),
        "total_affected_rows",
        "summed_affected_pct",
        F.when(F.col("estimate_count") == 0, w.NO_IMPACT)
        .otherwise(
            F.format_string(
                w.IMPACT_SUMMARY,
                F.col("estimate_count"),
                F.col("high_risk"),
                amount,
                plain_number(F.col("summed_affected_pct")),
            )
        )
        .alias("executive_summary"),
    )
