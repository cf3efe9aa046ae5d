"""Threshold ladders and fixed texts of the score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from assayer.functions.numbers import clamp, round_half_up

# Weight of each dimension in the overall score.
WEIGHTS = {
    "completeness": 0.30,
    "consistency": 0.15,
    "uniqueness": 0.15,
    "validity": 0.20,
    "freshness": 0.10,
    "schema": 0.10,
}

# Lowest score of each grade, and what the grade means.
GRADES = (("A", 85.0), ("B", 70.0), ("C", 55.0), ("D", 40.0), ("F", None))
VERDICTS = {
    "A": "Data is highly reliable and AI-ready.",
    "B": "Data is broadly usable; minor issues should be monitored.",
    "C": "Data has notable quality gaps — remediation recommended before AI use.",
    "D": "Data quality is poor; significant remediation required.",
    "F": "Data is not trustworthy for analytics or AI. Do not use without major remediation.",
}

# Lowest affected percentage of each severity.
SEVERITIES = (("HIGH", 10.0), ("MEDIUM", 3.0), ("LOW", None))

DUPLICATE_FACTOR = 2.5
OUTLIER_FACTOR = 3.0
SCHEMA_PENALTY = 15.0


def ladder(x: Column, steps: tuple[tuple[str, float | None], ...], strict: bool = False) -> Column:
    """First label whose lower bound ``x`` reaches (exceeds, if strict)."""
    *bounded, (last, _) = steps
    out = None
    for label, bound in bounded:
        test = x > bound if strict else x >= bound
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(last)


def severity(pct: Column) -> Column:
    return ladder(pct, SEVERITIES)


def severity_rank(name: Column) -> Column:
    return F.when(name == "HIGH", 0).when(name == "MEDIUM", 1).otherwise(2)


def grade(score: Column) -> Column:
    return ladder(score, GRADES)


def uniqueness_score(duplicate_pct: Column) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - duplicate_pct * DUPLICATE_FACTOR)


def validity_score(outlier_pct: Column) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - outlier_pct * OUTLIER_FACTOR)


def freshness_score(flag: Column, days: Column) -> Column:
    """100 when fresh, 60 when unknown, else falling from 100 at day 30 to 20 at day 365."""
    decayed = F.greatest(F.lit(20.0), 100.0 - (days - 30.0) * F.lit(80.0 / 335.0))
    return F.when(flag == "OK", 100.0).when(flag == "STALE", decayed).otherwise(60.0)


def schema_score(issues: Column) -> Column:
    return F.greatest(F.lit(0.0), 100.0 - issues * SCHEMA_PENALTY)


def overall_score(dimensions: dict[str, Column]) -> Column:
    total = None
    for name, weight in WEIGHTS.items():
        term = F.lit(weight) * dimensions[name]
        total = term if total is None else total + term
    return round_half_up(clamp(total, 0.0, 100.0), 1)
