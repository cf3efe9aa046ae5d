"""Quality score of profiled tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.functions import grades as g
from assayer.functions.numbers import round_half_up

SCORE_COLUMNS = (
    "ai_readiness", "completeness", "consistency", "uniqueness", "validity", "freshness", "schema",
    "grade", "verdict", "missing_pct", "duplicate_pct", "outlier_pct", "schema_issue_count",
    "freshness_days", "freshness_flag",
)


def quality_score(dataset_profile: DataFrame) -> DataFrame:
    """One score row per profile row."""
    issues = F.size("schema_issues")
    raw = {
        "completeness": F.col("completeness_score"),
        "consistency": F.col("consistency_score"),
        "uniqueness": g.uniqueness_score(F.col("duplicate_pct")),
        "validity": g.validity_score(F.col("total_outlier_pct")),
        "freshness": g.freshness_score(F.col("freshness_flag"), F.col("freshness_days")),
        "schema": g.schema_score(issues.cast("double")),
    }
    verdict = F.create_map(*[F.lit(x) for pair in g.VERDICTS.items() for x in pair])
    scored = dataset_profile.withColumn("ai_readiness", g.overall_score(raw)).withColumn("grade", g.grade(F.col("ai_readiness")))
    return scored.select(
        "ai_readiness",
        *[round_half_up(raw[d], 1).alias(d) for d in ("completeness", "consistency", "uniqueness", "validity", "freshness", "schema")],
        "grade",
        F.element_at(verdict, F.col("grade")).alias("verdict"),
        F.col("missing_cell_pct").alias("missing_pct"),
        "duplicate_pct",
        F.col("total_outlier_pct").alias("outlier_pct"),
        issues.alias("schema_issue_count"),
        "freshness_days",
        "freshness_flag",
    )
