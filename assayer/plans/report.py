"""The full analysis: profile, score, issues, impact, recommendations."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.config import Config
from assayer.operators import impact as im
from assayer.operators import issues as iss
from assayer.operators import narrative as text
from assayer.operators import recommend as rec
from assayer.operators.profile import TableProfile
from assayer.operators.score import quality_score
from assayer.operators.small import settle


def assess(df: DataFrame, cfg: Config | None = None, name: str = "the dataset") -> QualityReport:
    return QualityReport(df, cfg, name)


class QualityReport:
    """All results for one table. Only ``profile`` scans it; the rest are tables with a
    few rows per column, kept as DataFrames and evaluated once."""

    def __init__(self, df: DataFrame, cfg: Config | None = None, name: str = "the dataset"):
        self.cfg, self.name = cfg or Config(), name
        self.profile = TableProfile(df, self.cfg)

    @property
    def column_profile(self) -> DataFrame:
        return self.profile.column_profile

    @property
    def dataset_profile(self) -> DataFrame:
        return self.profile.dataset_profile

    @cached_property
    def score(self) -> DataFrame:
        return settle(quality_score(self.dataset_profile))

    @cached_property
    def issues(self) -> DataFrame:
        p = self.profile.gather()
        found = iss.missing_issues(p.column_profile, p.strong_overlaps, self.cfg)
        for more in (
            iss.outlier_issues(p.column_profile, p.category_clusters, p.date_clusters),
            iss.format_issues(p.column_profile),
            iss.duplicate_issues(p.dataset_profile),
            iss.schema_issues(p.dataset_profile),
            iss.freshness_issues(p.dataset_profile),
        ):
            found = found.unionByName(more)
        return settle(iss.ranked(found).orderBy("ord"))

    @cached_property
    def issue_summary(self) -> DataFrame:
        return settle(iss.issue_summary(self.issues))

    @cached_property
    def impact(self) -> DataFrame:
        return settle(im.impact_estimates(self.issues, self.profile.value_column))

    @cached_property
    def impact_summary(self) -> DataFrame:
        return settle(im.impact_summary(self.impact, self.profile.facts.rows, self.profile.value_column))

    @property
    def recommendation_candidates(self) -> DataFrame:
        return rec.candidates(self.issues, self.impact, self.score)

    @cached_property
    def recommendations(self) -> DataFrame:
        return settle(rec.ranked(self.recommendation_candidates).orderBy("priority"))

    @cached_property
    def plan(self) -> DataFrame:
        counts = self.issue_summary.first()
        return settle(rec.remediation_plan(self.recommendations, counts["high_severity"], counts["medium_severity"]))

    # -- text and documents ------------------------------------------------------

    def _named(self, df: DataFrame) -> DataFrame:
        return df.withColumn("dataset", F.lit(self.name))

    @cached_property
    def overview(self) -> DataFrame:
        """One row joining all one-row results on the dataset name."""
        seen = set(self.dataset_profile.columns)
        out = self._named(self.dataset_profile)
        for part in (self.score, self.issue_summary, self.impact_summary, self.plan):
            fresh = [c for c in part.columns if c not in seen]
            seen.update(fresh)
            out = out.join(self._named(part.select(*fresh)), "dataset")
        return settle(out)

    def narrative(self) -> DataFrame:
        return text.narrative(self.overview, self._named(self.issues), self._named(self.recommendations))

    def digest(self) -> DataFrame:
        return text.digest(
            self.overview, self._named(self.column_profile), self._named(self.issues), self._named(self.recommendations)
        )

    def summary_rows(self) -> DataFrame:
        """One row per recommendation with its issue, money estimate and the table's score."""
        issue = self.issues.select(
            F.col("title").alias("issue_ref"), "severity", "affected_column", "affected_rows", "affected_pct"
        )
        money = self.impact.select(F.col("issue_title").alias("issue_ref"), "monetary_impact")
        score = self._named(self.score.select("ai_readiness", "grade"))
        return (
            self._named(self.recommendations.drop("detail"))
            .join(issue, "issue_ref", "left")
            .join(money, "issue_ref", "left")
            .join(score, "dataset")
            .select(
                "priority", "action", "dimension", "effort", "impact", "issue_ref", "severity", "affected_column",
                "affected_rows", "affected_pct", "monetary_impact", "ai_readiness", "grade",
            )
        )

    def document(self) -> DataFrame:
        """One row (dataset, report): everything as one JSON text."""
        cols = self._named(self.column_profile).groupBy("dataset").agg(
            _in_order(
                "ordinal",
                "name", "dtype", "missing_pct", "missing_count", "unique_count", "outlier_count", "outlier_pct",
                "format_issues", "mean", "std", "min", "max", "q1", "median", "q3",
                F.map_from_entries("top_values").alias("top_values"),
            ).alias("columns")
        )
        issues = self._named(self.issues).groupBy("dataset").agg(
            _in_order(
                "ord",
                "dimension", "severity", "title", "affected_column", "affected_rows", "affected_pct", "description",
                "possible_root_causes", "correlated_columns", "evidence",
            ).alias("issues")
        )
        estimates = self._named(self.impact).groupBy("dataset").agg(
            _in_order(
                "ord",
                "issue_title", "dimension", "severity", "affected_rows", "affected_pct", "monetary_impact",
                "currency_symbol", "monetary_note", "record_impact_description", "downstream_risks",
            ).alias("estimates")
        )
        items = self._named(self.recommendations).groupBy("dataset").agg(
            _in_order("priority", "priority", "action", "detail", "dimension", "effort", "impact", "issue_ref").alias("items")
        )
        df = self.overview
        for part in (cols, issues, estimates, items):
            df = df.join(part, "dataset", "left")
        report = F.struct(
            F.col("dataset").alias("dataset_name"),
            "total_rows",
            "total_cols",
            F.struct(
                "ai_readiness", "grade", "verdict", "completeness", "validity", "uniqueness", "consistency",
                "freshness", "schema",
            ).alias("score"),
            F.struct(
                "missing_cell_pct", "duplicate_pct", "total_outlier_pct", "schema_issues", "freshness_flag",
                "freshness_days",
            ).alias("metrics"),
            "columns",
            F.struct(
                "total_issues", "high_severity", "medium_severity", "low_severity", "summary", _or_empty("issues")
            ).alias("root_cause"),
            F.struct(
                "executive_summary", "total_monetary_exposure", "currency_symbol", "total_affected_rows",
                "summed_affected_pct", _or_empty("estimates"),
            ).alias("impact"),
            F.struct("remediation_plan", "estimated_score_lift", _or_empty("items")).alias("recommendations"),
        )
        return df.select("dataset", F.to_json(report).alias("report"))


def _in_order(order: str, *fields):
    """Rows of a schema-sized table as an ordered array of structs."""
    rows = F.collect_list(F.struct(F.col(order).alias("__order"), F.struct(*fields).alias("row")))
    # Maps cannot be compared, so sort on the position alone.
    by_order = F.array_sort(rows, lambda a, b: a["__order"] - b["__order"])
    return F.transform(by_order, lambda r: r["row"])


def _or_empty(name: str):
    return F.coalesce(F.col(name), F.array()).alias(name)
