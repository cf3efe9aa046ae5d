"""Profile of a table: one row per column, and one row for the whole table."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.config import Config
from assayer.functions.numbers import percent, round_half_up
from assayer.functions.times import whole_days
from assayer.operators import facts as roles
from assayer.operators.columns import ColumnSpec, VALUE_WORDS, column_specs, currency_of, distinct_names, name_has, quoted
from assayer.operators.duplicates import duplicate_rows
from assayer.operators.facts import ColumnFacts, Facts, gather_facts
from assayer.operators.missingness import co_missing, strong_co_missing
from assayer.operators.outliers import (
    OutlierFacts,
    OutlierScan,
    Spread,
    category_clusters,
    date_clusters,
    scan_outliers,
)
from assayer.operators.quantiles import QUARTILES, exact_quantiles
from assayer.operators.small import settle, small_frame
from assayer.operators.values import exact_distinct, fingerprint_counts, value_summary

_STATS = (
    "ordinal int, name string, dtype string, role string, total_rows bigint, present bigint, "
    "numeric_count bigint, whitespace_count bigint, mixed_count bigint, mixed_flag boolean, "
    "raw_mean double, raw_std double, raw_min double, raw_max double, "
    "raw_q1 double, raw_median double, raw_q3 double, "
    "negative_count bigint, near_count bigint, far_count bigint, outlier_count bigint, distinct_count bigint"
)

PROFILE_COLUMNS = (
    "ordinal", "name", "dtype", "role", "missing_count", "missing_pct", "unique_count", "unique_pct",
    "mean", "std", "min", "max", "q1", "median", "q3", "outlier_count", "outlier_pct",
    "top_values", "format_issues", "format_issue_examples",
)


@dataclass(frozen=True)
class ValueColumn:
    """The column most likely to hold money."""

    name: str
    currency: str
    mean: float
    median: float
    far_count: int
    far_sum: float | None


class TableProfile:
    """All measurements of one table. Each scan runs once, when first needed.

    Scans end in results sized by the schema; only those reach the driver.
    """

    def __init__(self, df: DataFrame, cfg: Config | None = None):
        self.cfg = cfg or Config()
        self.df, self.repeated_names = distinct_names(df)
        self.spark = df.sparkSession

    # -- scans ----------------------------------------------------------------

    @cached_property
    def facts(self) -> Facts:
        return gather_facts(self.df, self.cfg, self.repeated_names)

    @property
    def columns(self) -> list[ColumnFacts]:
        return self.facts.columns

    @cached_property
    def numeric(self) -> list[ColumnFacts]:
        return [c for c in self.columns if roles.is_numeric(c, self.cfg) and c.numeric]

    @cached_property
    def spreads(self) -> dict[int, Spread]:
        wanted = [c for c in self.columns if c.numeric and (roles.is_numeric(c, self.cfg) or roles.could_be_value(c, self.cfg))]
        got = exact_quantiles(
            self.df,
            {c.spec.ordinal: c.spec.number for c in wanted},
            {c.spec.ordinal: c.numeric for c in wanted},
            QUARTILES,
            self.cfg,
        )
        return {o: Spread(*q) for o, q in got.items()}

    @cached_property
    def outliers(self) -> OutlierScan:
        return scan_outliers(self.df, self.facts, self.spreads, self.cfg)

    @cached_property
    def duplicates(self) -> int:
        return duplicate_rows(self.df, self.cfg.duplicates).first()[0]

    @cached_property
    def value_counts(self) -> DataFrame | None:
        specs = self._categories()
        return fingerprint_counts(self.df, specs, self._mixed_ordinals()) if specs else None

    def _categories(self) -> list[ColumnSpec]:
        return [c.spec for c in self.columns if roles.is_categorical(c, self.cfg) and c.present]

    @cached_property
    def value_summary(self) -> DataFrame:
        """(ordinal, distinct, counted, top_values, format_issue_examples) of the categorical columns."""
        schema = "ordinal int, distinct bigint, counted bigint, top_values array<struct<value:string,count:bigint>>, format_issue_examples array<string>"
        if self.value_counts is None:
            return small_frame(self.spark, [], schema)
        return settle(value_summary(self.value_counts, self.df, self._categories(), self._mixed_ordinals(), self.cfg))

    @cached_property
    def distinct(self) -> dict[int, int]:
        if self.cfg.distinct == "approx":
            return {c.spec.ordinal: c.approx_distinct for c in self.columns}
        return {r["ordinal"]: r["distinct"] for r in self.value_summary.collect()} | self.other_distinct

    @cached_property
    def other_distinct(self) -> dict[int, int]:
        """Exact distinct counts of the columns without value counts."""
        columns = [c for c in self.columns if c.present and not roles.is_categorical(c, self.cfg)]
        return exact_distinct(self.df, columns)

    @cached_property
    def overlaps(self) -> DataFrame:
        """(ordinal, other, both, any, jaccard) for columns with a missing-value issue; not evaluated yet."""
        return co_missing(self.df, *self._missing())

    def _missing(self) -> tuple[list[tuple[ColumnSpec, int]], list[int]]:
        """Columns with missing rows and how many, and the columns with an issue."""
        missing = [(c.spec, c.missing) for c in self.columns if c.missing]
        return missing, [c.spec.ordinal for c in self.columns if self.missing_pct(c) >= self.cfg.missing_issue_pct]

    @cached_property
    def strong_overlaps(self) -> DataFrame:
        """The overlaps that reports name."""
        return settle(strong_co_missing(self.df, *self._missing(), self.cfg.jaccard))

    @cached_property
    def date_clusters(self) -> DataFrame:
        return date_clusters(self.df, self.facts, self.outliers, self.cfg)

    @cached_property
    def category_clusters(self) -> DataFrame:
        return category_clusters(self.df, self.facts, self.spreads, self.outliers, self.cfg)

    def gather(self) -> TableProfile:
        """Run the scans that do not need each other as concurrent Spark jobs."""
        _ = self.facts  # the other scans depend on the roles
        scans = [
            lambda: (self.outliers, self.category_clusters),
            lambda: self.value_summary,
            lambda: self.duplicates,
            lambda: self.strong_overlaps,
        ]
        if self.cfg.distinct == "exact":
            scans.append(lambda: self.other_distinct)
        with ThreadPoolExecutor(self.cfg.concurrent_scans) as pool:
            for done in [pool.submit(inheritable_thread_target(self.spark)(scan)) for scan in scans]:
                done.result()
        return self

    # -- schema-sized derivations ----------------------------------------------

    def missing_pct(self, c: ColumnFacts) -> float:
        return int(c.missing / c.rows * 100.0 * 100.0 + 0.5) / 100.0

    def _mixed_ordinals(self) -> list[int]:
        return [c.spec.ordinal for c in self.columns if self._mixed(c)]

    def _mixed(self, c: ColumnFacts) -> int:
        return roles.mixed_values(c, self.cfg) if roles.is_categorical(c, self.cfg) else 0

    def format_issues(self, c: ColumnFacts) -> int:
        if not roles.is_categorical(c, self.cfg):
            return 0
        return c.whitespace + self._mixed(c)

    def outlier_count(self, c: ColumnFacts) -> int:
        o = c.spec.ordinal
        if o not in self.spreads or not roles.is_numeric(c, self.cfg):
            return 0
        return self.outliers.columns[o].column_count(roles.negatives(c, self.cfg))

    @cached_property
    def schema_issues(self) -> list[str]:
        # Wording of the schema findings.
        out = [
            f"Column '{c.spec.name}' appears to mix numeric and non-numeric values "
            f"({c.numeric / c.rows * 100:.0f}% parseable as numbers)."
            for c in self.columns
            if roles.is_mixed(c, self.cfg)
        ]
        if self.repeated_names:
            out.append(f"Duplicate column names detected: {self.repeated_names}")
        empty = [c.spec.name for c in self.columns if not c.present]
        if empty:
            out.append(f"Completely empty columns: {empty}")
        return out

    @cached_property
    def value_column(self) -> ValueColumn | None:
        best, best_score = None, None
        for c in self.columns:
            if not roles.could_be_value(c, self.cfg):
                continue
            hits = name_has(c.spec.name.replace("_", " ").replace("-", " "), VALUE_WORDS)
            points = hits * 10 + min(self.spreads[c.spec.ordinal].median / 1000, 50)
            if best is None or points > best_score:
                best, best_score = c, points
        if best is None:
            return None
        o = best.spec.ordinal
        found: OutlierFacts = self.outliers.columns[o]
        return ValueColumn(
            best.spec.name, currency_of(best.spec.name), best.mean, self.spreads[o].median, found.far, found.far_sum
        )

    # -- result tables ---------------------------------------------------------

    def stats(self, outliers: bool = True, distinct: bool = True) -> DataFrame:
        """Unrounded measurements, one row per column."""
        rows = []
        for c in self.columns:
            o, numeric = c.spec.ordinal, roles.is_numeric(c, self.cfg)
            row = {
                "ordinal": o,
                "name": c.spec.name,
                "dtype": c.spec.dtype,
                "role": roles.role(c, self.cfg),
                "total_rows": c.rows,
                "present": c.present,
                "numeric_count": c.numeric,
                "whitespace_count": c.whitespace if roles.is_categorical(c, self.cfg) else 0,
                "mixed_count": self._mixed(c),
                "mixed_flag": roles.is_mixed(c, self.cfg),
                "outlier_count": 0,
                "distinct_count": self.distinct.get(o, 0) if distinct else None,
            }
            if numeric and c.numeric:
                row |= {"raw_mean": c.mean, "raw_std": c.std, "raw_min": c.low, "raw_max": c.high}
                row["negative_count"] = roles.negatives(c, self.cfg)
                if outliers:
                    s, f = self.spreads[o], self.outliers.columns[o]
                    row |= {"raw_q1": s.q1, "raw_median": s.median, "raw_q3": s.q3}
                    row |= {"near_count": f.near, "far_count": f.far, "outlier_count": self.outlier_count(c)}
            rows.append(row)
        return small_frame(self.spark, rows, _STATS)

    @cached_property
    def column_profile(self) -> DataFrame:
        s = self.stats()
        out = (
            s.join(self.value_summary, "ordinal", "left")
            .withColumn("missing_count", F.col("total_rows") - F.col("present"))
            .withColumn("format_issues", F.col("whitespace_count") + F.col("mixed_count"))
            .withColumn("missing_pct", percent(F.col("missing_count"), F.col("total_rows")))
            .withColumn("unique_count", F.col("distinct_count"))
            .withColumn("unique_pct", percent(F.col("distinct_count"), F.col("total_rows")))
            .withColumn("outlier_pct", percent(F.col("outlier_count"), F.col("total_rows")))
            .withColumn("top_values", F.coalesce("top_values", F.array().cast("array<struct<value:string,count:bigint>>")))
            .withColumn("format_issue_examples", F.coalesce("format_issue_examples", F.array().cast("array<string>")))
        )
        for m in ("mean", "std", "min", "max", "q1", "median", "q3"):
            out = out.withColumn(m, round_half_up(F.col(f"raw_{m}"), 4))
        return settle(out.select(*PROFILE_COLUMNS, "total_rows").orderBy("ordinal"))

    def _latest(self) -> dict:
        columns = self.columns if "facts" in self.__dict__ else self._time_columns()
        latest = [c.last_time for c in columns if roles.is_dated(c, self.cfg) and c.last_time is not None]
        return {"latest": max(latest, default=None), "as_of": self.cfg.reference_time()}

    def _time_columns(self) -> list[ColumnFacts]:
        """Facts of the columns that can hold times, if the full scan has not been made."""
        names = [quoted(s.name) for s in column_specs(self.df) if s.kind in ("time", "text")]
        return gather_facts(self.df.select(*names), self.cfg).columns if names else []

    def freshness(self) -> DataFrame:
        """One row: latest time over all date columns, its age in days and a flag."""
        return with_age(small_frame(self.spark, [self._latest()], "latest timestamp_ntz, as_of timestamp_ntz"), self.cfg)

    @cached_property
    def dataset_profile(self) -> DataFrame:
        rows, cols = self.facts.rows, len(self.columns)
        one = small_frame(
            self.spark,
            [
                {
                    "total_rows": rows,
                    "total_cols": cols,
                    "duplicate_count": self.duplicates,
                    "missing_cells": sum(c.missing for c in self.columns),
                    "format_total": sum(self.format_issues(c) for c in self.columns),
                    "total_outlier_rows": self.outliers.any_rows,
                    "schema_issues": self.schema_issues,
                    **self._latest(),
                }
            ],
            "total_rows bigint, total_cols int, duplicate_count bigint, missing_cells bigint, format_total bigint, "
            "total_outlier_rows bigint, schema_issues array<string>, latest timestamp_ntz, as_of timestamp_ntz",
        )
        return settle(with_age(dataset_scores(one), self.cfg).select(*DATASET_COLUMNS))


DATASET_COLUMNS = (
    "total_rows", "total_cols", "duplicate_count", "duplicate_pct", "completeness_score", "consistency_score",
    "uniqueness_score", "validity_score", "freshness_days", "freshness_flag", "total_outlier_rows",
    "total_outlier_pct", "schema_issues", "missing_cells", "missing_cell_pct",
)


def with_age(df: DataFrame, cfg: Config) -> DataFrame:
    """Age of ``latest`` at ``as_of`` in whole days, and whether that is fresh."""
    days = F.col("freshness_days")
    return df.withColumn("freshness_days", whole_days(F.col("as_of"), F.col("latest")).cast("double")).withColumn(
        "freshness_flag",
        F.when(days.isNull(), "UNKNOWN").when(days <= cfg.stale_days, "OK").otherwise("STALE"),
    )


def dataset_scores(totals: DataFrame) -> DataFrame:
    """Percentages and raw dimension scores from counts; works on any number of tables."""
    cells = (F.col("total_rows") * F.col("total_cols")).cast("double")
    rows = F.col("total_rows").cast("double")
    return (
        totals.withColumn("duplicate_pct", percent(F.col("duplicate_count"), rows))
        .withColumn("missing_cell_pct", percent(F.col("missing_cells"), cells))
        .withColumn("total_outlier_pct", percent(F.col("total_outlier_rows"), rows))
        .withColumn("completeness_score", round_half_up(100.0 - F.col("missing_cell_pct"), 2))
        .withColumn(
            "consistency_score",
            round_half_up(F.greatest(F.lit(0.0), 100.0 - F.col("format_total") / cells * 100.0), 2),
        )
        .withColumn("validity_score", round_half_up((1.0 - F.col("total_outlier_rows") / rows) * 100.0, 2))
        .withColumn("uniqueness_score", round_half_up(100.0 - F.col("duplicate_pct"), 2))
    )
