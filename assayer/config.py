"""Thresholds and execution choices, all overridable per call."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime


@dataclass(frozen=True)
class Config:
    # Reference time of the freshness check. It is a parameter, never the clock, so
    # that a rerun over the same data gives the same report.
    as_of: datetime | None = None

    # Roles.
    numeric_ratio: float = 0.8
    date_ratio: float = 0.8
    mixed_low: float = 0.1
    mixed_high: float = 0.9
    format_mix: float = 0.9
    ratio_base: str = "all"  # or "non_null"
    keyword_match: str = "substring"  # or "token"

    # Outliers.
    fence: float = 1.5
    far_fence: float = 3.0
    min_outlier_values: int = 10

    # Root cause.
    missing_issue_pct: float = 1.0
    jaccard: float = 0.3
    concentration: float = 0.4
    min_cluster_rows: int = 1
    cluster_window_days: int = 7
    stale_days: int = 30

    # Impact.
    value_ratio: float = 0.7

    # Output widths.
    top_values: int = 5
    examples_per_kind: int = 3
    max_examples: int = 5

    # Execution. "approx" trades exactness for one sketch inside the first scan.
    quantiles: str = "exact"  # or "approx"
    distinct: str = "exact"  # or "approx"
    duplicates: str = "exact"  # or "fingerprint"
    quantile_accuracy: int = 10_000  # of approximate results and grouped searches
    sketch_size: int = 8_192  # of the sketches that guide an exact search
    quantile_values: int = 100_000  # values in an interval from which on it is narrowed further
    aggregates_per_pass: int = 240  # bounds the size of the generated code
    concurrent_scans: int = 3

    def reference_time(self) -> datetime:
        if self.as_of is None:
            raise ValueError("Config.as_of is needed to measure freshness")
        return self.as_of
