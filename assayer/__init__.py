"""Data quality measurement for Spark tables.

``assess(df)`` profiles a DataFrame and returns a report of DataFrames: column
and dataset profile, quality score, ranked issues, impact and recommendations.
"""

from assayer.config import Config
from assayer.operators.profile import TableProfile
from assayer.plans.report import QualityReport, assess

__all__ = ["Config", "QualityReport", "TableProfile", "assess"]
