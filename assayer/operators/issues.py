"""Issues found in a profile, with evidence and likely causes.

Inputs are profile tables (a row per column), so nothing here touches user data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.config import Config
from assayer.functions.grades import severity, severity_rank
from assayer.functions.numbers import percent, plain_number
from assayer.functions.texts import listed
from assayer.operators import wording as w

DATASET = "__dataset__"

_EVIDENCE = {
    "missing_count": "bigint",
    "missing_pct": "double",
    "outlier_count": "bigint",
    "outlier_pct": "double",
    "min": "double",
    "max": "double",
    "q1": "double",
    "q3": "double",
    "mean": "double",
    "category_clusters": "array<struct<column:string,top_value:string,outlier_count:bigint,"
    "concentration_pct:double,base_count:bigint>>",
    "date_clusters": "array<struct<column:string,window_days:bigint,from:string,to:string,"
    "outlier_count_in_window:bigint>>",
    "format_issue_count": "bigint",
    "examples": "array<string>",
    "duplicate_count": "bigint",
    "duplicate_pct": "double",
    "schema_issues": "array<string>",
    "freshness_days": "double",
    "freshness_flag": "string",
}


def _evidence(**given: Column | str) -> Column:
    fields = []
    for name, dtype in _EVIDENCE.items():
        c = given.get(name, F.lit(None))
        fields.append((F.col(c) if isinstance(c, str) else c).cast(dtype).alias(name))
    return F.struct(*fields)


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _issue(
    df: DataFrame,
    detector: int,
    dimension: str,
    *,
    severity: Column,
    title: Column,
    rows: Column,
    pct: Column,
    description: Column,
    evidence: Column,
    causes: Column,
    column: Column | None = None,
    ordinal: Column | None = None,
    correlated: Column | None = None,
) -> DataFrame:
    return df.select(
        F.lit(detector).alias("detector"),
        (F.lit(-1) if ordinal is None else ordinal).alias("ordinal"),
        F.lit(dimension).alias("dimension"),
        severity.alias("severity"),
        title.alias("title"),
        (F.lit(DATASET) if column is None else column).alias("affected_column"),
        rows.cast("bigint").alias("affected_rows"),
        pct.cast("double").alias("affected_pct"),
        description.alias("description"),
        evidence.alias("evidence"),
        causes.alias("possible_root_causes"),
        (F.array().cast("array<string>") if correlated is None else correlated).alias("correlated_columns"),
    )


def correlated_columns(overlaps: DataFrame, column_profile: DataFrame, cfg: Config) -> DataFrame:
    """Columns missing together with each column, in column order."""
    names = column_profile.select(F.col("ordinal").alias("other"), F.col("name").alias("other_name"))
    return (
        overlaps.where(F.col("jaccard") >= cfg.jaccard)
        .join(names, "other")
        .groupBy("ordinal")
        .agg(
            F.transform(F.array_sort(F.collect_list(F.struct("other", "other_name"))), lambda s: s["other_name"]).alias(
                "correlated"
            )
        )
    )


def missing_issues(column_profile: DataFrame, overlaps: DataFrame, cfg: Config) -> DataFrame:
    together = F.coalesce(F.col("correlated"), F.array().cast("array<string>"))
    df = (
        column_profile.where(F.col("missing_pct") >= cfg.missing_issue_pct)
        .join(correlated_columns(overlaps, column_profile, cfg), "ordinal", "left")
        .withColumn("together", together)
        .withColumn("linked", F.size("together") > 0)
    )
    name, pct, linked = F.col("name"), F.col("missing_pct"), F.col("linked")
    causes = F.array_compact(
        F.array(
            F.when(linked, F.format_string(w.CAUSE_CORRELATED, listed(F.col("together")))),
            F.when(pct > 50, w.CAUSE_MOSTLY_MISSING).otherwise(w.CAUSE_MISSING),
        )
    )
    return _issue(
        df,
        1,
        "completeness",
        severity=severity(pct),
        title=F.format_string(w.MISSING_TITLE, name),
        rows=F.col("missing_count"),
        pct=pct,
        description=F.concat(
            F.format_string(w.MISSING_TEXT, name, F.col("missing_count"), pct),
            F.when(linked, F.format_string(w.MISSING_TOGETHER, listed(F.col("together")))).otherwise(""),
        ),
        evidence=_evidence(missing_count="missing_count", missing_pct="missing_pct"),
        causes=causes,
        column=name,
        ordinal=F.col("ordinal"),
        correlated=F.col("together"),
    )


def _cluster_list(clusters: DataFrame, order: str, fields: list[Column], alias: str) -> DataFrame:
    rows = F.collect_list(F.struct(F.col(order).alias("order"), F.struct(*fields).alias("cluster")))
    return clusters.groupBy("ordinal").agg(F.transform(F.array_sort(rows), lambda s: s["cluster"]).alias(alias))


def outlier_issues(column_profile: DataFrame, category_clusters: DataFrame, date_clusters: DataFrame) -> DataFrame:
    categories = _cluster_list(
        category_clusters,
        "category_ordinal",
        [F.col("category_column").alias("column"), "top_value", "outlier_count", "concentration_pct", "base_count"],
        "categories",
    )
    windows = _cluster_list(
        date_clusters,
        "date_ordinal",
        [
            F.col("date_column").alias("column"),
            "window_days",
            F.col("from_date").cast("string").alias("from"),
            F.col("to_date").cast("string").alias("to"),
            "outlier_count_in_window",
        ],
        "windows",
    )
    df = (
        column_profile.where(F.col("outlier_count") > 0)
        .join(categories, "ordinal", "left")
        .join(windows, "ordinal", "left")
        .withColumn("categories", F.coalesce("categories", F.array().cast(_EVIDENCE["category_clusters"])))
        .withColumn("windows", F.coalesce("windows", F.array().cast(_EVIDENCE["date_clusters"])))
    )
    name, pct = F.col("name"), F.col("outlier_pct")

    def window_cause(d: Column) -> Column:
        share = F.floor(d["outlier_count_in_window"] / F.col("outlier_count") * 100.0 + 0.5)
        return F.format_string(w.CAUSE_WINDOW, share.cast("string"), d["from"], d["to"], d["window_days"], d["column"])

    def category_cause(c: Column) -> Column:
        return F.format_string(w.CAUSE_CATEGORY, plain_number(c["concentration_pct"]), c["column"], c["top_value"])

    found = F.concat(F.transform("windows", window_cause), F.transform("categories", category_cause))
    return _issue(
        df,
        2,
        "validity",
        severity=severity(pct),
        title=F.format_string(w.OUTLIER_TITLE, name),
        rows=F.col("outlier_count"),
        pct=pct,
        description=F.concat(
            F.format_string(w.OUTLIER_TEXT, name, F.col("outlier_count"), pct),
            F.when(F.col("q1").isNotNull(), F.format_string(w.OUTLIER_RANGE, F.col("q1"), F.col("q3"))).otherwise(""),
        ),
        evidence=_evidence(
            **{c: c for c in ("outlier_count", "outlier_pct", "min", "max", "q1", "q3", "mean")},
            category_clusters="categories",
            date_clusters="windows",
        ),
        causes=F.when(F.size(found) > 0, found).otherwise(_texts(*w.CAUSES_OUTLIER)),
        column=name,
        ordinal=F.col("ordinal"),
        correlated=F.transform("categories", lambda c: c["column"]),
    )


def format_issues(column_profile: DataFrame) -> DataFrame:
    name, n = F.col("name"), F.col("format_issues")
    pct = percent(n, F.col("total_rows"))
    return _issue(
        column_profile.where(n > 0),
        3,
        "consistency",
        severity=severity(pct),
        title=F.format_string(w.FORMAT_TITLE, name),
        rows=n,
        pct=pct,
        description=F.format_string(w.FORMAT_TEXT, name, n, pct, listed(F.col("format_issue_examples"))),
        evidence=_evidence(format_issue_count="format_issues", examples="format_issue_examples"),
        causes=_texts(*w.CAUSES_FORMAT),
        column=name,
        ordinal=F.col("ordinal"),
    )


def duplicate_issues(dataset_profile: DataFrame) -> DataFrame:
    n, pct = F.col("duplicate_count"), F.col("duplicate_pct")
    return _issue(
        dataset_profile.where(n > 0),
        4,
        "uniqueness",
        severity=severity(pct),
        title=F.lit(w.DUPLICATE_TITLE),
        rows=n,
        pct=pct,
        description=F.format_string(w.DUPLICATE_TEXT, n, pct),
        evidence=_evidence(duplicate_count="duplicate_count", duplicate_pct="duplicate_pct"),
        causes=_texts(*w.CAUSES_DUPLICATE),
    )


def schema_issues(dataset_profile: DataFrame) -> DataFrame:
    n = F.size("schema_issues")
    return _issue(
        dataset_profile.where(n > 0),
        5,
        "schema",
        severity=F.when(n >= 3, "HIGH").otherwise("MEDIUM"),
        title=F.format_string(w.SCHEMA_TITLE, n),
        rows=F.lit(0),
        pct=F.lit(0.0),
        description=F.array_join("schema_issues", " | "),
        evidence=_evidence(schema_issues="schema_issues"),
        causes=_texts(*w.CAUSES_SCHEMA),
    )


def freshness_issues(dataset_profile: DataFrame) -> DataFrame:
    days = F.col("freshness_days")
    return _issue(
        dataset_profile.where(F.col("freshness_flag") == "STALE"),
        6,
        "freshness",
        severity=F.when(days > 90, "HIGH").otherwise("MEDIUM"),
        title=F.format_string(w.STALE_TITLE, days.cast("bigint")),
        rows=F.lit(0),
        pct=F.lit(0.0),
        description=F.format_string(w.STALE_TEXT, days.cast("bigint")),
        evidence=_evidence(freshness_days="freshness_days", freshness_flag="freshness_flag"),
        causes=_texts(*w.CAUSES_STALE),
    )


def ranked(issues: DataFrame) -> DataFrame:
    """Number issues by severity, then share of rows, then detector and column order."""
    # A table of issues has a few rows per column, so one sorted group is enough.
    order = W.orderBy(severity_rank(F.col("severity")), F.desc("affected_pct"), "detector", "ordinal")
    return issues.withColumn("ord", F.row_number().over(order))


def issue_summary(issues: DataFrame) -> DataFrame:
    """One row: counts by severity and a sentence about the first issue."""
    sev = F.col("severity")
    first = F.min_by(F.struct("title", "affected_pct", F.col("possible_root_causes")[0].alias("cause")), "ord")
    counted = issues.agg(
        F.count(F.lit(1)).alias("total_issues"),
        F.count_if(sev == "HIGH").alias("high_severity"),
        F.count_if(sev == "MEDIUM").alias("medium_severity"),
        F.count_if(sev == "LOW").alias("low_severity"),
        first.alias("first"),
    )
    counts = [F.col(c) for c in ("total_issues", "high_severity", "medium_severity", "low_severity")]
    return counted.select(
        *counts,
        F.col("first.title").alias("first_title"),
        F.when(F.col("total_issues") == 0, w.NO_ISSUES)
        .otherwise(
            F.format_string(
                w.ISSUE_SUMMARY, *counts, F.col("first.title"), F.col("first.affected_pct"), F.col("first.cause")
            )
        )
        .alias("summary"),
    )


