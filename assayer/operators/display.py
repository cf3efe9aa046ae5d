"""Derived display metrics of profiles and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.grades import WEIGHTS, ladder
from assayer.functions.numbers import clamp, round_half_up

# Traffic-light limits, each (bad above, warn above).
BANDS = {
    "missing": (10.0, 3.0),
    "duplicates": (5.0, 1.0),
    "column_missing": (20.0, 5.0),
    "column_outliers": (10.0, 2.0),
    "numeric_outliers": (5.0, 1.0),
}
BAR_COLUMNS = 6


def band(pct: Column, name: str) -> Column:
    bad, warn = BANDS[name]
    return ladder(pct, (("bad", bad), ("warn", warn), ("ok", None)), strict=True)


def column_health(column_profile: DataFrame) -> DataFrame:
    missing, outliers = F.col("missing_pct"), F.col("outlier_pct")
    worst = (
        F.when((missing > 20) | (outliers > 10), "bad")
        .when((missing > 5) | (outliers > 2) | (F.col("format_issues") > 0), "warn")
        .otherwise("ok")
    )
    return column_profile.select("ordinal", "name", "missing_pct", "outlier_pct", "format_issues", worst.alias("status"))


def metric_bands(column_profile: DataFrame, dataset_profile: DataFrame) -> DataFrame:
    """(metric, subject, pct, band) for the dataset and every column."""
    def rows(df: DataFrame, metric: str, subject: Column, pct: str) -> DataFrame:
        return df.select(
            F.lit(metric).alias("metric"), subject.alias("subject"), F.col(pct).alias("pct"), band(F.col(pct), metric).alias("band")
        )

    numeric = column_profile.where(F.col("mean").isNotNull())
    return (
        rows(dataset_profile, "missing", F.lit("__dataset__"), "missing_cell_pct")
        .unionByName(rows(dataset_profile, "duplicates", F.lit("__dataset__"), "duplicate_pct"))
        .unionByName(rows(column_profile, "column_missing", F.col("name"), "missing_pct"))
        .unionByName(rows(column_profile, "column_outliers", F.col("name"), "outlier_pct"))
        .unionByName(rows(numeric, "numeric_outliers", F.col("name"), "outlier_pct"))
    )


def boxplot_positions(column_profile: DataFrame) -> DataFrame:
    """Quartiles on a 0-100 scale between minimum and maximum; 25/50/75 for a flat column."""
    width = F.nullif(F.col("max") - F.col("min"), F.lit(0.0))

    def place(c: str, flat: float) -> Column:
        return round_half_up(F.coalesce(clamp((F.col(c) - F.col("min")) / width * 100.0, 0, 100), F.lit(flat)), 1)

    spots = {"q1_pos": place("q1", 25.0), "median_pos": place("median", 50.0), "q3_pos": place("q3", 75.0)}
    return column_profile.where(F.col("mean").isNotNull()).select(
        "ordinal",
        "name",
        *[c.alias(n) for n, c in spots.items()],
        round_half_up(F.greatest(F.lit(0.0), spots["q3_pos"] - spots["q1_pos"]), 1).alias("width"),
    )


def category_bars(column_profile: DataFrame) -> DataFrame:
    """Top values of the first categorical columns, relative to the most frequent one."""
    some = column_profile.where(F.size("top_values") > 0)
    first = some.withColumn("place", F.row_number().over(W.orderBy("ordinal"))).where(F.col("place") <= BAR_COLUMNS)
    bars = first.select("ordinal", "name", F.posexplode("top_values").alias("pos", "v"))
    most = F.max("v.count").over(W.partitionBy("ordinal"))
    return bars.select(
        "ordinal",
        "name",
        (F.col("pos") + 1).alias("rank"),
        F.col("v.value").alias("value"),
        F.col("v.count").alias("count"),
        round_half_up(F.col("v.count") / most * 100.0, 1).alias("bar_pct"),
    )


def dimension_breakdown(score: DataFrame) -> DataFrame:
    notes = {
        "completeness": F.lit("share of cells that hold a value"),
        "validity": F.lit("share of rows inside the near fences"),
        "uniqueness": F.lit("share of rows that are no copy"),
        "consistency": F.lit("less the share of ill-formed texts"),
        "freshness": F.format_string(
            "newest record %d days old: %s", F.coalesce("freshness_days", F.lit(0.0)).cast("bigint"), F.col("freshness_flag")
        ),
        "schema": F.format_string("%d faults of the schema", F.col("schema_issue_count")),
    }
    rows = [
        F.struct(
            F.lit(d).alias("dimension"),
            F.col(d).alias("score"),
            F.lit(WEIGHTS[d]).alias("weight"),
            round_half_up(F.col(d) * F.lit(WEIGHTS[d]), 2).alias("contribution"),
            notes[d].alias("note"),
        )
        for d in notes
    ]
    return score.select(F.inline(F.array(*rows)))
