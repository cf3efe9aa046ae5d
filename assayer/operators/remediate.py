"""Fixes for the issues the profile finds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.config import Config
from assayer.functions.numbers import INTEGER_PATTERN, count_where, outside_fences, percent, text_to_number
from assayer.functions.texts import strip
from assayer.functions.times import whole_days
from assayer.operators.columns import column_specs, quoted
from assayer.operators.duplicates import split_repeated
from assayer.operators.outliers import Spread
from assayer.operators.quantiles import QUARTILES, exact_quantiles, grouped_quantiles
from assayer.operators.values import value_counts
from assayer.sources.workspace import written

INTEGERS = ("tinyint", "smallint", "int", "bigint")


def _spec(df: DataFrame, column: str):
    return next(s for s in column_specs(df) if s.name == column)


def _any_missing(df: DataFrame, columns: Sequence[str]):
    test = F.lit(False)
    for c in columns:
        test = test | _spec(df, c).value.isNull()
    return test


def quarantine(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with a missing value in any of the columns."""
    return df.where(_any_missing(df, columns))


def clean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows that ``quarantine`` leaves."""
    return df.where(~_any_missing(df, columns))


def spread_of(df: DataFrame, column: str, cfg: Config) -> Spread | None:
    """Quartiles of one numeric column."""
    x = _spec(df, column).number
    n = df.agg(F.count(x)).first()[0]
    return Spread(*exact_quantiles(df, {0: x}, {0: n}, QUARTILES, cfg)[0]) if n else None


def impute_median(df: DataFrame, column: str, cfg: Config | None = None) -> DataFrame:
    """Fill missing numbers with the median and mark them in ``<column>_imputed``."""
    spec, spread = _spec(df, column), spread_of(df, column, cfg or Config())
    fill = F.lit(spread.median if spread else None).cast("double")
    return df.withColumn(f"{column}_imputed", spec.value.isNull()).withColumn(
        column, F.coalesce(spec.value.cast("double"), fill)
    )


def impute_mode(df: DataFrame, column: str) -> DataFrame:
    """Fill missing text with the most frequent value (smallest on ties) and mark it."""
    counts = value_counts(df, [_spec(df, column)])
    top = counts.orderBy(F.desc("n"), F.asc("value")).limit(1).first()
    fill = F.lit(top["value"] if top else None).cast("string")
    return df.withColumn(f"{column}_imputed", quoted(column).isNull()).withColumn(
        column, F.coalesce(quoted(column), fill)
    )


def range_violations(df: DataFrame, column: str, cfg: Config | None = None) -> DataFrame:
    """Rows outside the far fences of a column."""
    cfg = cfg or Config()
    s = spread_of(df, column, cfg)
    return df.where(outside_fences(_spec(df, column).number, s.q1, s.q3, cfg.far_fence)) if s else df.limit(0)


def recalculated_kpi(df: DataFrame, column: str, cfg: Config | None = None) -> DataFrame:
    """One row: count, sum and mean with and without far outliers."""
    cfg = cfg or Config()
    s, x = spread_of(df, column, cfg), _spec(df, column).number
    if s is None:
        raise ValueError(f"column {column} holds no numbers")
    kept = F.when(~outside_fences(x, s.q1, s.q3, cfg.far_fence), x)
    return df.agg(
        F.count(x).alias("rows_all"),
        F.count(kept).alias("rows_kept"),
        F.sum(x).alias("sum_all"),
        F.sum(kept).alias("sum_kept"),
        F.avg(x).alias("mean_all"),
        F.avg(kept).alias("mean_kept"),
    )


def standardise(df: DataFrame, casts: Mapping[str, str | None], lower: Sequence[str] = ()) -> DataFrame:
    """Strip the given text columns, lower-case some, and cast those with a target type.

    Text that does not fit its target type becomes null.
    """
    out = {}
    for column, target in casts.items():
        c = strip(quoted(column))
        if column in lower:
            c = F.lower(c)
        if target:
            if target in INTEGERS:  # never through double, which would lose digits
                c = F.when(c.rlike(INTEGER_PATTERN), c.try_cast(target))
            else:
                c = text_to_number(c) if target == "double" else c.try_cast(target)
        out[column] = c
    return df.withColumns(out)


def keep_latest(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str] = ()) -> DataFrame:
    """One row per key: the latest by ``time``, then by the tie columns, all descending.

    Only rows whose key occurs again are shuffled and ordered; each task keeps one of them per key before
    that, so a hot key stays small. The others stay where they are (see ``split_repeated``).
    """
    single, several = split_repeated(df, keys)
    order = W.partitionBy(*[quoted(k) for k in keys]).orderBy(
        quoted(time).desc_nulls_last(), *[quoted(t).desc_nulls_last() for t in ties]
    )
    latest = several.withColumn("__place", F.row_number().over(order)).where(F.col("__place") == 1).drop("__place")
    return single.union(latest)


def drop_copies(df: DataFrame) -> DataFrame:
    """Each row once. Only rows whose fingerprint occurs again are shuffled whole and compared."""
    single, several = split_repeated(df, df.columns)
    return single.union(several.dropDuplicates())


def schema_contract(df: DataFrame, contract: Mapping[str, str]) -> DataFrame:
    """(column, expected, actual, failed_rows, failed_pct): values that do not fit the contract.

    A column that the table lacks fails on every row.
    """
    specs = {s.name: s for s in column_specs(df)}
    def fits(name: str, expected: str):
        c = quoted(name)
        if specs[name].kind == "text" and expected in INTEGERS:
            return c.rlike(INTEGER_PATTERN) & c.try_cast(expected).isNotNull()
        if specs[name].kind == "text" and expected in ("float", "double"):
            return text_to_number(c).isNotNull()
        return c.try_cast(expected).isNotNull()

    counts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[
            (count_where(quoted(c).isNotNull() & ~fits(c, t)) if c in specs else F.count(F.lit(1))).alias(f"f{i}")
            for i, (c, t) in enumerate(contract.items())
        ],
    )
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.lit(t).alias("expected"),
            F.lit(specs[c].dtype if c in specs else "absent").alias("actual"),
            F.col(f"f{i}").alias("failed_rows"),
            percent(F.col(f"f{i}"), F.col("total")).alias("failed_pct"),
        )
        for i, (c, t) in enumerate(contract.items())
    ]
    return counts.select(F.inline(F.array(*rows)))


def freshness_sla(df: DataFrame, time: str, as_of: datetime, hours: int = 24) -> DataFrame:
    """One row: latest time, its age, and whether it breaks the limit."""
    now = F.lit(as_of.isoformat(sep=" ")).cast("timestamp_ntz")
    latest = df.agg(F.max(_spec(df, time).time).alias("latest"))
    age = F.floor(F.timestamp_diff("SECOND", F.col("latest"), now) / F.lit(3600.0))
    return latest.select(
        "latest",
        age.cast("bigint").alias("age_hours"),
        whole_days(now, F.col("latest")).alias("age_days"),
        F.coalesce(F.timestamp_diff("SECOND", F.col("latest"), now) > hours * 3600, F.lit(True)).alias("violated"),
    )


def segment_outliers(df: DataFrame, segment: str, column: str, cfg: Config | None = None) -> DataFrame:
    """Rows outside the near fences of their own segment.

    Segments may be of any number and size. The fences have one row per segment and are a written table; Spark
    sends them to all tasks if it is small, and else splits large segments in the join.
    """
    cfg = cfg or Config()
    fences = grouped_quantiles(
        df.select(quoted(segment).alias("segment"), _spec(df, column).number.alias("x")), ["segment"], "x", (0.25, 0.75), cfg
    ).select(
        F.col("segment").alias("__segment"), F.col("quantiles")[0].alias("segment_q1"), F.col("quantiles")[1].alias("segment_q3")
    )
    flagged = df.join(written(fences, "fences"), quoted(segment).eqNullSafe(F.col("__segment")), "inner")
    return flagged.where(
        outside_fences(_spec(df, column).number, F.col("segment_q1"), F.col("segment_q3"), cfg.fence)
    ).drop("__segment")
