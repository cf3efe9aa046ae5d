"""Outlier counts, and where outliers gather."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.config import Config
from assayer.functions.numbers import count_where, outside_fences
from assayer.operators.columns import quoted
from assayer.operators.facts import ColumnFacts, Facts, is_dated, is_numeric, negatives, one_row
from assayer.operators.small import small_frame
from assayer.operators.values import most_common


@dataclass(frozen=True)
class Spread:
    """Unrounded quartiles of a column."""

    q1: float
    median: float
    q3: float


@dataclass(frozen=True)
class OutlierFacts:
    near: int  # outside the near fences, 0 if the column is too small or flat
    far: int  # outside the far fences
    far_sum: float | None

    def column_count(self, negative: int) -> int:
        return max(self.near, negative)


def near_fences_apply(facts: ColumnFacts, spread: Spread, cfg: Config) -> bool:
    return facts.numeric >= cfg.min_outlier_values and spread.q3 != spread.q1


def date_columns(facts: Facts, cfg: Config) -> list[ColumnFacts]:
    """The date columns that outliers are placed on."""
    return [c for c in facts.columns if is_dated(c, cfg)]


def time_of(c: ColumnFacts) -> Column:
    return c.spec.time if c.spec.kind == "time" else c.layout.time(quoted(c.spec.name))


@dataclass(frozen=True)
class OutlierScan:
    columns: dict[int, OutlierFacts]
    any_rows: int
    windows: dict[tuple[int, int], tuple[datetime, datetime, int]]


def near_flag(c: ColumnFacts, x: Column, spread: Spread, cfg: Config) -> Column | None:
    """Row test behind the count of rows with an outlier in any column."""
    negative = negatives(c, cfg)
    tests = []
    if negative:
        tests.append(F.coalesce(x < 0, F.lit(False)))
    if near_fences_apply(c, spread, cfg) or negative:
        tests.append(outside_fences(x, spread.q1, spread.q3, cfg.fence))
    return None if not tests else tests[0] if len(tests) == 1 else tests[0] | tests[1]


def scan_outliers(df: DataFrame, facts: Facts, spreads: dict[int, Spread], cfg: Config) -> OutlierScan:
    """One flat aggregate over the numeric columns, with the fences as literals."""
    wanted: dict[str, Column] = {}
    flags = []
    dates = date_columns(facts, cfg)
    # Numbers and times are read once per row, before the aggregates use them many times.
    base = df.select(
        *[facts.columns[o].spec.number.alias(f"x{o}") for o in spreads],
        *[time_of(d).alias(f"t{d.spec.ordinal}") for d in dates],
    )
    for o, s in spreads.items():
        c, x = facts.columns[o], F.col(f"x{o}")
        far = outside_fences(x, s.q1, s.q3, cfg.far_fence)
        if near_fences_apply(c, s, cfg):
            wanted[f"near_{o}"] = count_where(outside_fences(x, s.q1, s.q3, cfg.fence))
        wanted[f"far_{o}"] = count_where(far)
        wanted[f"sum_{o}"] = F.sum(F.when(far, x))
        if not is_numeric(c, cfg):
            continue
        flag = near_flag(c, x, s, cfg)
        if flag is not None:
            flags.append(flag)
        for d in dates:
            t = F.when(far, F.col(f"t{d.spec.ordinal}"))
            p = f"{o}_{d.spec.ordinal}"
            wanted |= {f"from_{p}": F.min(t), f"to_{p}": F.max(t), f"dated_{p}": F.count(t)}
    if flags:
        either = flags[0]
        for f in flags[1:]:
            either = either | f
        # The widest expression: it reads all numeric columns, so it goes in first.
        wanted = {"any": count_where(either), **wanted}
    got = one_row(base, wanted, cfg.aggregates_per_pass) if wanted else {}

    columns = {
        o: OutlierFacts(got.get(f"near_{o}", 0), got[f"far_{o}"], got[f"sum_{o}"]) for o in spreads
    }
    windows = {}
    for key, n in got.items():
        if key.startswith("dated_") and n:
            o, d = (int(p) for p in key.split("_")[1:])
            windows[o, d] = (got[f"from_{o}_{d}"], got[f"to_{o}_{d}"], n)
    return OutlierScan(columns, got.get("any", 0), windows)


DATE_CLUSTERS = (
    "ordinal int, date_ordinal int, date_column string, window_days bigint, "
    "from_date date, to_date date, outlier_count_in_window bigint"
)


def date_clusters(df: DataFrame, facts: Facts, scan: OutlierScan, cfg: Config) -> DataFrame:
    """Columns whose far outliers all lie within a few days of a date column."""
    rows = []
    for (o, d), (start, end, n) in sorted(scan.windows.items()):
        c = facts.columns[o]
        days = (end - start).days
        if scan.columns[o].column_count(negatives(c, cfg)) and days <= cfg.cluster_window_days:
            rows.append(
                {
                    "ordinal": o,
                    "date_ordinal": d,
                    "date_column": facts.columns[d].spec.name,
                    "window_days": days,
                    "from_date": _day(start),
                    "to_date": _day(end),
                    "outlier_count_in_window": n,
                }
            )
    return small_frame(df.sparkSession, rows, DATE_CLUSTERS)


def _day(t: datetime) -> date:
    return t.date()


CATEGORY_CLUSTERS = (
    "ordinal int, category_ordinal int, category_column string, top_value string, "
    "outlier_count bigint, concentration_pct double, base_count bigint"
)


def outlier_categories(df: DataFrame, facts: Facts, spreads: dict[int, Spread], scan: OutlierScan, cfg: Config) -> DataFrame:
    """Most frequent value of each text column among the far outliers of each column.

    Each row lists the columns it is a far outlier of, and only these, once, and its texts, once. Only outlier rows
    are spread, over the one and then the other, and counted before the shuffle; so the work grows with the sum of
    the columns and the texts of outliers, not with the product of the columns.
    """
    texts = [c.spec for c in facts.columns if c.spec.kind == "text"]
    flags = []
    for o, found in scan.columns.items():
        c, s = facts.columns[o], spreads[o]
        if is_numeric(c, cfg) and found.far and found.column_count(negatives(c, cfg)):
            flags.append(F.when(outside_fences(c.spec.number, s.q1, s.q3, cfg.far_fence), F.lit(o)))
    if not flags or not texts:
        return small_frame(df.sparkSession, [], "ordinal int, category_ordinal int, value string, n bigint, rank int")
    names = [str(t.ordinal) for t in texts]
    far = F.array_compact(F.array(*flags)).alias("far")
    cells = df.where(F.coalesce(*flags).isNotNull()).select(far, *[quoted(t.name).alias(n) for t, n in zip(texts, names)])
    counts = (
        cells.unpivot(["far"], names, "category_ordinal", "value")
        .where(F.col("value").isNotNull())
        .select(F.explode("far").alias("ordinal"), F.col("category_ordinal").cast("int").alias("category_ordinal"), "value")
        .where(F.col("ordinal") != F.col("category_ordinal"))
        .groupBy("ordinal", "category_ordinal", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return most_common(counts, ["ordinal", "category_ordinal"], 1)


def category_clusters(df: DataFrame, facts: Facts, spreads: dict[int, Spread], scan: OutlierScan, cfg: Config) -> DataFrame:
    """Text values that hold a large part of a column's outliers, and their size in the table."""
    rows = []
    for top in outlier_categories(df, facts, spreads, scan, cfg).collect():  # columns x text columns at most
        total = scan.columns[top["ordinal"]].column_count(negatives(facts.columns[top["ordinal"]], cfg))
        if top["n"] / total >= cfg.concentration and top["n"] >= cfg.min_cluster_rows:
            rows.append((top, total))
    if not rows:
        return small_frame(df.sparkSession, [], CATEGORY_CLUSTERS)
    spec = {c.spec.ordinal: c.spec for c in facts.columns}
    named = {(t["category_ordinal"], t["value"]) for t, _ in rows}
    # One count per cluster, by column, so that each pass reads few columns.
    wanted = {cell: f"c{i}" for i, cell in enumerate(sorted(named))}
    got = one_row(df, {n: count_where(quoted(spec[o].name) == F.lit(v)) for (o, v), n in wanted.items()}, cfg.aggregates_per_pass)
    sizes = {cell: got[n] for cell, n in wanted.items()}
    out = [
        {
            "ordinal": t["ordinal"],
            "category_ordinal": t["category_ordinal"],
            "category_column": spec[t["category_ordinal"]].name,
            "top_value": t["value"],
            "outlier_count": t["n"],
            "concentration_pct": int(t["n"] / total * 1000.0 + 0.5) / 10.0,
            "base_count": sizes[t["category_ordinal"], t["value"]],
        }
        for t, total in rows
    ]
    out.sort(key=lambda r: (r["ordinal"], r["category_ordinal"]))
    return small_frame(df.sparkSession, out, CATEGORY_CLUSTERS)
