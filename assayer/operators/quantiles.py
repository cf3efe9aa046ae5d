"""Exact quantiles without sorting or collecting the data.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here each
wanted rank is narrowed down: as long as its interval holds many values, a sketch of
bounded size proposes a smaller one, exact counts confirm it, and only the values inside
go to the next step; the few values left at last are ranked. With the default sketch an
interval keeps about one value in 180, so a trillion rows take four rounds. A value
held by very many rows ends the search as soon as it becomes the edge of an interval.
The sketch is random, but it only proposes: the result is exact and repeatable.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.config import Config
from assayer.functions.numbers import count_where
from assayer.operators.facts import one_row
from assayer.sources.workspace import written

QUARTILES = (0.25, 0.5, 0.75)

# Sketches (a few hundred KB each in a task) and value maps evaluated together in one scan.
_SKETCHES = 32
# Groups that merge the sketches of a scan, and groups that merge theirs, before one task merges the rest.
_BUCKETS = (4096, 64)


@dataclass
class _Rank:
    """Search state of one order statistic: it lies strictly between ``low`` and ``high``."""

    key: int
    index: int  # position among all values, from 0
    size: int  # values inside the interval
    below: int = 0  # values left of the interval
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self) -> Column:
        v = F.col(f"v{self.key}")
        test = F.lit(True)
        if self.low is not None:
            test = test & (v > F.lit(self.low))
        if self.high is not None:
            test = test & (v < F.lit(self.high))
        return F.when(test, v)


def _positions(fraction: float, n: int) -> tuple[int, int, float]:
    position = fraction * (n - 1)
    k = math.floor(position)
    return k, min(k + 1, n - 1), position - k


def exact_quantiles(
    df: DataFrame,
    numbers: dict[int, Column],
    counts: dict[int, int],
    fractions: tuple[float, ...],
    cfg: Config,
) -> dict[int, list[float]]:
    """Linear-interpolated quantiles of several columns, keyed like ``numbers``.

    ``counts`` holds the number of non-null values per column, all above zero.
    """
    if not numbers:
        return {}
    base = df.select(*[c.alias(f"v{k}") for k, c in numbers.items()])
    if cfg.quantiles == "approx":
        got = one_row(
            base,
            {f"v{k}": F.approx_percentile(F.col(f"v{k}"), list(fractions), cfg.quantile_accuracy) for k in numbers},
            _SKETCHES,
        )
        return {k: list(got[f"v{k}"]) for k in numbers}

    ranks = {
        (k, i): _Rank(k, i, counts[k])
        for k in numbers
        for f in fractions
        for i in _positions(f, counts[k])[:2]
    }
    while True:
        wide = [r for r in ranks.values() if r.value is None and r.size > cfg.quantile_values]
        if not wide:
            break
        _narrow(base, wide, cfg)
    _select(base, [r for r in ranks.values() if r.value is None], cfg)

    out: dict[int, list[float]] = {k: [] for k in numbers}
    for k in numbers:
        for f in fractions:
            i, j, d = _positions(f, counts[k])
            out[k].append(ranks[k, i].value * (1.0 - d) + ranks[k, j].value * d)
    return out


def _narrow(base: DataFrame, ranks: list[_Rank], cfg: Config) -> None:
    """One round: sketch an interval around each rank, then count what it really holds."""
    # Twice the rank error that a sketch of this size keeps to in 99 of 100 cases.
    slack = 2.0 * 2.296 / cfg.sketch_size**0.9021
    groups: dict[tuple, list[_Rank]] = {}
    for r in ranks:
        groups.setdefault((r.key, r.low, r.high), []).append(r)
    members = list(groups.values())
    sketches, wanted = {}, {}
    for g, same in enumerate(members):
        sketches[f"g{g}"] = F.kll_sketch_agg_double(same[0].inside(), F.lit(cfg.sketch_size))
        shares = [(r.index - r.below) / (r.size - 1) for r in same]
        wanted[f"g{g}"] = [min(1.0, max(0.0, f + side)) for f in shares for side in (-slack, slack)]
    edges: dict[str, list[float]] = {}
    names = list(sketches)
    for i in range(0, len(names), _SKETCHES):
        part = names[i : i + _SKETCHES]
        # Sketches of all tasks would meet in one task; they are merged in buckets first.
        many, few = _BUCKETS
        merge = [F.kll_merge_agg_double(n, F.lit(cfg.sketch_size)).alias(n) for n in part]
        some = base.groupBy((F.spark_partition_id() % many).alias("bucket")).agg(*[sketches[n].alias(n) for n in part])
        found = some.groupBy(F.col("bucket") % few).agg(*merge).agg(*merge)
        at = [F.kll_sketch_get_quantile_double(n, F.array(*[F.lit(f) for f in wanted[n]])).alias(n) for n in part]
        edges |= found.select(*at).first().asDict()

    counts: dict[str, Column] = {}
    proposals: list[tuple[_Rank, float, float, str]] = []
    for g, same in enumerate(members):
        for m, r in enumerate(same):
            a, b = edges[f"g{g}"][2 * m : 2 * m + 2]
            tag, x = f"g{g}_{a!r}_{b!r}", r.inside()
            counts[f"{tag}_lt"] = count_where(x < F.lit(a))
            counts[f"{tag}_a"] = count_where(x <= F.lit(a))
            counts[f"{tag}_mid"] = count_where(x < F.lit(b))
            counts[f"{tag}_b"] = count_where(x <= F.lit(b))
            proposals.append((r, a, b, tag))
    got = one_row(base, counts, cfg.aggregates_per_pass)

    for r, a, b, tag in proposals:
        left, to_a, before_b, to_b = (got[f"{tag}_{s}"] for s in ("lt", "a", "mid", "b"))
        at_a, at_b = to_a - left, 0 if a == b else to_b - before_b
        middle = 0 if a == b else before_b - to_a
        place = r.index - r.below
        if place < left:
            r.high, r.size = a, left
        elif place < left + at_a:
            r.value = a
        elif place < left + at_a + middle:
            r.low, r.high, r.below, r.size = a, b, r.below + left + at_a, middle
        elif place < left + at_a + middle + at_b:
            r.value = b
        else:
            taken = left + at_a + middle + at_b
            r.low, r.below, r.size = b, r.below + taken, r.size - taken


def _sql(x: float) -> str:
    return f"double('{x!r}')"


def _select(base: DataFrame, ranks: list[_Rank], cfg: Config) -> None:
    """Pick the ranks whose intervals hold few values."""
    picks = {}
    for r in ranks:
        tests = [f"v{r.key} IS NOT NULL"]
        if r.low is not None:
            tests.append(f"v{r.key} > {_sql(r.low)}")
        if r.high is not None:
            tests.append(f"v{r.key} < {_sql(r.high)}")
        # The middle of the wanted step of the cumulative distribution, safe from rounding.
        share = (r.index - r.below + 0.5) / r.size
        picks[f"k{r.key}_{r.index}"] = F.expr(
            f"percentile_disc({share!r}) WITHIN GROUP (ORDER BY v{r.key}) FILTER (WHERE {' AND '.join(tests)})"
        )
    if picks:
        got = one_row(base, picks, _SKETCHES)
        for r in ranks:
            r.value = got[f"k{r.key}_{r.index}"]


# Grid of the grouped sketch; a round keeps about three cells of it per rank.
_GRID = 200


def grouped_quantiles(
    df: DataFrame, keys: list[str], value: str, fractions: tuple[float, ...], cfg: Config
) -> DataFrame:
    """Quantiles of ``value`` per group: one row per group with array column ``quantiles``.

    Only the few values left of a group are brought to one task. The search state has a
    few rows per group and is written to the checkpoint folder after each round.
    """
    data = df.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    sizes = written(data.groupBy(*keys).agg(F.count("v").alias("n")), "group-sizes")
    return _search_groups(data, sizes, keys, fractions, cfg)


def _join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    test = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return left.join(right, test, how).drop(*[f"__{k}" for k in keys])


def _search_groups(
    data: DataFrame, sizes: DataFrame, keys: list[str], fractions: tuple[float, ...], cfg: Config
) -> DataFrame:
    position = F.col("fraction") * (F.col("n") - 1)
    base = (
        sizes.withColumn("fraction", F.explode(F.array(*[F.lit(float(f)) for f in fractions])))
        .withColumn("lower", F.floor(position))
        .withColumn("upper", F.least(F.col("lower") + 1, F.col("n") - 1))
        .withColumn("share", position - F.col("lower"))
    )
    state = (
        base.select(*keys, "n", F.explode(F.array("lower", "upper")).alias("index"))
        .distinct()
        .select(
            *keys,
            "index",
            F.col("n").alias("size"),
            F.lit(0).cast("bigint").alias("below"),
            F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("high"),
            F.lit(None).cast("double").alias("value"),
        )
    )
    unknown = F.col("value").isNull()
    v = F.col("v")
    within = (F.col("low").isNull() | (v > F.col("low"))) & (F.col("high").isNull() | (v < F.col("high")))
    while True:
        state = written(state, "group-state")
        wide = state.where(unknown & (F.col("size") > cfg.quantile_values))
        if wide.isEmpty():
            break
        # Ranks that share an interval share its sketch.
        intervals = wide.select(*keys, "low", "high").distinct()
        grid = (
            _join(data, intervals, keys)
            .where(within)
            .groupBy(*keys, "low", "high")
            .agg(F.approx_percentile("v", [i / _GRID for i in range(_GRID + 1)], cfg.quantile_accuracy).alias("grid"))
        )
        cell = F.floor((F.col("index") - F.col("below")) / (F.col("size") - 1) * _GRID).cast("int")
        edges = (
            _join(wide, grid, [*keys, "low", "high"])
            .withColumn("a", F.element_at("grid", F.greatest(cell, F.lit(1))))
            .withColumn("b", F.element_at("grid", F.least(cell + 3, F.lit(_GRID + 1))))
            .drop("grid")
        )
        edged = written(edges, "group-edges")
        spans = edged.select(*keys, "low", "high", "a", "b").distinct()
        a, b = F.col("a"), F.col("b")
        counts = (
            _join(data, spans, keys)
            .where(within)
            .groupBy(*keys, "low", "high", "a", "b")
            .agg(
                F.count_if(v < a).alias("left"),
                F.count_if(v == a).alias("at_a"),
                F.count_if((v > a) & (v < b)).alias("middle"),
                F.count_if((v == b) & (v > a)).alias("at_b"),
            )
        )
        place = F.col("index") - F.col("below")
        left, at_a, middle, at_b = (F.col(c) for c in ("left", "at_a", "middle", "at_b"))
        in_left, in_a = place < left, place < left + at_a
        in_middle, in_b = place < left + at_a + middle, place < left + at_a + middle + at_b
        done = left + at_a + middle + at_b
        stepped = _join(edged, counts, [*keys, "low", "high", "a", "b"]).select(
            *keys,
            "index",
            F.when(in_left, left).when(in_a, F.col("size")).when(in_middle, middle)
            .when(in_b, F.col("size")).otherwise(F.col("size") - done).alias("size"),
            F.when(in_left | in_a, F.col("below")).when(in_middle, F.col("below") + left + at_a)
            .when(in_b, F.col("below")).otherwise(F.col("below") + done).alias("below"),
            F.when(in_left, F.col("low")).when(in_middle, a).when(in_b, F.col("low")).otherwise(b).alias("low"),
            F.when(in_left, a).when(in_middle, b).otherwise(F.col("high")).alias("high"),
            F.when(in_left, None).when(in_a, a).when(in_middle, None).when(in_b, b).cast("double").alias("value"),
        )
        state = state.where(~(unknown & (F.col("size") > cfg.quantile_values))).unionByName(stepped)

    # The remaining intervals hold few values each: rank them within (group, interval).
    order = W.partitionBy(*keys, "index").orderBy("v")
    found = (
        _join(data, state.where(unknown), keys)
        .where(within)
        .withColumn("place", F.row_number().over(order) - 1 + F.col("below"))
        .where(F.col("place") == F.col("index"))
        .select(*keys, "index", F.col("v").alias("value"))
    )
    values = state.where(~unknown).select(*keys, "index", "value").unionByName(found)
    lower = values.select(*keys, F.col("index").alias("lower"), F.col("value").alias("v_lower"))
    upper = values.select(*keys, F.col("index").alias("upper"), F.col("value").alias("v_upper"))
    d = F.col("share")
    mixed = _join(_join(base, lower, [*keys, "lower"]), upper, [*keys, "upper"]).withColumn(
        "quantile", F.col("v_lower") * (1.0 - d) + F.col("v_upper") * d
    )
    return mixed.groupBy(*keys).agg(
        F.max("n").alias("n"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("fraction", "quantile"))), lambda s: s["quantile"]
        ).alias("quantiles"),
    )
