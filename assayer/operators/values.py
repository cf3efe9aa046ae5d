"""Value counts, distinct counts, top values and format examples of categorical columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.config import Config
from assayer.functions.numbers import text_to_number
from assayer.functions.texts import has_outer_whitespace
from assayer.operators.columns import ColumnSpec, quoted
from assayer.operators.facts import ColumnFacts
from assayer.operators.small import small_frame

#: Characters of a value that are shuffled; longer values are told apart by hashes.
_HEAD = 32

#: Candidates for top values and examples that reach the driver; more stay distributed.
_FEW = 50_000

#: Bits of a bitmap per value that are worth it: a value takes 128 bits elsewhere.
_SPARSE = 64


def value_counts(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """(ordinal, value, n) of all given columns in one shuffle, counted before it.

    A value held by a third of the rows leaves each task as one row.
    """
    long = df.select(*[s.label.alias(str(s.ordinal)) for s in specs]).unpivot(
        [], [str(s.ordinal) for s in specs], "ordinal", "value"
    )
    return (
        long.where(F.col("value").isNotNull())
        .groupBy(F.col("ordinal").cast("int").alias("ordinal"), "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def most_common(counts: DataFrame, keys: list[str], k: int) -> DataFrame:
    """First ``k`` values per key by count, ties by value. Spark keeps k rows per key and
    task before the shuffle, so no key's values meet in one task."""
    order = W.partitionBy(*keys).orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _stacked(df: DataFrame, specs: list[ColumnSpec]) -> DataFrame:
    """(ordinal, value) of all given columns, without missing values."""
    return _unpivoted(df, {s.ordinal: s.label for s in specs}, "value")


def _unpivoted(df: DataFrame, cells: dict[int, Column], name: str) -> DataFrame:
    names = [str(o) for o in cells]
    long = df.select(*[c.alias(n) for n, c in zip(names, cells.values())]).unpivot([], names, "ordinal", name)
    return long.where(F.col(name).isNotNull()).select(F.col("ordinal").cast("int").alias("ordinal"), name)


def _keyed(stacked: DataFrame, mixed: list[int]) -> DataFrame:
    """What names a value in few bytes: its first characters, and if there are more, 128 bits of hashes.

    Of a longer value the last character and whether it is no number are kept too, as far as the counts need it.
    """
    v = F.col("value")
    more = F.length(v) > _HEAD
    return stacked.select(
        "ordinal",
        F.left(v, F.lit(_HEAD)).alias("head"),
        F.when(more, F.xxhash64(v)).alias("h1"),
        F.when(more, F.xxhash64(F.lit("second"), v)).alias("h2"),
        F.when(more, F.right(v, F.lit(1))).alias("tail"),
        F.when(more & F.col("ordinal").isin(mixed), text_to_number(v).isNull()).alias("worded"),
        "value",
    )


def fingerprint_counts(df: DataFrame, specs: list[ColumnSpec], mixed: list[int]) -> DataFrame:
    """(ordinal, head, h1, h2, tail, worded, n) of all given columns in one shuffle of short rows, counted before it.

    No long text is shuffled. Values are the same if their first characters and two 64-bit hashes are.
    """
    keyed = _keyed(_stacked(df, specs), mixed).drop("value")
    return keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))


def _candidates(counts: DataFrame, mixed: list[int], cfg: Config) -> DataFrame:
    """Per column: its number of values, and every value that may be a top value or an example.

    Values that share count and first characters tie; all of them are candidates.
    """
    none, k = F.lit(None), ["h1", "h2"]
    columns = ("ordinal", "part", "head", *k, "n", "values")
    distinct = counts.groupBy("ordinal").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"))
    distinct = distinct.select(
        "ordinal", F.lit("all").alias("part"), none.cast("string").alias("head"), *(none.cast("bigint").alias(c) for c in k), "n", "values"
    )
    one = F.lit(1).cast("bigint").alias("values")
    top = counts.withColumn("rank", F.rank().over(W.partitionBy("ordinal").orderBy(F.desc("n"), F.asc("head"))))
    top = top.where(F.col("rank") <= cfg.top_values).withColumn("part", F.lit("top"))

    # Kinds of anomaly as disjoint classes; the smallest values of each class are enough to know the smallest of
    # each kind. Spaces at the ends show in the first and the last character.
    ends = F.concat(F.left("head", F.lit(1)), F.lit("x"), F.coalesce("tail", F.right("head", F.lit(1))))
    spaced = has_outer_whitespace(ends)
    worded = F.col("ordinal").isin(mixed) & F.coalesce("worded", text_to_number(F.col("head")).isNull())
    kind = F.when(spaced & worded, "both").when(spaced, "spaced").when(worded, "worded").otherwise("fine")
    order = W.partitionBy("ordinal", "part").orderBy("head")
    odd = counts.withColumn("part", kind).withColumn("rank", F.rank().over(order)).where(F.col("rank") <= cfg.examples_per_kind)
    parts = [x.select("ordinal", "part", "head", *k, "n", one).select(*columns) for x in (top, odd)]
    return distinct.select(*columns).unionByName(parts[0]).unionByName(parts[1])


def _with_values(parts: DataFrame, df: DataFrame, specs: list[ColumnSpec], long: list[int]) -> DataFrame:
    """The candidates with their whole values; those of long values are fetched by a scan of their columns."""
    keys = ["ordinal", "h1", "h2"]
    wanted = parts.where(F.col("h1").isNotNull()).select(*(F.col(k).alias(f"of_{k}") for k in keys)).distinct()
    rows = _keyed(_stacked(df, [s for s in specs if s.ordinal in long]), []).where(F.col("h1").isNotNull())
    same = [F.col(k) == F.col(f"of_{k}") for k in keys]
    whole = rows.join(wanted, same, "left_semi").groupBy(*(F.col(k).alias(f"of_{k}") for k in keys)).agg(F.min("value").alias("whole"))
    return parts.join(whole, same, "left").withColumn("head", F.coalesce("whole", "head"))


def value_summary(counts: DataFrame, df: DataFrame, specs: list[ColumnSpec], mixed: list[int], cfg: Config) -> DataFrame:
    """Per column: distinct values, top values, and a few offending values of each kind.

    ``counts`` is shuffled once; of it, a few candidates per column are read. Only if a candidate is longer than
    its first characters, the columns of such candidates are scanned again, for these values alone. Candidates
    are few unless very many values share both count and beginning; then they stay distributed.
    """
    parts = _candidates(counts, mixed, cfg)
    rows = [r.asDict() for r in parts.limit(_FEW + 1).collect()]
    if len(rows) <= _FEW:
        parts = small_frame(df.sparkSession, rows, parts.schema)
        long = sorted({r["ordinal"] for r in rows if r["h1"] is not None})
    else:
        long = [s.ordinal for s in specs]
    if long:
        parts = _with_values(parts, df, specs, long)
    order = W.partitionBy("ordinal", "part").orderBy(F.when(F.col("part") == "top", -F.col("n")), "head")
    parts = parts.withColumn("rank", F.row_number().over(order)).withColumnRenamed("head", "value")
    value = F.col("value")
    few = F.when(F.col("part") == "top", F.lit(cfg.top_values)).otherwise(F.lit(cfg.examples_per_kind))
    parts = parts.where(F.col("rank") <= few)

    def examples(*kinds: str):
        found = F.sort_array(F.collect_list(F.when(F.col("part").isin(*kinds), value)))
        return F.slice(found, 1, cfg.examples_per_kind)

    best = F.collect_list(F.when(F.col("part") == "top", F.struct("rank", "value", F.col("n").alias("count"))))
    few = F.sort_array(F.array_distinct(F.concat(examples("spaced", "both"), examples("worded", "both"))))
    return parts.groupBy("ordinal").agg(
        F.max(F.when(F.col("part") == "all", F.col("values"))).alias("distinct"),
        F.max(F.when(F.col("part") == "all", F.col("n"))).alias("counted"),
        F.transform(
            F.sort_array(best), lambda s: F.struct(s["value"].alias("value"), s["count"].alias("count"))
        ).alias("top_values"),
        F.slice(few, 1, cfg.max_examples).alias("format_issue_examples"),
    )


def _dense(c: ColumnFacts) -> bool:
    """Whether a bit for each number between the least and the largest takes less than the numbers do."""
    if c.spec.dtype not in ("tinyint", "smallint", "int", "bigint") or c.low is None:
        return False
    return c.high - c.low < _SPARSE * c.present


def exact_distinct(df: DataFrame, columns: list[ColumnFacts]) -> dict[int, int]:
    """Distinct non-missing values of columns that need no value counts.

    Whole numbers that lie close together are bits of a bitmap, 32,768 to a row; every other value is 128 bits of
    hashes. Both are merged before they are shuffled, all columns in one shuffle each.
    """
    out: dict[int, int] = {}
    dense = [c.spec for c in columns if _dense(c)]
    if dense:
        rows = _unpivoted(df, {s.ordinal: quoted(s.name).cast("bigint") for s in dense}, "v")
        bits = rows.groupBy("ordinal", F.bitmap_bucket_number("v").alias("bucket")).agg(
            F.bitmap_count(F.bitmap_construct_agg(F.bitmap_bit_position("v"))).alias("n")
        )
        out |= {r["ordinal"]: r["n"] for r in bits.groupBy("ordinal").agg(F.sum("n").alias("n")).collect()}
    others = [c.spec for c in columns if not _dense(c)]
    if others:
        cells = {}
        for s in others:
            v = s.groupable + F.lit(0.0) if s.dtype in ("float", "double") else s.groupable  # one zero
            h1, h2 = F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("second"), v).alias("h2")
            cells[s.ordinal] = F.when(v.isNotNull(), F.struct(h1, h2))
        rows = _unpivoted(df, cells, "c").select("ordinal", "c.*")
        found = rows.distinct().groupBy("ordinal").agg(F.count(F.lit(1)).alias("n"))
        out |= {r["ordinal"]: r["n"] for r in found.collect()}
    return out
