"""Repeated rows and keys, found by their fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.operators.columns import ColumnSpec, column_specs, quoted
from assayer.sources.workspace import written


def fingerprint(values: list[Column]) -> list[Column]:
    """Two independent 64-bit hashes of a row."""
    # A null is skipped by the hash; its position keeps ('a', null) and (null, 'a') apart.
    gaps = [F.when(c.isNull(), F.lit(i)) for i, c in enumerate(values)]
    return [F.xxhash64(*values, *gaps).alias("h1"), F.xxhash64(F.lit("second"), *gaps, *reversed(values)).alias("h2")]


def _values(spec: ColumnSpec) -> Column:
    # One zero: rows that differ in its sign are equal, so their hashes must be.
    value = spec.groupable + F.lit(0.0) if spec.dtype in ("float", "double") else spec.groupable
    return value.cast(spec.dtype) if spec.dtype == "float" else value


def _repeated(marked: DataFrame) -> DataFrame:
    """The pairs (h1, h2) of several rows, written to the checkpoint folder.

    Only fingerprints are shuffled, counted before. As a written table the suspects have a known size, by which
    Spark decides whether they are sent to the tasks that hold the rows or the rows are shuffled to them.
    """
    counted = marked.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"))
    return written(counted.where("copies > 1").select("h1", "h2"), "suspects")


def split_repeated(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose key no other row has, and all others, which may have a few more of the former among them.

    Nulls in keys equal each other. ``df`` is read once for the keys and once for each part, so it must give the
    same rows each time. A row of the first part is not shuffled unless very many keys repeat.
    """
    kinds = dict(df.dtypes)
    # A column that cannot be hashed is left out: then more rows are suspects, and none is overlooked.
    hashable = [quoted(k) for k in keys if not any(word in kinds[k] for word in ("map<", "variant"))]
    h1, h2 = fingerprint(hashable) if hashable else (F.lit(0).cast("bigint").alias(h) for h in ("h1", "h2"))
    suspects = _repeated(df.select(h1, h2)).select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"))
    same = (h1 == F.col("__h1")) & (h2 == F.col("__h2"))
    return df.join(suspects, same, "left_anti"), df.join(suspects, same, "left_semi")


def duplicate_rows(df: DataFrame, mode: str = "exact") -> DataFrame:
    """One row: ``duplicate_count``, the copies beyond the first of each row.

    Missing values equal each other. Fingerprints of 16 bytes are counted before the shuffle, so a row repeated
    very often costs one row per task. The fingerprint mode ends there (a joint collision of two 64-bit hashes is
    out of reach at 10^12 rows, though not impossible). The exact mode proves it: the rows whose fingerprint occurs
    again, and only they, are scanned once more and counted as they are.
    """
    specs = column_specs(df)
    flat = df.select(*[_values(s).alias(f"c{s.ordinal}") for s in specs])
    names = flat.columns
    marked = flat.select("*", *fingerprint([F.col(n) for n in names]))
    if mode == "exact":
        keys = ["h1", "h2", *names]
        marked = marked.join(_repeated(marked), ["h1", "h2"], "left_semi")
    else:
        keys = ["h1", "h2"]
    groups = marked.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("duplicate_count"))
