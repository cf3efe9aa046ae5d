"""A column profile that grows with its table: a state per file, merged for the table.

Everything kept can be merged: counts, moments, extremes, and sketches of distinct values and of
quantiles. So a table with new files is profiled by reading only these.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.config import Config
from assayer.functions.numbers import count_where, percent
from assayer.functions.texts import has_outer_whitespace
from assayer.operators.columns import ColumnSpec, column_specs, quoted

#: A file that is written again has another size or time, so its old state no longer counts.
_FILE = ["file", "size", "modified"]
_FILES_PER_JOB = 10_000
_QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a table, as Spark lists them; nothing of them is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    return files.select("path", *_file_columns())


def _file_columns() -> list[Column]:
    names = ("file_path", "file_size", "file_modification_time")
    return [F.col(f"_metadata.{name}").alias(alias) for name, alias in zip(names, _FILE)]


def _state(spark: SparkSession, state: str) -> DataFrame | None:
    try:
        return spark.read.parquet(state)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _column_state(spec: ColumnSpec) -> Column:
    value, number = spec.value, spec.number
    text = quoted(spec.name) if spec.kind == "text" else F.lit(None).cast("string")
    time = spec.time if spec.kind == "time" else F.lit(None).cast("timestamp_ntz")
    return F.struct(
        F.lit(spec.ordinal).alias("ordinal"),
        F.lit(spec.name).alias("name"),
        F.lit(spec.dtype).alias("dtype"),
        F.count(value).alias("present"),
        F.count(number).alias("numeric"),
        F.avg(number).alias("mean"),
        (F.var_pop(number) * F.count(number)).alias("squares"),
        F.min(number).alias("low"),
        F.max(number).alias("high"),
        count_where(has_outer_whitespace(text)).alias("whitespace"),
        F.max(time).alias("last_time"),
        F.hll_sketch_agg(F.when(value.isNotNull(), F.xxhash64(spec.groupable))).alias("distinct_sketch"),
        F.when(F.count(number) > 0, F.kll_sketch_agg_double(number)).alias("quantile_sketch"),
    )


def _file_states(df: DataFrame, cfg: Config) -> DataFrame:
    """One row per file and column. Each task sends one row per file; files are never split by column."""
    specs = column_specs(df)
    marked = df.select("*", *[c.alias(f"__{name}") for c, name in zip(_file_columns(), _FILE)])
    rows = [_column_state(s) for s in specs]
    width = max(1, cfg.aggregates_per_pass // 10)
    passes = [F.array(*rows[i : i + width]).alias(f"part{i}") for i in range(0, len(rows), width)]
    per_file = marked.groupBy(*[F.col(f"__{name}").alias(name) for name in _FILE]).agg(F.count(F.lit(1)).alias("rows"), *passes)
    columns = F.concat(*[F.col(c) for c in per_file.columns if c.startswith("part")])
    return per_file.select(*_FILE, "rows", F.inline(columns))


def update_profile_state(spark: SparkSession, folder: str, state: str, cfg: Config | None = None) -> int:
    """Add the files of a table that the state does not hold yet; the number of files read.

    A file that has been written again is read again. If a run fails, the next one reads what is missing. Columns
    may be added over time; a file that lacks one counts as missing all of its values.
    """
    files, known = _files(spark, folder), _state(spark, state)
    if known is not None:
        files = files.join(known.select(*_FILE).distinct(), _FILE, "left_anti")
    # Names of files, which Spark's own listing holds on the driver too.
    paths = sorted(r.path for r in files.select("path").collect())
    for i in range(0, len(paths), _FILES_PER_JOB):
        reader = spark.read.option("basePath", folder).option("mergeSchema", "true")
        new = reader.parquet(*paths[i : i + _FILES_PER_JOB])
        _file_states(new, cfg or Config()).write.mode("append").parquet(state)
    return len(paths)


def profile_from_state(spark: SparkSession, folder: str, state: str) -> DataFrame:
    """One row per column over the files that the table has now, from the state alone.

    Counts, extremes, mean and deviation are exact (the last two to rounding); ``approx_distinct`` comes from
    merged HyperLogLog sketches (about 2 %) and the quartiles from merged KLL sketches (about 1.5 % in rank).
    States of files that are gone do not count, and a file that is in the state twice counts once.
    """
    current = _state(spark, state).join(_files(spark, folder).drop("path"), _FILE, "left_semi")
    current = current.dropDuplicates([*_FILE, "name"])
    total = current.groupBy(*_FILE).agg(F.max("rows").alias("rows")).agg(F.sum("rows")).first()[0] or 0
    n = F.sum("numeric")
    means = current.groupBy("name").agg((F.sum(F.col("numeric") * F.col("mean")) / F.when(n > 0, n)).alias("table_mean"))
    # Squares about the mean of a file become squares about the mean of the table.
    off = F.col("mean") - F.col("table_mean")
    squares = F.sum(F.col("squares") + F.col("numeric") * off * off)
    merged = (
        current.join(means, "name")
        .groupBy("name")
        .agg(
            F.max("ordinal").alias("ordinal"),
            F.max_by("dtype", F.struct("modified", "file")).alias("dtype"),
            F.sum("present").alias("present"),
            n.alias("numeric_count"),
            F.max("table_mean").alias("mean"),
            F.sqrt(squares / F.when(n > 1, n - 1)).alias("std"),
            F.min("low").alias("min"),
            F.max("high").alias("max"),
            F.sum("whitespace").alias("whitespace_count"),
            F.max("last_time").alias("last_time"),
            F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("approx_distinct"),
            F.kll_merge_agg_double("quantile_sketch").alias("sketch"),
        )
    )
    quartiles = [
        F.when(F.col("numeric_count") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q))).alias(f"approx_{name}")
        for name, q in _QUARTILES.items()
    ]
    missing = F.lit(total) - F.col("present")
    return merged.select(
        "ordinal",
        "name",
        "dtype",
        F.lit(total).cast("bigint").alias("total_rows"),
        missing.cast("bigint").alias("missing_count"),
        percent(missing, F.lit(total)).alias("missing_pct"),
        "numeric_count",
        "mean",
        "std",
        "min",
        "max",
        "whitespace_count",
        "last_time",
        "approx_distinct",
        *quartiles,
    )
