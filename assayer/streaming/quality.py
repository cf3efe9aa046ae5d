"""Continuous quality monitoring and idempotent ingestion."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.functions.numbers import count_where, outside_fences
from assayer.operators.outliers import Spread


#: State on the disks of the executors, saved as changes: a batch costs what it touches, not what is held.
_STATE_ON_DISK = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
_COUNTS = ["row_count", "missing_count", "outlier_count"]


def read_growing_table(
    spark: SparkSession, folder: str, like: DataFrame, files: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    """Stream of the parquet files that arrive in a folder."""
    reader = spark.readStream.schema(like.schema).option("pathGlobFilter", files)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)


def _per_day(events: DataFrame, time: str, value: Column, spread: Spread, factor: float, *more: Column) -> DataFrame:
    x = F.when(~F.isnan(value.cast("double")), value.cast("double"))
    days = (
        events.select(F.col(time).cast("timestamp").alias("at"), x.alias("x"))
        .groupBy(F.window("at", "1 day").alias("day"))
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            count_where(F.col("x").isNull()).alias("missing_count"),
            count_where(outside_fences(F.col("x"), spread.q1, spread.q3, factor)).alias("outlier_count"),
            *more,
        )
    )
    start, end = (F.col(f"day.{edge}").cast("timestamp_ntz").alias(f"day_{edge}") for edge in ("start", "end"))
    return days.select(start, end, *days.columns[1:])


def daily_quality(
    events: DataFrame, time: str, value: Column, spread: Spread, factor: float = 1.5
) -> DataFrame:
    """Rows, missing values and fence violations per day, for batch and stream alike.

    The fences come from history, so that a window does not need its own quartiles. The
    state of a stream holds one row per day for ever, as any day can still be corrected;
    ``monitor_days`` keeps open days only.
    """
    return _per_day(events, time, value, spread, factor)


def _run(
    stream: DataFrame, mode: str, write: Callable[[DataFrame, int], None], progress: str, settings: Mapping[str, str] = {}
) -> None:
    """Process all data that is there now; ``progress`` remembers what has been done.

    The settings hold for this stream, which takes its own copy of the session's when it starts.
    """
    conf = stream.sparkSession.conf
    before = {name: conf.get(name, None) for name in settings}
    for name, setting in settings.items():
        conf.set(name, setting)
    try:
        query = (
            stream.writeStream.outputMode(mode)
            .foreachBatch(write)
            .option("checkpointLocation", progress)
            .trigger(availableNow=True)
            .start()
        )
    finally:
        for name, setting in before.items():
            conf.unset(name) if setting is None else conf.set(name, setting)
    query.awaitTermination()


def update_days(days: DataFrame, output: str, progress: str) -> None:
    """Write the days that new data changes, each batch to a folder of its own.

    A batch that is repeated after a failure replaces its folder. Call it again with the same folders
    when more files have come; ``output`` and ``progress`` belong together.
    """
    _run(days, "update", lambda batch, n: batch.write.mode("overwrite").parquet(f"{output}/batch={n}"), progress)


def read_days(spark: SparkSession, output: str) -> DataFrame:
    """Each day as the last batch that changed it left it."""
    days = spark.read.parquet(output)
    columns = [c for c in days.columns if c != "batch"]
    latest = F.max_by(F.struct(*columns), "batch").alias("day")
    return days.groupBy("day_start").agg(latest).select("day.*")


def monitor_days(
    events: DataFrame,
    time: str,
    value: Column,
    spread: Spread,
    output: str,
    progress: str,
    delay: str = "2 days",
    factor: float = 1.5,
) -> None:
    """Daily quality of a stream with a watermark: a day is closed once, and what comes later is kept apart.

    The watermark is the latest time seen before a batch, less ``delay``. A batch is reduced to one row per
    day; days that the watermark has passed become ``late`` changes, to be added to the closed day; the
    others are added to the open days. Those that end before the new watermark are ``closed``, the rest stays
    ``open`` for the next batch, which reads nothing else: the state has as many rows as the delay has
    days, and one or two more. Rows without a time belong to no day. A time far ahead moves the watermark, so
    that more changes are late, but none is lost.

    Each batch writes a folder of its own, which it replaces if it is repeated after a failure. Call it again
    with the same folders when more files have come; ``output`` and ``progress`` belong together.
    """

    def write(batch: DataFrame, n: int) -> None:
        new = _per_day(batch, time, value, spread, factor, F.max("at").cast("timestamp_ntz").alias("seen"))
        new = new.withColumn("watermark", F.lit(None).cast("timestamp_ntz"))
        if n:
            held = batch.sparkSession.read.schema(f"{_ddl(new)}, state string").parquet(f"{output}/batch={n - 1}")
            new = new.unionByName(held.where("state = 'open'").drop("state"))
        # One row per day of the batch and per open day, so one task has room for all.
        all_days = Window.partitionBy()
        passed = F.max("watermark").over(all_days)
        marked = new.withColumn("late", F.coalesce(F.col("day_end") <= passed, F.lit(False))).withColumn(
            "watermark", F.greatest(passed, F.max("seen").over(all_days) - F.expr(f"INTERVAL {delay}"))
        )
        sums = [F.sum(c).alias(c) for c in _COUNTS]
        days = marked.groupBy("day_start", "day_end", "late", "watermark").agg(*sums, F.max("seen").alias("seen"))
        state = F.when(F.col("late"), "late").when(F.col("day_end") <= F.col("watermark"), "closed").otherwise("open")
        days = days.select(*new.columns, state.alias("state")).coalesce(1)
        days.write.mode("overwrite").partitionBy("state").parquet(f"{output}/batch={n}")

    _run(events, "append", write, progress)


def read_monitor(spark: SparkSession, output: str) -> DataFrame:
    """All rows of ``monitor_days``: closed days, late changes, and the open days of each batch's end."""
    return spark.read.parquet(output).drop("seen")


def monitored_days(spark: SparkSession, output: str) -> DataFrame:
    """Each day as it stands: closed days with their late changes, and the open days after the last batch."""
    rows = read_monitor(spark, output)
    last = rows.where("state = 'open'").agg(F.max("batch")).first()[0]
    current = rows.where((F.col("state") != "open") | (F.col("batch") == F.lit(last)))
    return current.groupBy("day_start", "day_end").agg(*[F.sum(c).alias(c) for c in _COUNTS])


def ingest_once(stream: DataFrame, keys: list[str], output: str, progress: str, partitions: int | None = None) -> None:
    """Append the rows whose keys have not come before, however late or often they are delivered.

    The keys are state of the stream, kept on the executors' disks and saved as changes in ``progress``, so a
    batch costs what it brings, not what was written before; nothing of the output is read. ``partitions`` of
    the state (by default ``spark.sql.shuffle.partitions``) are fixed by the first run. Each batch goes to a
    folder of its own, which it replaces if it is repeated after a failure. Call it again with the same
    folders when more files have come; ``output`` and ``progress`` belong together.
    """
    settings = _STATE_ON_DISK | ({"spark.sql.shuffle.partitions": str(partitions)} if partitions else {})
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{output}/batch={n}")
    _run(stream.dropDuplicates(keys), "append", write, progress, settings)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in df.dtypes)


def read_ingested(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(output).drop("batch")
