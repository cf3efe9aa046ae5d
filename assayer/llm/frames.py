"""Helpers shared by the operators: input columns, staged tables, rows back to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.sources.workspace import new_folder

#: Rows per Arrow batch. Texts are long, so batches are kept well below Spark's 10,000 rows.
ARROW_ROWS = 1000

#: A side of a join with fixed-size rows is sent to every task up to this many of them (some 50 MB there).
SMALL_ROWS = 500_000

_staged: list[str] = []


def columns_of(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns, under the operator's own names, so that no other column can clash."""
    return df.select(*(F.col(f"`{name}`").alias(alias) for alias, name in wanted.items()))


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared checkpoint folder, and read again.

    It cuts the lineage, is computed once however often it is read, and outlives executors.
    """
    spark = df.sparkSession
    path = new_folder(spark, f"llm-{name}")
    df.write.parquet(path)
    _staged.append(path)
    return spark.read.schema(df.schema).parquet(path)


def with_row_ids(df: DataFrame) -> DataFrame:
    """A unique ``row_id``. Only for frames that are staged at once, which fixes the numbers."""
    return df.withColumn("row_id", F.monotonically_increasing_id())


def staged_so_far() -> int:
    """How many staged tables this session has; ``drop_staged`` can leave those alone."""
    return len(_staged)


def drop_staged(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the staged tables of this session after the first ``since``, but for the last ``keep``.

    Only once their results have been consumed: frames that were built on them cannot be read any more.
    """
    jvm, end = spark.sparkContext._jvm, len(_staged) - keep
    for name in _staged[since:end]:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _staged[since : max(since, end)]


def if_small(keys: DataFrame) -> DataFrame:
    """A staged table of ids, marked to be broadcast if it has been counted and is small; else Spark shuffles."""
    return F.broadcast(keys) if keys.count() <= SMALL_ROWS else keys


def smallest_hashes(df: DataFrame, group: str, key: str, n: int) -> DataFrame:
    """The n rows of each group with the smallest hashes (``turn``) of their keys.

    A group is cut in each task, then in parts, then as a whole, so no task gets all of a large one.
    """
    df = df.withColumn("turn", F.xxhash64(key)).withColumn("part", F.pmod(F.xxhash64("turn"), F.lit(256)))
    for parts in ([group, "part"], [group]):
        order = Window.partitionBy(*parts).orderBy("turn", key)
        df = df.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= n).drop("nth")
    return df.drop("part")


def text_key(text: str) -> Column:
    """With the document's id, it names a row: rows equal in both are the same document twice."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.col(f"`{text}`").isNull())


def rows_in(docs: DataFrame, keys: DataFrame, doc_id: str, text: str, how: str, unique: bool = False) -> DataFrame:
    """Rows of ``docs`` with (``left_semi``) or without (``left_anti``) a row in ``keys``.

    ``keys`` has ``doc_id`` and ``text_key``. All columns of ``docs`` stay as they are. The texts are shuffled
    only if the keys are many. ``unique`` keeps one of the rows with the same id and text; only if there are
    any, the rows are cut in each task and shuffled.
    """
    counted = staged(keys.groupBy("doc_id", "text_key").agg(F.count("*").alias("rows")), "keys")
    unique = unique and not counted.filter("rows > 1").isEmpty()
    keys = if_small(counted)
    left = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(f"`{doc_id}`").alias("own_id"),
        text_key(text).alias("own_key"),
    )
    if unique:
        same_row = Window.partitionBy("own_id", "own_key").orderBy("own_key")
        left = left.withColumn("nth", F.row_number().over(same_row)).filter("nth = 1")
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key"))
    return left.join(keys, same, how).select("row.*")
