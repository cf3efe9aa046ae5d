"""Tables whose size is set by the schema (rows per column or issue), not by the data."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def small_frame(spark: SparkSession, rows: Iterable[Mapping], schema: str | T.StructType) -> DataFrame:
    struct = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    table = pa.Table.from_pylist([dict(r) for r in rows], schema=to_arrow_schema(struct))
    return spark.createDataFrame(table, schema=struct)


def settle(df: DataFrame) -> DataFrame:
    """Evaluate a schema-sized result once, so that its readers do not rescan the data.

    Only for results that hold at most a few rows per column of the profiled table.
    """
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return small_frame(df.sparkSession, rows, df.schema)
