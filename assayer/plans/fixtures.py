"""Views with known defects, derived from the given tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("o_orderkey")
    burst = k % 97 < 4
    days = [F.lit(t).cast("timestamp_ntz") for t in ("2001-03-12 06:00:00", "2001-03-13 18:00:00")]
    priority = F.when(k % 83 >= 10, F.col("o_orderpriority"))
    code = (k % 500).cast("string")
    channel = F.element_at(F.array(*[F.lit(c) for c in ("Online", "Retail", "Partner", "Direct")]), (k % 4 + 1).cast("int"))
    base = table(spark, folder, "orders").select(
        k.alias("order_id"),
        F.when(burst, F.when(k % 2 == 0, days[0]).otherwise(days[1])).otherwise(F.col("o_orderdate")).alias("order_ts"),
        F.when(k % 89 >= 16, F.col("o_orderstatus")).alias("status"),
        priority.alias("priority"),
        F.when(k % 83 >= 12, F.concat(F.lit("G"), F.substring("o_orderpriority", 1, 1))).alias("priority_group"),
        F.when(k % 97 < 3, "Partner").otherwise(channel).alias("channel"),
        F.when(burst, F.col("o_totalprice") + 5000000).otherwise(F.col("o_totalprice")).alias("amount_usd"),
        F.when(k % 79 < 2, -(k % 50 + 1)).otherwise(k % 50 + 1).alias("quantity"),
        F.when(k % 25 < 3, F.concat(F.lit("ORD-"), k.cast("string"))).otherwise(k.cast("string")).alias("order_ref"),
        F.when(k % 73 < 30, code).otherwise(F.concat(F.lit("C"), code)).alias("code_mix"),
        F.when(k % 71 < 2, F.concat(F.lit(" "), "o_orderpriority"))
        .when(k % 71 == 2, F.concat("o_orderpriority", F.lit("\t")))
        .otherwise(F.col("o_orderpriority"))
        .alias("note"),
        (k % 13 == 0).alias("is_returned"),
        F.lit(None).cast("string").alias("legacy_code"),
    )
    return base.unionByName(base.where(F.col("order_id") % 61 < 5))


def dirty_events(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("event_id")
    base = table(spark, folder, "events").select(
        "event_id",
        "ts",
        "user_id",
        F.when(k % 7 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("event_type"),
        F.when(k % 59 == 0, F.lit(float("nan"))).when(k % 53 >= 3, F.col("value")).alias("value"),
    )
    return base.unionByName(base.where(k % 41 < 2))
