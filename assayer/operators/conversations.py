"""Operators on tables of conversation turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayer.functions.texts import is_off_topic

RECENT_TURNS = 6


def recent_turns(turns: DataFrame, k: int = RECENT_TURNS) -> DataFrame:
    """The last ``k`` turns per conversation. Each task keeps k rows per conversation
    before the shuffle, so a conversation of any length stays small."""
    order = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("back", F.row_number().over(order)).where(F.col("back") <= k).drop("back")


def off_topic(turns: DataFrame, text: str = "text") -> DataFrame:
    return turns.where(is_off_topic(F.col(text)))


def on_topic(turns: DataFrame, text: str = "text") -> DataFrame:
    return turns.where(~is_off_topic(F.col(text)))
