"""From raw documents to token ids: five stages, each written as Parquet before the next one reads it.

Every stage works on all documents that its predecessor kept and returns the columns of ``documents``; the
last one returns the ids. What a stage decides takes effect: rejected, repeated and contaminated documents
are gone from the next stage on, and boilerplate lines from their texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm.decontaminate import keep_clean
from assayer.llm.frames import drop_staged, staged, staged_so_far
from assayer.llm.line_dedup import remove_boilerplate
from assayer.llm.near_dedup import keep_first
from assayer.llm.quality_rules import keep_good
from assayer.llm.sentence_pieces import encode


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that too many documents of their host hold."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more sites carry, which stay in the first document with them.

    Documents that have no word left are gone.
    """
    counted = remove_boilerplate(docs).filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return counted.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else counted


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, 0.8)."""
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark."""
    return keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, number of ids, ids, and whether they decode to the text."""
    encoded = encode(docs)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "exact")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("minhash near-dedup", near_copies),
    ("benchmark decontamination", decontamination),
    ("sentencepiece", pieces),
]

#: Edit matching and the Viterbi search have no SQL; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. Of the tables on the way, each is deleted once the next stage is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), staged_so_far()
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        drop_staged(spark, before, keep=1)
    return docs
