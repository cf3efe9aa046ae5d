"""Boilerplate lines by the number of distinct sites that carry them. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer.llm.frames import columns_of, if_small, staged, text_key


@dataclass(frozen=True)
class LineSpread:
    min_sites: int = 10  # a line on so many distinct sites is boilerplate
    lg_k: int = 10  # base-2 logarithm of the registers of a sketch
    sigmas: float = 4.0  # standard errors around the limit within which sites are counted exactly

    @property
    def margin(self) -> float:
        return max(0.5, self.sigmas * 1.04 / 2 ** (self.lg_k / 2) * self.min_sites)


def normalised(line: Column) -> Column:
    """Lower case, one space for each run of white space, none at the ends."""
    return F.lower(F.trim(F.regexp_replace(line, r"[\t\x0B\f\r ]+", " ")))


def _lines(docs: DataFrame, doc_id: str, text: str, site: str) -> DataFrame:
    given = columns_of(docs, doc_id=doc_id, text=text, site=site).withColumn("text_key", text_key("text"))
    each = given.select(
        "doc_id", "text_key", F.col("site").cast("string"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line")
    )
    each = each.withColumn("line", normalised(F.col("line"))).filter("line <> ''")
    return each.withColumn("line", F.xxhash64("line"))


def _spread(lines: DataFrame, options: LineSpread) -> DataFrame:
    """``line`` of every line on at least ``min_sites`` sites, and ``first``, the smallest id of a document with it.

    Sketches are built in every task and merged after the shuffle, so a line that a third of all rows
    carry is one row per task. Only lines whose estimate is near the limit are counted exactly.
    """
    sketched = lines.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", options.lg_k)).alias("sites"), F.min("doc_id").alias("first")
    )
    likely = staged(sketched.filter(F.col("sites") >= options.min_sites - options.margin), "spread")
    clear = F.col("sites") > options.min_sites + options.margin
    near = lines.join(if_small(likely.filter(~clear).select("line", "first")), "line")
    exact = near.groupBy("line").agg(F.count_distinct("site").alias("sites"), F.any_value("first").alias("first"))
    exact = exact.filter(F.col("sites") >= options.min_sites)
    return staged(likely.filter(clear).select("line", "first").union(exact.select("line", "first")), "boilerplate")


def _lost(lines: DataFrame, spread: DataFrame) -> DataFrame:
    """Numbers of the lost lines of every document that loses any. Rows with one id and text are one document."""
    # The lines to lose are few and counted; only beyond the limit does Spark shuffle lines, splitting hot ones.
    held = lines.join(if_small(spread), "line").filter(~F.col("doc_id").eqNullSafe(F.col("first")))
    return held.groupBy("doc_id", "text_key").agg(F.collect_set("at").alias("lost"))


def remove_boilerplate(
    docs: DataFrame,
    options: LineSpread = LineSpread(),
    doc_id: str = "doc_id",
    text: str = "text",
    site: str = "source",
    removed: str | None = None,
) -> DataFrame:
    """``docs`` with all their columns, without the lines that ``min_sites`` or more distinct sites carry.

    Such a line stays in the document with the smallest id that holds it, and goes from all others, whatever they
    have left then, if need be nothing. So of a text that stands on that many sites one copy stays whole. Lines are
    compared by the 64-bit hash of their normalised form; a line of white space only is never boilerplate. What
    stays of a text keeps its lines as they were. ``removed`` names a column to add with the number of lines taken.

    Null and empty texts stay as they are; a null site counts as none. Rows without an id are never first, unless no
    row with the line has an id. Rows with one id are judged by their own text; equal rows lose the same lines. An
    empty table stays empty. No cap on the length of a text or on the number of lines. A column of ``docs`` may have
    any name but ``removed``'s.

    Line hashes are staged once; the texts are shuffled once, to meet the positions of their lost lines.
    """
    lines = staged(_lines(docs, doc_id, text, site), "lines")
    lost = _lost(lines, _spread(lines, options))
    row = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"),
        F.col(f"`{doc_id}`").alias("own_id"),
        text_key(text).alias("own_key"),
        F.col(f"`{text}`").alias("own_text"),
    )
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("text_key"))
    parts = F.split("own_text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("lost"))
    rest = F.when(F.col("lost").isNotNull(), F.array_join(F.transform(stay, lambda i: F.get(parts, i)), "\n"))
    joined = row.join(lost, same, "left").withColumn("rest", rest)
    new = F.coalesce("rest", "own_text")
    out = [new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns]
    if removed:
        out.append(F.coalesce(F.array_size("lost"), F.lit(0)).cast("long").alias(removed))
    return joined.select(*out)
