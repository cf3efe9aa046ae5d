"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.frames import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u is tied to the smallest vertex around u."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("centre")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return (
        both.filter("v > u")
        .join(least, F.col("u") == F.col("centre"))
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are tied to the smallest of them; in the input u > v."""
    least = edges.groupBy(F.col("u").alias("centre")).agg(F.min("v").alias("m"))
    others = (
        edges.join(least, F.col("u") == F.col("centre"))
        .filter("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
    )
    return others.union(least.select("centre", "m")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``vertex`` and ``label``, the smallest vertex of its component, for links ``a``, ``b`` (longs).

    The smallest vertex of a component labels itself and has no row; neither has a vertex without links.
    Links may repeat or be given in both directions; a link of a vertex with itself, or with null, counts
    for nothing. Each round is two shuffles of the links, summed before they are shuffled, and written to the
    checkpoint folder; only the answer whether all vertices point at a root reaches the driver. The number of
    rounds grows with the logarithm of the longest path.
    """
    edges = staged(
        links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )

    def settled(e: DataFrame) -> bool:
        """Whether every vertex has one edge, to a vertex that has none."""
        by_vertex = e.groupBy("u").agg(F.count("*").alias("n"))
        targets = e.select(F.col("v").alias("u")).distinct().withColumn("target", F.lit(True))
        return by_vertex.join(targets, "u", "left").filter("n > 1 OR target").isEmpty()

    while not settled(edges):
        edges = staged(_small_star(_large_star(edges)), "star")
    return edges.select(F.col("u").alias("vertex"), F.col("v").alias("label"))
