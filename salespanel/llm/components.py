"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salespanel.llm.common import written


def digest(edges: DataFrame) -> tuple:
    """The number of rows of a table of distinct (u, v) and two combined
    hashes of them: tables with equal ones hold the same rows."""
    one, two = F.xxhash64("u", "v"), F.xxhash64("v", F.lit("edge"), "u")
    return tuple(edges.agg(F.count("*"), F.bit_xor(one), F.bit_xor(two)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is
    named by its smallest node.

    Alternating stars: each node hangs its larger neighbours on its smallest
    neighbour, then its smaller ones, until every component is a star. Each
    round is an aggregation and a join on written tables, and takes a number
    of rounds that grows as the logarithm of the graph's size."""
    spark = edges.sparkSession
    e = written(spark, edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(
        "u <> v").distinct(), "star-edges")
    known = digest(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e = written(spark, small, "star-edges")
        known, before = digest(e), known
        if known == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
