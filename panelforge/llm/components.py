"""Connected components by alternating large-star and small-star steps, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few_files, materialise


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked with the smallest of its neighbourhood."""
    both = _both(edges)
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked with the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (u, v); a component is named by its smallest node, which has no row."""
    current = materialise(few_files(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()), "edges")
    # Done once no node is both a member and a centre, and every member has one centre.
    while True:
        ends = current.groupBy("u").agg(F.count("*").alias("k"))
        deep = current.select(F.col("v").alias("u")).distinct().withColumn("k", F.lit(1).cast("bigint"))
        if ends.unionByName(deep).groupBy("u").agg(F.sum("k").alias("k")).where("k > 1").isEmpty():
            return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
        current = materialise(few_files(_small_star(_large_star(current))), "edges")
