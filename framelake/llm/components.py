"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.common import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link each node's neighbours (larger ones, or smaller ones and itself) to the smallest of them and the node. Only
    minima are gathered per node, so a node with very many neighbours is no large group."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    met = both.join(least, "u")
    if large:
        return met.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    linked = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return linked.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of `edges` (a, b): component is the smallest node reachable. Steps go on until every
    node hangs directly from its component; their number grows with the logarithm of the longest path."""
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    while not _flat(now):
        now = materialize(_star(_star(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()


def _flat(edges: DataFrame) -> bool:
    """Whether no node hangs from two others or from one that hangs itself."""
    if edges.groupBy("a").count().where("count > 1").limit(1).count():
        return False
    return edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count() == 0
