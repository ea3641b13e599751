"""Connected components by rounds of large-star and small-star, for graphs of any size.

Each round is two aggregations and two joins over the edges; the edges of a round are a written table, so an executor
that is lost costs one round at most. Nodes with very many neighbours are reduced map-side; the joins on them can be
split by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convan.llm.common import saved


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node's larger (or smaller) neighbours linked to the smallest of all its neighbours (smaller ones) and itself."""
    if large:
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(least.hint("merge"), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least.hint("merge"), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether every component is one star: every node has one edge only, and no centre is the end of another edge."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("begins"), F.lit(0).alias("centre")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("begins"), F.lit(1).alias("centre")))
    return ends.groupBy("node").agg(F.sum("begins").alias("n"), F.max("centre").alias("c")).where("n > 1 or n > 0 and c > 0").limit(1).count() == 0


def components(edges: DataFrame) -> DataFrame:
    """(node, component): every node of edges (a, b) with the smallest node that it reaches. Loops and nulls are ignored."""
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        now = saved(_star(_star(now, True).distinct(), False).distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
