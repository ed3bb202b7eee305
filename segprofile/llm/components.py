"""Connected components of links, by alternating large and small stars.

Every round is a minimum per node, added up before the shuffle, and a join of the links with these
minima, which adaptive execution can split where one node has very many links. Rounds end when the links are
stars. No links or labels pass through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segprofile.functions.staging import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component: smallest node reachable) of every node in rows of (a, b)."""

    def tidy(df: DataFrame) -> DataFrame:
        lo, hi = F.least("a", "b"), F.greatest("a", "b")
        return stage(df.select(lo.alias("lo"), hi.alias("hi")).filter(F.col("lo") < F.col("hi")).distinct())

    edges = tidy(links)
    while not _stars(edges):
        # large star: larger neighbours of a node move to its smallest neighbour (or itself)
        ends = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = ends.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
        edges = tidy(edges.join(least, F.col("lo") == F.col("u")).select(F.col("hi").alias("a"), F.col("m").alias("b")))
        # small star: smaller neighbours of a node, and the node, move to the smallest of them
        least = edges.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        moved = edges.join(least, F.col("hi") == F.col("u")).select(F.col("lo").alias("a"), F.col("m").alias("b"))
        edges = tidy(moved.union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))
    roots = edges.select(F.col("lo").alias("node")).distinct()
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _stars(edges: DataFrame) -> bool:
    """Whether every larger end has one link only and is no smaller end."""
    n = edges.count()
    if n == 0:
        return True
    if edges.select("hi").distinct().count() < n:
        return False
    return edges.join(edges.select(F.col("lo").alias("hi")).distinct(), "hi", "left_semi").limit(1).count() == 0
