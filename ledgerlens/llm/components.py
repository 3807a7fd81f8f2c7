"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a minimum per node, aggregated before the shuffle, and a join back that adaptive execution splits
where one node has very many links.  Every round is written to the shared folder; the rounds end when the links no
longer change, after a number that grows with the logarithm of the longest chain.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: a > b.  large: each node's larger neighbours are linked with the smallest of itself and its neighbours;
    else its smaller neighbours and itself are."""
    if large:
        both = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).union(edges.select(F.col("a").alias("u"), F.col("b").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        out = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (any order, repeats and loops allowed).  Returns node and component (the smallest node reachable)
    for every node with a link to another one."""
    edges = stage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    mark = None
    while True:
        edges = stage(_star(_star(edges, True), False), "links")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == mark:
            break
        mark = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
