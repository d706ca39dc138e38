"""Connected components of a table of links, on Spark alone.

Alternating large-star and small-star steps: every node sends its larger (smaller)
neighbours to its smallest one, until no edge changes.  The number of rounds grows with
the logarithm of the longest path.  A node's smallest neighbour is written before edges
are joined to it, so adaptive execution can split a node with very many edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from msgsieve.session import cut_lineage


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m"))
    return cut_lineage(least, "least")


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    moved = both.join(_least(both), "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut_lineage(moved.distinct(), "large-star")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return cut_lineage(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31)))).first())


def components(links: DataFrame) -> DataFrame:
    """id and component (the smallest id reachable) of every id in ``links`` (columns a, b).

    Null ids and links of an id with itself count for nothing.
    """
    edges = cut_lineage(links.where("a <> b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), "links")
    before = None
    while before != (now := _state(edges)):
        before = now
        if not now[0]:
            break
        edges = _small_star(_large_star(edges))
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
