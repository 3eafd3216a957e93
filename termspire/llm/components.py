"""Connected components of a graph that is a table of edges, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termspire.plans.skew import frequent_keys, spread_join
from termspire.plans.staging import stage


def _state(edges: DataFrame) -> tuple:
    """The number of the edges and two digests of them, by which rounds are compared."""
    digests = [F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u"))]
    return tuple(edges.agg(F.count(F.lit(1)), *digests).first())


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): each node of the edges with the smallest node it is connected to.

    Large and small stars in turn, until the edges are those of one star per component. A round
    takes minima per node, combined within tasks before the shuffle, and joins them back to the
    edges, those of a hub spread over tasks. Rounds are few: about the logarithm of the longest path.
    The edges of each round are a table in the shared folder. Nulls and loops are left out; repeated
    edges count once.
    """
    u, v = F.greatest(left, right), F.least(left, right)
    links = edges.where(F.col(left) != F.col(right)).select(u.alias("u"), v.alias("v")).distinct()
    links = stage(links, "links")
    before = None
    while (now := _state(links)) != before:
        before = now
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        nodes = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count(F.lit(1)).alias("n"))
        hubs = frequent_keys(nodes, "u", "n", 2 * now[0])
        large = (
            spread_join(both, nodes.drop("n"), "u", hubs, ["v"])
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least)
            .distinct()
        )
        links = stage(small, "links")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.toDF("node", "component").union(roots)
