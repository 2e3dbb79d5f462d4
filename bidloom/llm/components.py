"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a join and an aggregation of the links; nothing is collected but counts that tell
when the links have become stars. Minima are aggregated and written before the
join that hands them back: both its sides are then shuffled for the join alone, which lets adaptive
execution split a node with very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none: the components are read off."""
    n, nodes = edges.agg(F.count("*"), F.count_distinct("u")).first()
    return n == nodes and edges.select(F.col("v").alias("u")).distinct().join(edges.select("u"), "u", "left_semi").isEmpty()


def connected_components(links: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """``links(a, b)`` to ``(node, component)``: the smallest node reachable, for linked nodes.

    A node is of any type that can be ordered, structs included. Self links and repeated links are ignored; an empty table gives an empty table.
    """
    edges = scratch.table(
        links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    for _ in range(max_rounds):
        if _stars(edges):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        both = edges.union(edges.select("v", "u"))
        low = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = scratch.table(large, "large-star")
        low_of_large = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(low_of_large, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.*")
            .where("u <> v")
            .distinct()
        )
        small = scratch.table(small, "small-star")
        scratch.forget(edges, large, low, low_of_large)
        edges = small
    raise RuntimeError("links did not settle")
