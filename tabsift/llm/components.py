"""Connected components of a link table by random contraction: a few rounds of joins, no group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def component_roots(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link; nodes of one component share a root.

    In each round a node moves to the neighbour (or itself) that a fresh hash ranks first, and links follow their ends, so
    a constant share of the nodes vanishes whatever the shape of the graph. The hash minimum is combined before the
    shuffle, so a hub costs no more than any node. Rounds end when no link is left; each is a written table, and nothing
    but the count of links reaches the driver. Null ends are ignored; no links give an empty result.
    """
    links = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    levels = []
    while links.count():
        salt = F.lit(len(levels) + 1)
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), salt).alias("h"), F.col(c).alias("v"))
        moved = (both.groupBy("a").agg(F.min(rank("b")).alias("m"))
                 .select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["v"].alias("to")))
        moved = written(moved, "moved")
        levels.append(moved)
        left = moved.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        right = moved.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        links = written(links.join(left, "a").join(right, "b").filter("a2 <> b2")
                        .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links")
    if not levels:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = levels[-1].select("node", F.col("to").alias("root"))
    for level in reversed(levels[:-1]):
        up = roots.select(F.col("node").alias("to"), "root")
        roots = written(level.join(up, "to", "left").select("node", F.coalesce("root", "to").alias("root")), "roots")
    return roots
