"""Connected components of an edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, discard, spool


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang each node's neighbours (the larger ones, or the others and itself) on its smallest neighbour.

    The minimum is a partial aggregate and the neighbours come back by a join that Spark can
    split, so a hub with many neighbours isn't one task's work.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    joined = both.join(least, both["u"] == least["w"])
    hung = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return hung.filter("u <> v").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(u, v): each node of edges(u, v) but the smallest of its component, and that smallest one. Written to the shared folder.

    Null ends and loops are ignored; repeated edges are one. Each round is written too,
    so a lost executor costs one round, and the rounds end when each node hangs on one that hangs on none (their
    number grows with the logarithm of the longest path; what are stars already takes none).
    """
    now = spool(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _is_stars(now):
        with Scratch() as scratch:
            now, last = scratch.keep(spool(_star(_star(now, True), False), "edges")), now
        discard(last)
    return now


def _is_stars(edges: DataFrame) -> bool:
    """Whether of the different edges(u, v), u over v, no two begin at one node and none begins where another ends."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    told = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not told.agg(F.coalesce(F.max((F.col("up") + F.col("down") > 1) & (F.col("up") > 0)), F.lit(False))).first()[0]


def rooted(hung: DataFrame) -> DataFrame:
    """(node, root) of all nodes of stars."""
    return hung.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(hung.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges(u, v); root is the smallest node that it reaches."""
    return rooted(stars(edges))
