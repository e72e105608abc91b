"""Connected components of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.tables import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of an edge table: component is the smallest node reachable, itself included.

    Alternating large-star and small-star rounds: each links a node's larger neighbours, then its smaller ones, to the
    smallest it knows, until edges are stars around their smallest nodes. A round is one aggregation and one join on
    each side; its edges, never more than the first had and one a node, are written to the shared folder, so a lost
    executor costs a round's tasks. Rounds grow with the logarithm of the longest path. Null nodes, loops and repeated
    edges do not matter.
    """
    low, high = F.least(a, b), F.greatest(a, b)
    now = materialize(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(high.alias("u"), low.alias("v")).where("u <> v").distinct())
    while not _are_stars(now):
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(small, "u").select("u", "v", "m")
        now = materialize(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(linked.select("u", F.col("m"))).where("u <> v").distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select("v", "v").distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 or (up > 0 and down > 0)").isEmpty()
