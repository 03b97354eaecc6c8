"""Connected components as DataFrame jobs (alternating star contraction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from letterspark.plans.shared import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links every node's neighbours (large: those above it; else those below it and itself) to the least of its neighbours and itself."""
    sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    # a checkpoint, so that both sides of the join are plain shuffles and a hub's partition can be split
    least = cut(sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    joined = sides.join(least, "a")
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``edges``; the component is its least node.

    Self links, repeated links and links in both directions are fine; links with a null end are dropped.
    Each round halves the depth of the trees at least in practice and ends in a checkpoint; it stops when
    a round changes nothing. Nodes that only link to themselves are returned as their own component.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null")
    alone = pairs.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component"))
    now = cut(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if tuple(seen) == mark or not seen.n:
            break
        mark = tuple(seen)
        now = cut(_star(_star(now, True), False))
    return (
        now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")))
        .unionByName(alone)
        .groupBy("node")
        .agg(F.min("component").alias("component"))
    )
