"""Connected components by alternating stars: every node ends up linked to the smallest node it can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.session import keep


def _smallest(edges: DataFrame) -> DataFrame:
    """(u, m): the smallest of each node's neighbours and itself; edges (u, v) count from u only."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_smallest(both), "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    lowest = _smallest(edges)
    moved = edges.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(lowest.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long) but the roots themselves.

    Loops and repeated edges change nothing; no edges give no rows. Each round ships edges only: the minimum per
    node is aggregated before the shuffle and joined back, so a node with very many edges is one small row on one
    side and, on the other, rows that a skew join may split. Rounds go on until the edges stay the same.
    """
    a, b = F.col("a"), F.col("b")
    edges = keep(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if now == mark or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
        edges = keep(_small_star(_large_star(edges).distinct()).distinct())
