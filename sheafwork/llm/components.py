"""Connected components as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage_table


def components(edges: DataFrame, label: str = "components", rounds: int = 40) -> DataFrame:
    """From undirected edges (a, b): node and component, its smallest node, for every node of an edge.

    Each round links all of a node's larger neighbours to the smallest one it knows (large star), then all
    smaller ones (small star), and writes the edges; when nothing moves, every node points to its component.
    The number of rounds grows with the logarithm of the longest path. Neither form gathers a node's
    neighbours: minima are aggregated map-side and joined back, and Spark may split a skewed join.
    """
    now = stage_table(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), label)

    def star(pairs: DataFrame, both: bool) -> DataFrame:
        """both: every node looks at all neighbours and sends its larger ones down; else only at smaller ones."""
        up = pairs.select(F.col("b").alias("u"), F.col("a").alias("v"))
        seen = up.unionByName(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))) if both else up
        least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = seen.join(least, "u")
        if both:
            return joined.where(F.col("v") > F.col("u")).select(F.col("m").alias("a"), F.col("v").alias("b"))
        moved = joined.select(F.col("m").alias("a"), F.col("v").alias("b"))
        return moved.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a != b")

    last = None
    for _ in range(rounds):
        now = stage_table(star(star(now, True).distinct(), False).distinct(), label)
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(sums) == last:
            break
        last = tuple(sums)
    else:
        raise RuntimeError("components didn't settle")
    return now.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
