"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join; its result is written to the shared folder, so nothing is
recomputed and nothing but a count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfold.plans.recovery import written


def _least_neighbours(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) with m: the least of u and all its v."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), F.least("u2", "m").alias("m"))
    # Written, so that nothing but exchanges stands below the join and Spark can split a hub with many neighbours.
    return pairs.join(written(least, "least"), F.col("u") == F.col("u2")).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _least_neighbours(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    linked = _least_neighbours(down)
    return linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionAll(linked.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of an edge between two different nodes; root is the least node of its component.
    Edges with a null end, loops and repeated edges are ignored."""
    now = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    seen = None
    for _ in range(most_rounds):
        now = written(_small_star(_large_star(now)), "edges")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
        seen = state
    raise RuntimeError("components did not settle")
