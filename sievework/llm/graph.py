"""Connected components by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.llm.shared import Tables

MAX_ROUNDS = 60


def _both(e: DataFrame) -> DataFrame:
    return e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def components(edges: DataFrame, tables: Tables, name: str = "cc") -> DataFrame:
    """``node, component`` (the smallest node reachable) for each node that has an edge.

    ``edges``: bigint columns ``a, b``. Each round joins edges with per-node
    minima, which are pre-aggregated before the shuffle; a node with very many
    neighbours is an aggregation, never a collected list. Rounds end when no
    label changes; their number grows with the logarithm of the longest chain.
    """
    # smaller node first; each node points to the smallest it has seen
    e = tables.write(f"{name}0", edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    at = 0
    for at in range(1, MAX_ROUNDS + 1):
        # large star: every larger neighbour of a node points to the node's minimum
        low = _both(e).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        big = _both(e).where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # small star: the smaller neighbours of a node, and the node, point to its minimum
        floor = big.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("k"))
        small = (
            big.join(floor, "b")
            .select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("a").alias("b")), F.struct(F.col("m").alias("a"), F.col("b").alias("b")))).alias("x"))
            .select("x.a", "x.b")
            .where("a <> b")
            .distinct()
        )
        fresh = tables.write(f"{name}{at}", small)
        # done when every node is either a root or points to one root, and no root points on: one pass over the nodes
        ends = fresh.select(F.col("a").alias("n"), F.lit(0).alias("points")).unionAll(fresh.select(F.col("b").alias("n"), F.lit(1).alias("points")))
        nodes = ends.groupBy("n").agg(F.sum("points").alias("points"), F.count("*").alias("ends"))
        unsettled = nodes.agg(F.bool_or((F.col("points") > 1) | ((F.col("points") == 1) & (F.col("ends") > 1))).alias("x")).first()["x"]
        tables.drop(f"{name}{at - 1}")
        e = fresh
        if not unsettled:
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    pairs = e.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return pairs.unionAll(e.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
