"""Connected components of a graph of ids, by alternating large-star and small-star steps on a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemion.sources.staging import discard, stage

SALTS = 16  # of a node's edges


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60, distinct: bool = False) -> DataFrame:
    """(id, component): the smallest id reachable, for each id that has an edge.

    A node's least neighbour is aggregated by node in one shuffle and joined back by node and salt, so a hub with very many
    edges is many tasks. Each step's edges are written down. It ends as soon as every edge leads from a node that has no
    other to one that has none. `distinct`: few edges are the same, so none are looked for at the start. The result is a
    staged table.
    """
    first = _ordered(edges.select(F.col(a).alias("u"), F.col(b).alias("v")))
    at = stage(first if distinct else first.distinct(), "edges")
    for _ in range(rounds):
        # Large star: each neighbour that is larger than a node goes to the least of the node and its neighbours.
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = stage(_ordered(_with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))), "edges")
        # Small star: a node and its smaller neighbours go to the least of them (edges point from larger to smaller).
        small = _with_least(large).select(F.explode(F.array("v", "u")).alias("u"), F.col("m").alias("v"))
        last, at = at, stage(_ordered(small).distinct(), "edges")
        discard(last, large)
        ends = at.select(F.col("u").alias("id"), F.col("v").alias("component"), F.lit(1).alias("up"), F.lit(0).alias("down"))
        ends = ends.unionByName(at.select(F.col("v").alias("id"), F.col("v").alias("component"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        nodes = stage(ends.groupBy("id").agg(F.min("component").alias("component"), F.sum("up").alias("up"), F.max("down").alias("down")), "nodes")
        if nodes.where("up + down > 1").isEmpty():
            discard(at)
            return nodes.select("id", "component")
        discard(nodes)
    raise RuntimeError("components did not settle")


def _with_least(edges: DataFrame) -> DataFrame:
    """(u, v, m): the edges with the least v of their u."""
    salted = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    least = salted.groupBy("u").agg(F.min("v").alias("m"), F.bit_or(F.expr("shiftleft(1, salt)")).alias("salts"))
    least = least.select("u", "m", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> (shiftleft(1, s) & salts) != 0)")).alias("salt"))
    return salted.join(least, ["u", "salt"]).select("u", "v", "m")


def _ordered(edges: DataFrame) -> DataFrame:
    """Edges from the larger id to the smaller."""
    return edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
