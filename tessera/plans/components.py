"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import drop_staged, staged

MAX_ROUNDS = 50


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour above a node to the smallest of the node's neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every neighbour below a node, and the node, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    below = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(least.select("u", F.col("m").alias("v")))


def _settled(edges: DataFrame) -> bool:
    """Whether each of the distinct downward links leads straight to a root."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).where("down > 1 or (down = 1 and up > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` -> ``(node, component)``, component being the smallest node
    reachable; only nodes that occur in an edge between two different nodes.

    Each round is two group-bys and two joins on the node, so no component is
    gathered in a task; the joins may be split by AQE where a node is hot. The
    rounds stop when every node has one link, to a node without one; their tables go
    to the shared folder. Repeated, reversed and self links are allowed; an empty
    input gives an empty result."""
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    for _ in range(MAX_ROUNDS):
        if _settled(now):
            break
        after = staged(_small_star(_large_star(now)).distinct(), "links")
        drop_staged(now)
        now = after
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
