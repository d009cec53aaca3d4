"""Connected components of a link table on DataFrames: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


def _signature(edges: DataFrame) -> tuple:
    # order-free fingerprint of the edge set, one row to the driver
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): every linked node with the smallest node it reaches. Self links, nulls and repeats are ignored.

    Each round rewires nodes to the smallest neighbour (large star, then small star); the number of rounds grows with the
    logarithm of the longest chain. The minimum of a node's neighbours is pre-aggregated, so a hub is never gathered, and
    rounds are stage tables in the shared folder.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    edges = links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    edges = stored(edges, "edges")
    before = _signature(edges)
    if not before[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to the smallest of u and its neighbours
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        # a node without a smaller neighbour keeps none; the smallest of each star stays a leaf end
        large = large.union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        best = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(best, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(best.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "edges")
        now = _signature(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    nodes = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = nodes.select(F.col("component").alias("node"), "component").distinct()
    return nodes.union(roots)
