"""Connected components of a distributed edge list (alternating large and small stars)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v) with ``m``, the least of u and its neighbours; a node with very many
    neighbours is combined before the shuffle and joined back by a join Spark can split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("lv")).select("u", F.least("u", "lv").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node reachable, for every node with an edge to another node.

    Stops when a round changes nothing; every round is checkpointed.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct().checkpoint(eager=True)
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        w = _with_least(large.filter("u <> v").distinct())
        small = (w.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(w.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        e = small.checkpoint(eager=True)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
