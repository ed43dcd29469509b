"""Connected components of a distributed edge list (alternating large-star and small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.llm.store import stored


def _with_least(pairs: DataFrame) -> DataFrame:
    """pairs (u, v): adds ``m``, the least of u and its neighbours v.  A node with very many
    neighbours is combined before the shuffle and joined back by a join that Spark can split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("lv")).select("u", F.least("u", "lv").alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node reachable, for every node with an edge.

    Stops when a round changes nothing; every round is stored in the shared folder.  Null
    ends and self links are ignored, repeated links count once.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v")
    e = stored(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small_in = large.filter("u <> v").distinct()
        w = _with_least(small_in)
        small = (w.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(w.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        e = stored(small, "edges")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
