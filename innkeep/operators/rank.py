"""global ``row_number() OVER (ORDER BY key)`` without a single partition.

A plain global window moves every row into one task.  Instead:

1. range-partition on the (unique) key and sort inside partitions;
2. ``checkpoint()`` to the shared checkpoint folder, so the sampled range
   bounds and row placement are fixed for both passes (and lineage is cut);
3. count rows per partition (one small row per partition to the driver)
   and turn the counts into prefix offsets;
4. rank = offset[partition] + position inside the partition (from
   ``monotonically_increasing_id``, whose low 33 bits count rows within a
   partition) + 1.  No further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innkeep.session import ensure_checkpoint_dir


def global_rank(df: DataFrame, order: list[str | Column], name: str = "rn",
                n_parts: int | None = None) -> DataFrame:
    """Dense 1-based row number over ``order`` (must be a total order)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).checkpoint(eager=True)
    pid = F.spark_partition_id()
    counts = {r["pid"]: r["n"] for r in
              ranged.groupBy(pid.alias("pid")).agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = ranged.rdd.getNumPartitions()
    offsets, acc = [], 0
    for p in range(parts):
        offsets.append(acc)
        acc += counts.get(p, 0)
    off = F.element_at(F.array(*[F.lit(o).cast("bigint") for o in offsets]), (pid + 1).cast("int"))
    within = F.monotonically_increasing_id() - F.shiftleft(pid.cast("bigint"), 33)
    return ranged.withColumn(name, off + within + 1)


def rank_within_groups(df: DataFrame, group: list[str], order: list[str | Column],
                       name: str = "rank") -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY order)`` without
    putting a group into one task: global rank over ``group + order``, minus
    the group's first global rank (a partial-aggregated ``min`` per group,
    joined back).  A group holding a third of all rows is spread over the
    range partitions like any other rows.  ``group + order`` must be a
    total order.
    """
    ranked = global_rank(df, [*group, *order], "_g")
    first = ranked.groupBy(*group).agg(F.min("_g").alias("_g0"))
    return ranked.join(first, group, "inner") \
        .withColumn(name, F.col("_g") - F.col("_g0") + 1).drop("_g", "_g0")


def last_before(df: DataFrame, group: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the non-NULL ``value`` of the latest earlier row of the same group.

    A running ``last`` over a group would need the whole group in one task.  Instead the rows are
    range-partitioned on ``group + order`` (a total order), which cuts a large group into chunks;
    a window runs inside each chunk, and a chunk starts from the last value of the chunks before
    it: one small row per chunk.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *group, *order).checkpoint(eager=True)
    placed = ranged.withColumn("_chunk", F.spark_partition_id())
    earlier = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    last = placed.groupBy(*group, "_chunk").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    carry = last.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_chunk").alias("_c"),
                        F.last("_end", ignorenulls=True).over(earlier(*group).orderBy("_chunk")).alias("_carry")) \
        .filter(F.col("_carry").isNotNull())
    here = placed.withColumn(name, F.last(value, ignorenulls=True).over(earlier(*group, "_chunk").orderBy(*order)))
    on = [F.col("_chunk") == F.col("_c"), *[F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]]
    return here.join(carry, on, "left").withColumn(name, F.coalesce(name, "_carry")).select(*df.columns, name)
