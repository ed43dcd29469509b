"""Running sums and sweeps over groups of any size: range-partitioned chunks with a carry.

A window over a whole group would need the group in one task.  Here the rows are
range-partitioned on ``group + order`` and fixed by a checkpoint, so a large group is cut into
chunks; windows run inside a chunk, and a chunk starts from what the chunks before it carry:
one small row for each chunk that a group goes on into.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from innkeep.session import ensure_checkpoint_dir

CHUNK = "_chunk"


def chunked(df: DataFrame, by: list[str], name: str = CHUNK, n_parts: int | None = None) -> DataFrame:
    """``df`` range-partitioned on ``by``, with the number of each row's chunk; checkpointed, so
    that bounds and numbers stay what they are."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *by).withColumn(name, F.spark_partition_id()).checkpoint(eager=True)


def running_sums(df: DataFrame, group: list[str], order: list[str], sums: dict[str, Column],
                 n_parts: int | None = None) -> DataFrame:
    """``df`` with, for every row, the sums of ``sums`` over its group up to and including it.

    ``group + order`` should be a total order; rows that tie in it count in any one order.
    Groups may be null-keyed; an empty ``group`` makes all rows one group.
    """
    placed = chunked(df, [*group, *order], n_parts=n_parts)
    inside = Window.partitionBy(CHUNK, *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = placed.groupBy(CHUNK, *group).agg(*[F.sum(v).alias(k) for k, v in sums.items()])
    before = Window.partitionBy(*[F.col(g) for g in group]).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(F.col(CHUNK).alias("_c"), *[F.col(g).alias(f"_g_{g}") for g in group],
                          F.count(F.lit(1)).over(before).alias("_earlier"),
                          *[F.sum(k).over(before).alias(f"_b_{k}") for k in sums]).filter("_earlier > 0").drop("_earlier")
    on = [F.col(CHUNK) == F.col("_c"), *[F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]]
    here = placed.select("*", *[F.sum(v).over(inside).alias(k) for k, v in sums.items()])
    return here.join(carry, on, "left").select(
        *df.columns, *[(F.coalesce(F.col(k), F.lit(0)) + F.coalesce(F.col(f"_b_{k}"), F.lit(0))).alias(k) for k in sums])
