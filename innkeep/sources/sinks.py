"""Sinks: append-only archive (A3) and versioned table publishing (A5).

Plain Parquet has no MERGE or constraints, so:
* the archive is appended only after a NULL-safe anti-join on its key
  ``(record_type, source id)`` (re-running a batch appends nothing);
* a changed table is written to a fresh version folder; only after that
  job has committed is the version recorded in a small version log
  (``_versions``, appended by a second job).  Readers take the highest
  logged version, so they never see a half-written table.  Large fact
  tables can instead overwrite only the partitions they touch (dynamic
  partition overwrite).

Everything goes through the DataFrame reader/writer, so the same code
works on HDFS or object stores.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innkeep.operators.rank import global_rank

ARCHIVE_KEY = ["record_type", "source_booking_id", "source_renting_id"]


def _read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        df = spark.read.parquet(path)
        df.schema  # noqa: B018 - resolves the path
        return df
    except AnalysisException:
        return None


def append_archive(spark: SparkSession, rows: DataFrame, path: str, archived_at=None) -> DataFrame:
    """A3: append archive rows not yet present (by key), with new ids
    ``max(archive_id) + rank``; returns the appended rows."""
    old = _read_or_none(spark, path)
    if old is not None:
        keys = old.select(*[F.col(c).alias(f"_o_{c}") for c in ARCHIVE_KEY])
        cond = None
        for c in ARCHIVE_KEY:  # NULL-safe: booking rows have no renting id
            e = F.col(c).eqNullSafe(F.col(f"_o_{c}"))
            cond = e if cond is None else cond & e
        new = rows.join(keys, cond, "left_anti")
        base = old.agg(F.coalesce(F.max("archive_id"), F.lit(0))).first()[0]
    else:
        new, base = rows, 0
    # stored keys leave before the rows are shuffled for their duplicates
    ranked = global_rank(new.dropDuplicates(ARCHIVE_KEY), [F.col(c).asc_nulls_first() for c in ARCHIVE_KEY], "_rk")
    ts = (F.current_timestamp() if archived_at is None else F.lit(archived_at)).cast("timestamp_ntz")
    out = ranked.withColumn("archive_id", (F.lit(base) + F.col("_rk")).cast("bigint")) \
        .withColumn("archived_at", ts).drop("_rk")
    # rows and ids are fixed by the rank's checkpoint
    out.write.mode("append").partitionBy("record_type").parquet(path)
    return out


def _versions(spark: SparkSession, base: str) -> DataFrame | None:
    return _read_or_none(spark, f"{base.rstrip('/')}/_versions")


def current_version(spark: SparkSession, base: str) -> int:
    v = _versions(spark, base)
    if v is None:
        return 0
    return v.agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def publish(df: DataFrame, base: str, cluster_by: list[str] | None = None,
            partition_by: list[str] | None = None) -> str:
    """A5: write ``df`` as the next version under ``base``, then log it.

    ``cluster_by`` range-partitions and sorts the files (min/max statistics
    then prune range predicates, the layout equivalent of the reference's
    B-tree indexes).
    """
    spark = df.sparkSession
    n = current_version(spark, base) + 1
    target = f"{base.rstrip('/')}/v={n}"
    out = df
    if cluster_by:
        out = out.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    w = out.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(target)
    spark.createDataFrame([(n, target)], "version long, path string") \
        .withColumn("published_at", F.current_timestamp()) \
        .write.mode("append").parquet(f"{base.rstrip('/')}/_versions")
    return target


def read_current(spark: SparkSession, base: str) -> DataFrame:
    n = current_version(spark, base)
    if n == 0:
        raise FileNotFoundError(f"nothing published under {base}")
    return spark.read.parquet(f"{base.rstrip('/')}/v={n}")


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions present in ``df`` (large facts)."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic") \
        .partitionBy(*partition_by).parquet(path)
