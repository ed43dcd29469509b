"""Reading the given tables and cutting lineage through the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innkeep.session import ensure_checkpoint_dir

#: Bounds of one Arrow batch handed to a Python worker: rows and bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Hold Arrow batches to a few MB, so that a worker's memory doesn't depend on the texts' length."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(str(spark.conf.get(key)).rstrip("b"))
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table (a file or a folder of files) by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet below the shared checkpoint folder and read it back.

    Every executor sees that folder, so the copy survives a lost executor; unlike
    ``checkpoint()`` the files are columnar and compressed.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` made distinct from the columns of ``df`` (helpers beside users' columns)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def bounded_sample(ids: DataFrame, bound: int, key: str = "id") -> DataFrame:
    """At most ``bound`` rows, chosen by a hash of ``key``.

    A hash threshold leaves little more than ``bound`` rows before they are sorted, so no task
    sees more than that however many partitions there are.
    """
    n, place = ids.count(), F.pmod(F.xxhash64(key), F.lit(1 << 24))
    if n > bound:
        ids = ids.filter(place < int((1.05 * bound + 200) / n * (1 << 24)))
    return ids.orderBy(place, key).limit(bound)
