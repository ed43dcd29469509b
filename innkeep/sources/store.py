"""Store the bound domain tables once as Parquet, then query the stored copy.

In a deployment the domain tables are stored, not re-derived from the
driver tables for every query.  ``store_tables`` writes each table once
with a layout that serves the common predicates:

* stays (booking, renting) and payments are range-clustered on their
  start date / paid time, so date-window filters skip row groups by
  min/max statistics; the id is part of the range, so one busy day is
  split over several tasks and files;
* dimensions are written as they are.

``load_stored`` reads them back (plus the raw driver tables that the
request streams use).  The folder is taken under the shared checkpoint
area unless one is given.
"""

from __future__ import annotations

import os
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

from innkeep.session import ensure_checkpoint_dir

LAYOUT = {
    "booking": (["start_date", "room_id"], ["start_date", "room_id"]),
    "renting": (["start_date", "room_id"], ["start_date", "room_id"]),
    "payment": (["paid_at", "renting_id"], ["paid_at", "renting_id"]),
}


def store_tables(spark: SparkSession, T: dict, base: str | None = None, parallel: int = 4) -> str:
    """Write every domain table under ``base``; independent tables are
    written as concurrent Spark jobs (``parallel`` at a time)."""
    base = base or os.path.join(ensure_checkpoint_dir(spark), "stored", uuid.uuid4().hex[:12])

    def write(name: str, df: DataFrame) -> None:
        out = df
        if name in LAYOUT:
            rng, srt = LAYOUT[name]
            out = out.repartitionByRange(*rng).sortWithinPartitions(*srt)
        out.write.mode("overwrite").parquet(f"{base}/{name}")

    items = [(n, df) for n, df in T.items() if not n.startswith("_")]
    with ThreadPoolExecutor(max_workers=max(1, parallel)) as pool:
        for f in [pool.submit(write, n, df) for n, df in items]:
            f.result()
    return base


def load_stored(spark: SparkSession, base: str, raw: dict | None = None) -> dict:
    names = ["hotel_chain", "hotel", "room", "customer", "person", "person_raw", "employee",
             "auth_account", "booking", "renting", "payment"]
    T = {n: spark.read.parquet(f"{base}/{n}") for n in names}
    if raw is not None:
        T["_raw"] = raw
    return T
