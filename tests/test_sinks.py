"""Archive sink is idempotent; publish switches versions."""

import os
import tempfile

from innkeep.plans import archive
from innkeep.sources.sinks import append_archive, publish, read_current


def test_append_archive_once_per_key(spark, T_small):
    path = os.path.join(tempfile.mkdtemp(prefix="innkeep-arch-"), "archive")
    rows = archive.archive_backfill(T_small)
    n = rows.count()
    first = append_archive(spark, rows, path)
    assert first.count() == n
    again = append_archive(spark, rows, path)
    assert again.count() == 0
    stored = spark.read.parquet(path)
    assert stored.count() == n
    ids = [r.archive_id for r in stored.select("archive_id").collect()]
    assert sorted(ids) == list(range(1, n + 1))


def test_publish_versions(spark):
    base = os.path.join(tempfile.mkdtemp(prefix="innkeep-pub-"), "room")
    publish(spark.range(5).toDF("room_id"), base, cluster_by=["room_id"])
    publish(spark.range(7).toDF("room_id"), base)
    assert read_current(spark, base).count() == 7


def test_append_archive_repeated_rows_and_known_keys(spark):
    """Rows given twice are stored once; stored keys stay out, and returned rows keep their ids later on."""
    path = os.path.join(tempfile.mkdtemp(prefix="innkeep-arch-"), "archive")
    frame = lambda ids: spark.createDataFrame([("booking", i, None, f"n{i}") for i in ids],
                                              "record_type string, source_booking_id long, source_renting_id long, name string")
    first = append_archive(spark, frame([3, 1, 1, 2]), path)
    again = append_archive(spark, frame([2, 5, 5, 4]), path)
    ids = lambda df: sorted((r.source_booking_id, r.archive_id) for r in df.collect())
    assert ids(first) == [(1, 1), (2, 2), (3, 3)] and ids(again) == [(4, 4), (5, 5)]
    assert ids(spark.read.parquet(path)) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
