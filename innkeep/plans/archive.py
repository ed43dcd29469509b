"""Archive jobs (J4-J7): once-per-source-id snapshots of finished stays.

The archive key is ``(record_type, source id)``; every job anti-joins the
existing archive on that key before appending (idempotent re-runs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.plans.common import customer_person, hotels_with_chain, left_join_known
from innkeep.sources.schemas import FINAL_STATUSES

ARCHIVE_COLS = ["record_type", "source_booking_id", "source_renting_id", "chain_name",
                "hotel_name", "room_number", "customer_full_name", "customer_legal_id",
                "start_date", "end_date", "final_status"]


def snapshot(T, stays: DataFrame, record_type: str) -> DataFrame:
    """Stay → room → hotel → chain → customer → person, as archive rows.

    ``stays`` are booking-shaped (``booking_id``) or renting-shaped
    (``renting_id``, ``source_booking_id``) rows in their new state.
    """
    h = hotels_with_chain(T).select("hotel_id", "hotel_name", "chain_name")
    rooms = T["room"].select("room_id", "hotel_id", "room_number").join(h, "hotel_id")
    cp = customer_person(T).select("customer_id", "customer_full_name",
                                   F.col("legal_id").alias("customer_legal_id"))
    if record_type == "booking":
        ids = [F.col("booking_id").alias("source_booking_id"),
               F.lit(None).cast("bigint").alias("source_renting_id")]
    else:
        ids = [F.col("source_booking_id"), F.col("renting_id").alias("source_renting_id")]
    return (stays.join(rooms, "room_id").join(cp, "customer_id")
            .select(F.lit(record_type).alias("record_type"), *ids, "chain_name", "hotel_name",
                    "room_number", "customer_full_name", "customer_legal_id", "start_date",
                    "end_date", F.col("status").alias("final_status")))


def _not_archived(rows: DataFrame, archive: DataFrame | None) -> DataFrame:
    if archive is None:
        return rows
    b = rows.filter(F.col("record_type") == "booking").join(
        archive.filter(F.col("record_type") == "booking").select("source_booking_id"),
        "source_booking_id", "left_anti")
    r = rows.filter(F.col("record_type") == "renting").join(
        archive.filter(F.col("record_type") == "renting").select("source_renting_id"),
        "source_renting_id", "left_anti")
    return b.unionByName(r)


def archive_backfill(T, archive: DataFrame | None = None) -> DataFrame:
    """Archive rows for every finished booking/renting not yet archived."""
    b = snapshot(T, T["booking"].filter(F.col("status").isin(*FINAL_STATUSES)), "booking")
    r = snapshot(T, T["renting"].filter(F.col("status").isin(*FINAL_STATUSES)), "renting")
    return _not_archived(b.unionByName(r), archive)


def archive_transitions(T, changes: DataFrame, archive: DataFrame | None = None,
                        record_type: str = "booking") -> DataFrame:
    """Archive rows for status changes into completed/cancelled.

    ``changes`` carry the new row (booking- or renting-shaped) plus
    ``op`` ('insert'/'update') and ``old_status``.  Updates only count when
    the status really changed (IS DISTINCT FROM); a key already archived is
    never rewritten.
    """
    new = F.col("status")
    fires = new.isin(*FINAL_STATUSES) & (
        (F.col("op") == "insert") | ((F.col("op") == "update") & ~new.eqNullSafe(F.col("old_status"))))
    fired = changes.filter(fires)
    if "seq" in changes.columns:
        key = f"{record_type}_id"
        others = [c for c in changes.columns if c != key]
        fired = fired.groupBy(key).agg(F.min_by(F.struct(*others), "seq").alias("_first")).select(key, "_first.*")
    return _not_archived(snapshot(T, fired, record_type), archive)


def customer_history(T, customer_ids: DataFrame, archive: DataFrame | None = None) -> DataFrame:
    """Before customers are deleted, archive all their stays (any status)."""
    ids = customer_ids.select("customer_id").distinct()
    b = T["booking"].join(ids, "customer_id", "left_semi")
    r = T["renting"].join(ids, "customer_id", "left_semi")
    rows = snapshot(T, b, "booking").unionByName(snapshot(T, r, "renting"))
    return _not_archived(rows, archive)


def null_orphan_refs(archive: DataFrame, booking: DataFrame, renting: DataFrame) -> DataFrame:
    """Source ids that no longer exist become NULL; booking rows never
    carry a renting id."""
    bk = booking.select(F.col("booking_id").alias("source_booking_id"), F.lit(True).alias("_bk"))
    rk = renting.select(F.col("renting_id").alias("source_renting_id"), F.lit(True).alias("_rk"))
    a = left_join_known(left_join_known(archive, bk, "source_booking_id"), rk, "source_renting_id")
    keep = {"source_booking_id": F.col("_bk"), "source_renting_id": F.col("_rk") & (F.col("record_type") != "booking")}
    return a.select(*[F.when(keep[c], F.col(c)).alias(c) if c in keep else F.col(c) for c in archive.columns])
