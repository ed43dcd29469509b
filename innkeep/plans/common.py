"""Shared building blocks for plans: blocking stays, star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.functions.columns import area, as_date, full_name
from innkeep.sources.schemas import BLOCKING_BOOKING, BLOCKING_RENTING


def left_join_known(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Left join on ``key`` in which rows without a key take no part.

    They match nothing anyway, but would all hash to one partition.
    """
    joined = df.filter(F.col(key).isNotNull()).join(other, key, "left")
    bare = df.filter(F.col(key).isNull()).select(
        "*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in other.schema if f.name != key])
    return joined.select(*bare.columns).unionByName(bare)


def open_bookings(T) -> DataFrame:
    return T["booking"].filter(F.col("status").isin(*BLOCKING_BOOKING))


def active_rentings(T) -> DataFrame:
    return T["renting"].filter(F.col("status").isin(*BLOCKING_RENTING))


def hotels_with_chain(T) -> DataFrame:
    """hotel ⋈ chain (dimension tables; chain side broadcast when small)."""
    return T["hotel"].join(T["hotel_chain"].select("chain_id", "chain_name"),
                           "chain_id").withColumn("area", area("address_line"))


def rooms_star(T, room: DataFrame | None = None) -> DataFrame:
    """Room ⋈ hotel ⋈ chain (hotel side broadcast when its estimate is small)."""
    room = room if room is not None else T["room"]
    h = hotels_with_chain(T).select("hotel_id", "hotel_name", "chain_id", "chain_name",
                                    "category", "total_rooms", "address_line", "area")
    return room.join(h, "hotel_id")


def customer_person(T) -> DataFrame:
    """customer ⋈ person (on legal_id) with the display name."""
    p = T["person"].select("legal_id", "first_name", "last_name")
    return T["customer"].join(p, "legal_id").withColumn(
        "customer_full_name", full_name("first_name", "last_name"))


def blocks(T, as_of=None) -> DataFrame:
    """H1: unified unavailability table (bookings ∪ rentings that block).

    With ``as_of`` only blocks not ended at ``as_of`` are kept (C12).
    """
    b = open_bookings(T).select("room_id", "start_date", "end_date",
                                F.lit("booking").alias("block_type"),
                                F.col("booking_id").alias("source_id"))
    r = active_rentings(T).select("room_id", "start_date", "end_date",
                                  F.lit("renting").alias("block_type"),
                                  F.col("renting_id").alias("source_id"))
    u = b.unionByName(r)
    if as_of is not None:
        u = u.filter(F.col("end_date") > as_of_lit(as_of))
    return u


def as_of_lit(as_of):
    return as_date(as_of)
