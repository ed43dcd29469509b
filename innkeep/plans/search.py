"""Availability search (C1, D7, K2, K6) and unavailability lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.functions.columns import all_of, as_date, blank_as_null, overlaps
from innkeep.operators.intervals import occupied_days as _occupied_days
from innkeep.plans.common import active_rentings, blocks, open_bookings, rooms_star  # noqa: F401


def blocked_rooms(T, start, end) -> DataFrame:
    """Room ids with a blocking booking or renting overlapping ``[start, end)``.

    The date predicate is applied before the union so it reaches the scans.
    """
    s, e = as_date(start), as_date(end)
    b = open_bookings(T).filter(overlaps("start_date", "end_date", s, e)).select("room_id")
    r = active_rentings(T).filter(overlaps("start_date", "end_date", s, e)).select("room_id")
    return b.unionByName(r)


def free_rooms(T, start, end, rooms: DataFrame | None = None) -> DataFrame:
    """Rooms with no blocking stay in ``[start, end)`` (NOT EXISTS ×2 → left anti)."""
    rooms = rooms if rooms is not None else T["room"]
    return rooms.join(blocked_rooms(T, start, end), "room_id", "left_anti")


def search_rooms(T, *, capacity=None, area=None, chain_id=None, category=None,
                 min_category=None, min_total_rooms=None, max_price=None, status=None,
                 no_issues=False, hotel_id=None, start=None, end=None,
                 limit: int | None = None) -> DataFrame:
    """Optional-conjunct room search.

    Every criterion is optional; a date window needs both ends and
    ``end > start``.  ``limit`` gives the top-k page ordered by
    area, hotel name, price, room id.
    """
    if (start is None) != (end is None):
        raise ValueError("date window needs both start and end")
    if start is not None and str(end) <= str(start):
        raise ValueError("end must be after start")
    c = F.col
    conds = [
        c("capacity") == capacity if capacity is not None else None,
        c("area") == area if area is not None else None,
        c("chain_id") == chain_id if chain_id is not None else None,
        c("category") == category if category is not None else None,
        c("category") >= min_category if min_category is not None else None,
        c("total_rooms") >= min_total_rooms if min_total_rooms is not None else None,
        c("base_price") <= max_price if max_price is not None else None,
        c("current_status") == status if status is not None else None,
        blank_as_null("issues").isNull() if no_issues else None,
        c("hotel_id") == hotel_id if hotel_id is not None else None,
    ]
    rooms = rooms_star(T).filter(all_of(conds))
    if start is not None:
        rooms = free_rooms(T, start, end, rooms)
    out = rooms.select(
        "room_id", "room_number", "hotel_id", "hotel_name", "chain_id", "chain_name", "area",
        "category", "capacity", "base_price", "current_status",
        F.coalesce(blank_as_null("issues"), F.lit("None reported")).alias("issues_label"))
    if limit is not None:
        out = out.orderBy(F.col("area").asc_nulls_last(), "hotel_name", "base_price", "room_id") \
                 .limit(limit)
    return out


def q3_available(T, *, start, end, capacity, area, chain_id, min_category, max_price) -> DataFrame:
    """K2: available rooms with the fixed filter set of the report."""
    rooms = rooms_star(T).filter(
        (F.col("current_status") == "available") & (F.col("capacity") == capacity)
        & (F.col("area") == area) & (F.col("chain_id") == chain_id)
        & (F.col("category") >= min_category) & (F.col("base_price") <= max_price))
    return free_rooms(T, start, end, rooms).select(
        "room_id", "hotel_name", "chain_name", "area", "category", "capacity", "base_price")


def unavailable_union(T, as_of) -> DataFrame:
    """H1 + C12."""
    return blocks(T, as_of)


def unavailable_ranges(T, as_of, rooms: DataFrame | None = None, horizon: int | None = None,
                       as_list: bool = False) -> DataFrame:
    """Per room, the blocks not ended at ``as_of``.

    Flattened form (default): count, first start, last end.  ``as_list``
    returns the ordered list per room (one output row holds a room's list).
    ``horizon`` optionally leaves out blocks that start later.
    """
    b = blocks(T, as_of)
    if horizon is not None:
        b = b.filter(F.col("start_date") <= F.date_add(as_date(as_of), horizon))
    if rooms is not None:
        b = b.join(rooms.select("room_id"), "room_id", "left_semi")
    if as_list:
        return b.groupBy("room_id").agg(F.sort_array(F.collect_list(
            F.struct("start_date", "end_date", "block_type", "source_id"))).alias("ranges"))
    return b.groupBy("room_id").agg(
        F.count(F.lit(1)).alias("n_blocks"), F.min("start_date").alias("first_start"),
        F.max("end_date").alias("last_end"))


def next_unavailable(T, as_of) -> DataFrame:
    """first block per room (min over the ordered struct; no window sort)."""
    b = blocks(T, as_of)
    m = b.groupBy("room_id").agg(
        F.min(F.struct("start_date", "end_date", "block_type", "source_id")).alias("n"))
    return m.select("room_id", F.col("n.start_date").alias("next_start"),
                    F.col("n.end_date").alias("next_end"), F.col("n.block_type").alias("next_type"),
                    F.col("n.source_id").alias("next_source_id"))


def occupied_days(T, as_of, horizon: int = 220) -> DataFrame:
    """J25 over the blocks of ``T``."""
    return _occupied_days(blocks(T, as_of), as_of, horizon)
