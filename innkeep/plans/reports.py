"""Reports (K1, K3-K5, K7-K12) and the aggregations they use (E*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.functions.columns import (as_date, blank_as_null, capacity_weight, fmt_date,
                                       fmt_timestamp, payment_method_label, status_slug)
from innkeep.plans.common import (active_rentings, customer_person, hotels_with_chain, left_join_known,
                                  open_bookings)


def active_per_chain(T) -> DataFrame:
    """Open bookings per chain, chains with rooms but no bookings keep 0.

    Bookings are pre-aggregated per room before the join (map-side partial
    count), so only one row per room crosses the shuffle to the room join.
    """
    per_room = open_bookings(T).groupBy("room_id").agg(F.count("booking_id").alias("n"))
    h = hotels_with_chain(T).select("hotel_id", "chain_name")
    rooms = T["room"].select("room_id", "hotel_id").join(h, "hotel_id")
    return (rooms.join(per_room, "room_id", "left")
                 .groupBy("chain_name")
                 .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("active_bookings")))


def areas(T) -> DataFrame:
    """Distinct areas."""
    return hotels_with_chain(T).select("area").distinct()


def rooms_per_area(T) -> DataFrame:
    """E2 (view A): rooms with stored status 'available' per area."""
    h = hotels_with_chain(T).select("hotel_id", "area")
    per_hotel = T["room"].filter(F.col("current_status") == "available") \
        .groupBy("hotel_id").agg(F.count(F.lit(1)).alias("n"))
    return per_hotel.join(h, "hotel_id").groupBy("area") \
        .agg(F.sum("n").cast("int").alias("available_rooms"))


def capacity_per_hotel(T) -> DataFrame:
    """E3 (view B): summed guest capacity per hotel."""
    per_hotel = T["room"].groupBy("hotel_id").agg(
        F.sum(capacity_weight("capacity")).alias("cap"))
    return T["hotel"].select("hotel_id", "hotel_name", "address_line") \
        .join(per_hotel, "hotel_id") \
        .select("hotel_id", "hotel_name", "address_line",
                F.col("cap").cast("int").alias("aggregated_capacity"))


def capacity_top(T, k: int = 10) -> DataFrame:
    """G1: top-k hotels by capacity (hotel id breaks ties)."""
    return capacity_per_hotel(T).orderBy(F.col("aggregated_capacity").desc(), "hotel_id").limit(k)


def employees_at_hotel(T, hotel_id) -> DataFrame:
    """K4."""
    p = T["person"].select("legal_id", "first_name", "last_name")
    return T["employee"].filter(F.col("hotel_id") == hotel_id).join(p, "legal_id").select(
        "employee_id", "legal_id", "first_name", "last_name", "hotel_id", "role_title",
        "hired_on", "is_manager")


def managers_register(T) -> DataFrame:
    """K5: managers with person, hotel, chain and optional manager account."""
    p = T["person"].select("legal_id", "first_name", "last_name", "email", "phone")
    h = hotels_with_chain(T).select("hotel_id", "hotel_name", "chain_id", "chain_name")
    acc = T["auth_account"].filter(F.col("role") == "manager") \
        .select("employee_id", F.col("username").alias("account_username"),
                F.col("is_active").alias("account_is_active"))
    e = T["employee"].filter(F.col("is_manager"))
    return (e.join(p, "legal_id").join(h, "hotel_id").join(acc, "employee_id", "left")
             .select(F.col("employee_id").alias("manager_employee_id"),
                     F.col("legal_id").alias("manager_sin"), "first_name", "last_name", "email",
                     "phone", "hotel_id", "hotel_name", "chain_id", "chain_name", "role_title",
                     "hired_on", "account_username", "account_is_active"))


def stay_history(T, customer_ids: DataFrame | None = None) -> DataFrame:
    """Bookings with their linked renting (if any) per customer."""
    b = T["booking"]
    if customer_ids is not None:
        b = b.join(customer_ids.select("customer_id"), "customer_id", "left_semi")
    r = T["renting"].filter(F.col("source_booking_id").isNotNull()).select(
        F.col("source_booking_id").alias("booking_id"),
        F.col("renting_id").alias("linked_renting_id"),
        F.col("status").alias("renting_status"))
    return b.join(r, "booking_id", "left").select(
        "booking_id", "customer_id", "room_id", "start_date", "end_date", "status",
        "linked_renting_id", F.coalesce("renting_status", F.lit("Not checked in yet"))
        .alias("renting_label"))


def open_bookings_board(T, as_of, hotel_id=None, limit: int | None = None) -> DataFrame:
    """Open bookings with action flags at ``as_of``; with
    ``limit``, the page ordered overdue first, then start date, then
    newest id."""
    d = as_date(as_of)
    b = open_bookings(T)
    if hotel_id is not None:
        b = b.join(T["room"].filter(F.col("hotel_id") == hotel_id).select("room_id"),
                   "room_id", "left_semi")
    st = F.col("status")
    out = b.select(
        "booking_id", "room_id", "customer_id", "start_date", "end_date", "status",
        (F.col("end_date") < d).alias("is_overdue"),
        ((st == "reserved") & (F.col("start_date") == d)).alias("can_check_in"),
        (st.isin("reserved", "checked_in") & (F.col("end_date") >= d)).alias("can_cancel"),
        ((st == "reserved") & (F.col("end_date") >= d)).alias("can_update_dates"),
        (F.col("end_date") < d).alias("can_complete"), status_slug("status").alias("status_slug"))
    if limit is not None:
        out = out.orderBy(F.col("is_overdue").desc(), "start_date", F.col("booking_id").desc()).limit(limit)
    return out


def desk_free_rooms(T, hotel_id) -> DataFrame:
    """K8: the desk's free-room list: stored status 'available', first 200 by room id."""
    h = T["hotel"].select("hotel_id", "hotel_name", F.col("address_line").alias("location"))
    return (T["room"].filter((F.col("current_status") == "available") & (F.col("hotel_id") == hotel_id))
            .join(h, "hotel_id").select("room_id", "room_number", "hotel_name", "location").orderBy("room_id").limit(200))


def payments_board(T) -> DataFrame:
    """Payment ⋈ renting ⋈ room ⋈ customer ⋈ person."""
    r = T["renting"].select("renting_id", "room_id", "customer_id")
    rooms = T["room"].select("room_id", "hotel_id", "room_number")
    cp = customer_person(T).select("customer_id", "customer_full_name")
    return (T["payment"].join(r, "renting_id").join(rooms, "room_id").join(cp, "customer_id")
            .select("renting_id", "employee_id", "amount",
                    payment_method_label("method").alias("method_label"), "paid_at",
                    fmt_timestamp("paid_at").alias("paid_at_text"),
                    "room_id", "hotel_id", "room_number", "customer_id", "customer_full_name"))


def staff_counts(T) -> DataFrame:
    """Per hotel managers, other employees, rooms (zeros kept)."""
    e = T["employee"].groupBy("hotel_id").agg(
        F.count_if(F.col("is_manager")).alias("managers"),
        F.count_if(~F.col("is_manager")).alias("employees"))
    r = T["room"].groupBy("hotel_id").agg(F.count(F.lit(1)).alias("rooms"))
    return (T["hotel"].select("hotel_id").join(e, "hotel_id", "left").join(r, "hotel_id", "left")
            .select("hotel_id",
                    F.coalesce("managers", F.lit(0)).cast("bigint").alias("managers"),
                    F.coalesce("employees", F.lit(0)).cast("bigint").alias("employees"),
                    F.coalesce("rooms", F.lit(0)).cast("bigint").alias("rooms")))


def spend_per_customer(T) -> DataFrame:
    """Total paid per customer (payment → renting → customer)."""
    paid = T["payment"].groupBy("renting_id").agg(F.sum("amount").alias("paid"))
    return (paid.join(T["renting"].select("renting_id", "customer_id"), "renting_id")
                .groupBy("customer_id").agg(F.sum("paid").cast("decimal(20,2)").alias("total_spent")))


def spend_above_average(T) -> DataFrame:
    """E13 (our definition): customers whose total paid exceeds the average
    of all customer totals.  The average is a one-row aggregate used as a scalar subquery."""
    s = spend_per_customer(T)
    avg = s.agg(F.avg("total_spent").cast("decimal(20,6)").alias("avg_spent")).scalar()
    return s.filter(F.col("total_spent") > avg).select("customer_id", "total_spent")


def employee_performance(T) -> DataFrame:
    """E14 (our definition): per employee bookings created, rentings handled,
    payments taken and their sum.  Each fact is aggregated first, then joined
    on the employee key (no fan-out)."""
    b = T["booking"].groupBy(F.col("created_by_employee_id").alias("employee_id")) \
        .agg(F.count(F.lit(1)).alias("bookings_created"))
    r = T["renting"].groupBy("employee_id").agg(F.count(F.lit(1)).alias("rentings_handled"))
    p = T["payment"].groupBy("employee_id").agg(
        F.count(F.lit(1)).alias("payments_taken"), F.sum("amount").alias("amount_taken"))
    return (T["employee"].select("employee_id", "hotel_id")
            .join(b, "employee_id", "left").join(r, "employee_id", "left")
            .join(p, "employee_id", "left")
            .select("employee_id", "hotel_id",
                    F.coalesce("bookings_created", F.lit(0)).cast("bigint").alias("bookings_created"),
                    F.coalesce("rentings_handled", F.lit(0)).cast("bigint").alias("rentings_handled"),
                    F.coalesce("payments_taken", F.lit(0)).cast("bigint").alias("payments_taken"),
                    F.coalesce("amount_taken", F.lit(0)).cast("decimal(20,2)").alias("amount_taken")))


def open_stay_flags(T, as_of=None) -> DataFrame:
    """Per customer, has an open booking / an active renting."""
    b = open_bookings(T)
    r = active_rentings(T)
    if as_of is not None:
        b = b.filter(F.col("end_date") >= as_date(as_of))
        r = r.filter(F.col("end_date") >= as_date(as_of))
    fb = b.select("customer_id").distinct().withColumn("has_open_booking", F.lit(True))
    fr = r.select("customer_id").distinct().withColumn("has_active_renting", F.lit(True))
    return (T["customer"].select("customer_id").join(fb, "customer_id", "left")
            .join(fr, "customer_id", "left")
            .select("customer_id",
                    F.coalesce("has_open_booking", F.lit(False)).alias("has_open_booking"),
                    F.coalesce("has_active_renting", F.lit(False)).alias("has_active_renting")))


def customer_register(T, viewer_role: str = "employee", hotel_id=None) -> DataFrame:
    """Customers with person data, hotel label and the
    account; the credential column is always masked (NULL) and staff
    viewers only see their own hotel's or unassigned customers."""
    h = T["hotel"].select("hotel_id", "hotel_name")
    acc = T["auth_account"].filter(F.col("role") == "customer") \
        .select("customer_id", "username", "is_active")
    c = customer_person(T)
    if viewer_role != "admin" and hotel_id is not None:
        c = c.filter((F.col("hotel_id") == hotel_id) | F.col("hotel_id").isNull())
    return (c.join(h, "hotel_id", "left").join(acc, "customer_id", "left")
            .select("customer_id", "legal_id", "first_name", "last_name", "hotel_id",
                    F.coalesce("hotel_name", F.lit("Unassigned")).alias("hotel_label"),
                    "username", "is_active",
                    F.lit(None).cast("string").alias("password_plain")))


def row_policy(df: DataFrame, T, hotel_id=None, via: str = "room_id") -> DataFrame:
    """C11: rows of ``df`` visible to a viewer scoped to ``hotel_id``
    (``None`` = administrator, sees all).  ``via`` names the column that
    leads to a hotel: ``room_id`` or ``hotel_id``."""
    if hotel_id is None:
        return df
    if via == "hotel_id":
        return df.filter(F.col("hotel_id") == hotel_id)
    rooms = T["room"].filter(F.col("hotel_id") == hotel_id).select(via)
    return df.join(rooms, via, "left_semi")


def home_counters(T) -> DataFrame:
    """Global counts, one row."""
    def n(t):
        return T[t].agg(F.count(F.lit(1))).scalar()
    return T["hotel"].agg(F.count(F.lit(1)).alias("hotels")).select(
        "hotels", n("room").alias("rooms"), n("customer").alias("customers"),
        n("employee").alias("employees"))


def search_page(T, limit: int = 300, **criteria) -> DataFrame:
    """K6: first page of a room search with each room's next unavailable
    range (the unavailability lookup only touches the page's rooms)."""
    from innkeep.plans.search import next_unavailable, search_rooms
    page = search_rooms(T, limit=limit, **{k: v for k, v in criteria.items() if k != "as_of"})
    nxt = next_unavailable(T, criteria.get("as_of") or criteria["start"])
    return page.join(nxt.join(page.select("room_id"), "room_id", "left_semi"), "room_id", "left")


def search_page_ranges(T, limit: int = 300, **criteria) -> DataFrame:
    """K6: every unavailable range, not ended yet, of each room on the page:
    (room_id, start_date, end_date, source_type).  The page's at most ``limit``
    room ids meet the stays, whose date predicate reaches the scans."""
    from innkeep.plans.common import blocks
    from innkeep.plans.search import search_rooms
    page = search_rooms(T, limit=limit, **{k: v for k, v in criteria.items() if k != "as_of"}).select("room_id")
    b = blocks(T, criteria.get("as_of") or criteria["start"])
    return b.join(page, "room_id", "left_semi").select("room_id", "start_date", "end_date", F.col("block_type").alias("source_type"))


def archive_page(archive: DataFrame, T, hotel_id=None, limit: int = 700) -> DataFrame:
    """K9: the newest rows of a stored archive, by archived_at, then archive_id; a
    staff viewer only sees rows of their hotel."""
    a = archive
    if hotel_id is not None:
        h = T["hotel"].filter(F.col("hotel_id") == hotel_id).join(T["hotel_chain"], "chain_id").select("hotel_name", "chain_name")
        a = a.join(h, ["hotel_name", "chain_name"], "left_semi")
    return a.orderBy(F.desc("archived_at"), F.desc("archive_id")).limit(limit)


def archive_history(archive: DataFrame, T, hotel_id=None, limit: int = 700) -> DataFrame:
    """Newest archive rows first; a staff viewer only sees rows
    of their hotel (matched by hotel and chain name, as archived)."""
    from innkeep.functions.columns import archive_source_label
    a = archive
    if hotel_id is not None:
        h = T["hotel"].filter(F.col("hotel_id") == hotel_id).join(T["hotel_chain"], "chain_id") \
            .select("hotel_name", "chain_name")
        a = a.join(h, ["hotel_name", "chain_name"], "left_semi")
    sid = F.coalesce("source_renting_id", "source_booking_id")
    return a.withColumn("source_label", archive_source_label("record_type", "source_booking_id",
                                                             "source_renting_id")) \
        .orderBy(F.col("end_date").desc(), "record_type", sid.desc()).limit(limit)


def staff_register(T, hotel_id=None) -> DataFrame:
    """Staff with person data, hotel, account (credential masked)."""
    p = T["person"].select("legal_id", "first_name", "last_name", "email", "phone")
    h = T["hotel"].select("hotel_id", "hotel_name")
    acc = T["auth_account"].filter(F.col("role").isin("manager", "employee")) \
        .select("employee_id", "username", "is_active")
    e = T["employee"]
    if hotel_id is not None:
        e = e.filter(F.col("hotel_id") == hotel_id)
    return (e.join(p, "legal_id").join(h, "hotel_id").join(acc, "employee_id", "left")
            .select("employee_id", "legal_id", "first_name", "last_name", "email", "phone", "hotel_id",
                    "hotel_name", "role_title", "is_manager", "username", "is_active",
                    F.lit(None).cast("string").alias("password_plain")))


def active_rentings_board(T, hotel_id=None) -> DataFrame:
    """Active rentings with room, hotel, chain and guest; walk-in
    rentings (no source booking) are labelled."""
    h = hotels_with_chain(T).select("hotel_id", "hotel_name", "chain_name")
    rooms = T["room"].select("room_id", "hotel_id", "room_number").join(h, "hotel_id")
    if hotel_id is not None:
        rooms = rooms.filter(F.col("hotel_id") == hotel_id)
    cp = customer_person(T).select("customer_id", "customer_full_name")
    return (active_rentings(T).join(rooms, "room_id").join(cp, "customer_id")
            .select("renting_id", "room_id", "room_number", "hotel_id", "hotel_name", "chain_name",
                    "customer_id", "customer_full_name", "start_date", "end_date",
                    fmt_date("start_date").alias("start_text"),
                    F.coalesce(F.concat(F.lit("Booking #"), F.col("source_booking_id").cast("string")),
                               F.lit("Walk-in / direct")).alias("origin_label")))


def account_display_names(T) -> DataFrame:
    """Display name per account: employee's name, else customer's,
    else 'Administrator'.  Accounts without an employee id (or without a
    customer id) bypass that join, so their NULL keys never meet in one task."""
    from innkeep.functions.columns import display_name
    p = T["person"].select("legal_id", "first_name", "last_name")
    emp = T["employee"].select("employee_id", "legal_id").join(p, "legal_id") \
        .select("employee_id", F.col("first_name").alias("ef"), F.col("last_name").alias("el"))
    cus = T["customer"].select("customer_id", "legal_id").join(p, "legal_id") \
        .select("customer_id", F.col("first_name").alias("cf"), F.col("last_name").alias("cl"))
    acc = left_join_known(T["auth_account"].select("account_id", "role", "employee_id", "customer_id"), emp, "employee_id")
    acc = left_join_known(acc, cus, "customer_id")
    return acc.select("account_id", "role", display_name("ef", "el", "cf", "cl").alias("display_name"))


def find_account(T, username: str) -> DataFrame:
    """Account lookup by user name, case-insensitive (login lookup's
    data part; no credential logic)."""
    return T["auth_account"].filter(F.lower(F.col("username")) == F.lower(F.lit(username))) \
        .select("account_id", "role", "username", "employee_id", "customer_id", "is_active")
