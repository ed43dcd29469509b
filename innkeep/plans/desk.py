"""Desk pages and desk requests: stay history, boards, staff bookings, bookings turned into rentings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innkeep.functions.columns import as_date
from innkeep.operators.rank import global_rank
from innkeep.plans.common import active_rentings, left_join_known, open_bookings
from innkeep.plans.conflicts import find_conflicts, first_violation

#: Page lengths of the desk and of a guest's history.
HISTORY_ROWS, BOARD_ROWS = 300, 200


def _places(T) -> DataFrame:
    h = T["hotel"].select("hotel_id", "hotel_name", F.col("address_line").alias("hotel_location"))
    return T["room"].select("room_id", "room_number", "hotel_id").join(h, "hotel_id").drop("hotel_id")


def _newest(rows: DataFrame, ids: list) -> DataFrame:
    """Rows with their ``position`` among the guest's, newest first.  Under the filter on it Spark keeps
    the first ``HISTORY_ROWS`` of each guest before the shuffle (``WindowGroupLimit``), so a
    guest with very many stays sends that many rows per task."""
    order = [F.desc("created_at"), F.desc(ids[0]), *ids[1:]]
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("customer_id").orderBy(*order)))


def booking_history(T) -> DataFrame:
    """K7: every guest's newest bookings (``HISTORY_ROWS`` each) with room,
    hotel and linked renting; ``position`` counts from the newest."""
    rt = T["renting"].filter(F.col("source_booking_id").isNotNull()).select(
        F.col("source_booking_id").alias("booking_id"), F.col("renting_id").alias("linked_renting_id"),
        F.col("status").alias("linked_renting_status"))
    b = T["booking"].select("booking_id", "customer_id", "room_id", "start_date", "end_date", "status", "created_at")
    rows = b.join(_places(T), "room_id").join(rt, "booking_id", "left")
    ranked = _newest(rows, ["booking_id", F.coalesce("linked_renting_id", F.lit(-1))])
    return ranked.filter(F.col("position") <= HISTORY_ROWS).select(
        "customer_id", F.col("position").cast("bigint").alias("position"), "booking_id", "room_id", "room_number", "hotel_name", "hotel_location",
        "start_date", "end_date", "status", "created_at", "linked_renting_id", "linked_renting_status")


def renting_history(T) -> DataFrame:
    """K7: every guest's newest rentings, walk-ins included."""
    r = T["renting"].select("renting_id", "source_booking_id", "customer_id", "room_id", "start_date", "end_date", "status", "created_at")
    ranked = _newest(r.join(_places(T), "room_id"), ["renting_id"])
    return ranked.filter(F.col("position") <= HISTORY_ROWS).select(
        "customer_id", F.col("position").cast("bigint").alias("position"), "renting_id", "source_booking_id", "room_id", "room_number", "hotel_name",
        "hotel_location", "start_date", "end_date", "status", "created_at")


def _at_hotel(T, rows: DataFrame, hotel_id) -> DataFrame:
    """Rows in the hotel's rooms, with the guest's legal id."""
    rooms = T["room"].filter(F.col("hotel_id") == hotel_id).select("room_id")
    guests = T["customer"].select("customer_id", F.col("legal_id").alias("customer_sin")).join(
        T["person"].select(F.col("legal_id").alias("customer_sin")), "customer_sin")
    return rows.join(rooms, "room_id", "left_semi").join(guests, "customer_id")


def desk_bookings(T, hotel_id, as_of) -> DataFrame:
    """K8: open bookings of a hotel, overdue first, then by start, newest id first."""
    return _at_hotel(T, open_bookings(T), hotel_id).select(
        "booking_id", "room_id", "customer_id", "customer_sin", "start_date", "end_date", "status") \
        .orderBy((F.col("end_date") < as_date(as_of)).desc(), "start_date", F.col("booking_id").desc()).limit(BOARD_ROWS)


def desk_rentings(T, hotel_id) -> DataFrame:
    """K8: active rentings of a hotel, newest id first."""
    return _at_hotel(T, active_rentings(T), hotel_id).select(
        "renting_id", "room_id", "customer_id", "customer_sin", "employee_id", "start_date", "end_date", "status") \
        .orderBy(F.col("renting_id").desc()).limit(BOARD_ROWS)


def desk_payments(T, hotel_id) -> DataFrame:
    """K8: payments on a hotel's rentings, newest id first (then by the other columns)."""
    r = _at_hotel(T, T["renting"].select("renting_id", "room_id", "customer_id"), hotel_id)
    return T["payment"].join(r, "renting_id").select(
        "payment_id", "renting_id", "employee_id", "amount", "method", "paid_at", "room_id", "customer_sin") \
        .orderBy(F.col("payment_id").desc_nulls_last(), F.col("renting_id").desc(), "paid_at", "amount", "employee_id").limit(BOARD_ROWS)


def managers_in_order(managers: DataFrame) -> DataFrame:
    """The managers' report with its line number: chain, hotel, last, first name, id."""
    order = ["chain_name", "hotel_name", "last_name", "first_name", "manager_employee_id"]
    return global_rank(managers, order, "line")


def find_accounts(T, names: DataFrame) -> DataFrame:
    """For each ``username`` of ``names``, the account of that name
    whatever its case (the least account id, one row per name)."""
    wanted = names.select("username").distinct().withColumn("_k", F.lower("username"))
    acc = T["auth_account"].withColumn("_k", F.lower("username")).groupBy("_k").agg(
        F.min(F.struct("account_id", "role", "is_active")).alias("a"))
    return wanted.join(acc, "_k").select("username", "a.account_id", "a.role", "a.is_active")


def staff_bookings(T, requests: DataFrame, as_of) -> DataFrame:
    """J17 (bookings taken by staff): start not before ``as_of``, end after
    start, room exists, guest found by SIN; staff (``actor`` not 'admin')
    book only rooms of their own hotel, for guests of it or of none.
    ``requests``: request_id, actor, actor_employee_id, customer_sin,
    room_id, start_date, end_date.  The booking's ``created_by_employee_id``
    is the acting employee."""
    rooms = T["room"].select("room_id", "hotel_id")
    guests = T["customer"].select(F.col("legal_id").alias("customer_sin"), "customer_id", F.col("hotel_id").alias("guest_hotel"))
    staff = T["employee"].select(F.col("employee_id").alias("actor_employee_id"), F.col("hotel_id").alias("actor_hotel"))
    j = left_join_known(left_join_known(requests.join(rooms, "room_id", "left"), guests, "customer_sin"), staff, "actor_employee_id")
    c, is_staff = F.col, F.col("actor") != "admin"
    reason = F.when(c("start_date") < as_date(as_of), "start_in_past") \
        .when(c("end_date") <= c("start_date"), "bad_range").when(c("hotel_id").isNull(), "no_such_room") \
        .when(c("customer_id").isNull(), "no_such_customer") \
        .when(is_staff & ~c("actor_hotel").eqNullSafe(c("hotel_id")), "other_hotel") \
        .when(is_staff & c("guest_hotel").isNotNull() & (c("guest_hotel") != c("actor_hotel")), "customer_of_other_hotel")
    return j.select("request_id", "room_id", "customer_id", F.col("actor_employee_id").alias("created_by_employee_id"),
                    "start_date", "end_date", reason.isNull().alias("qualified"), reason.alias("reason"))


def rentings_from_bookings(T, requests: DataFrame, as_of) -> DataFrame:
    """Requests to turn a booking into a renting: ``request_id,
    arrival, booking_id, actor, employee_id``.

    Reasons in order: no_such_booking, not_checked_in (also for all but the
    first acceptable request of a booking, which completes it),
    other_hotel, outside_stay, then the J1 renting rules against the stored
    stays (own source booking ignored).  The acting employee owns the
    renting; without one the request is ``no_employee``."""
    d = as_date(as_of)
    rooms = T["room"].select("room_id", F.col("hotel_id").alias("booking_hotel"))
    b = T["booking"].select("booking_id", "room_id", "customer_id", "start_date", "end_date", F.col("status").alias("_st")).join(rooms, "room_id")
    staff = T["employee"].select("employee_id", F.col("hotel_id").alias("actor_hotel"), F.lit(True).alias("_known"))
    c = F.col
    j = left_join_known(requests.join(b, "booking_id", "left"), staff, "employee_id")
    reason = F.when(c("_known").isNull(), "no_employee").when(c("room_id").isNull(), "no_such_booking") \
        .when(c("_st") != "checked_in", "not_checked_in") \
        .when((c("actor") != "admin") & ~c("actor_hotel").eqNullSafe(c("booking_hotel")), "other_hotel") \
        .when((c("start_date") > d) | (c("end_date") <= d), "outside_stay")
    j = j.withColumn("reason", reason).checkpoint(eager=True)
    able = j.filter(c("reason").isNull())
    new = able.select(c("request_id").alias("record_id"), F.lit(None).cast("bigint").alias("renting_id"),
                      c("booking_id").alias("source_booking_id"), "room_id", "customer_id", "start_date", "end_date")
    clash = first_violation(find_conflicts(T, {"renting": new}, sides=("renting",)), "renting") \
        .select(c("record_id").alias("request_id"), c("rule").alias("_clash"))
    j = j.join(clash, "request_id", "left").withColumn("reason", F.coalesce("reason", "_clash"))
    first = j.filter(c("reason").isNull()).groupBy("booking_id").agg(F.min(F.struct("arrival", "request_id")).alias("_f"))
    j = j.join(first, "booking_id", "left")
    late = c("reason").isNull() & (c("_f") < F.struct("arrival", "request_id"))
    j = j.withColumn("reason", F.when(late, "not_checked_in").otherwise(c("reason")))
    return j.select("request_id", "booking_id", "employee_id", "room_id", "customer_id", "start_date", "end_date",
                    c("reason").isNull().alias("accepted"), "reason")
