"""Lifecycle jobs over request batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.functions.columns import as_date
from innkeep.operators.rank import global_rank, last_before
from innkeep.plans.common import left_join_known
from innkeep.plans.conflicts import find_conflicts, first_violation
from innkeep.sources.schemas import BLOCKING_BOOKING


# The status that an accepted action leaves.
TARGETS = {"check_in": "checked_in", "cancel": "cancelled", "complete": "completed"}


def apply_transitions(T, requests: DataFrame, as_of) -> DataFrame:
    """Decide status-change requests, per booking in (arrival, request_id) order.

    ``requests``: ``request_id, booking_id, arrival, action, actor ('admin' | 'staff'
    | 'customer'), actor_employee_id, actor_customer_id, new_start,
    new_end``.  Checks, in the order the reference applies them:

    * customers may only cancel, and only their own bookings, while
      'reserved' and not ended;
    * staff act only on bookings of their own hotel (admins on any);
    * cancel: 'reserved'/'checked_in' and not ended; check_in: 'reserved'
      and starting on ``as_of``; complete: open and ended before ``as_of``;
    * redate: both dates given, new start not in the past and new end after it (checked
      before the booking is looked up), booking 'reserved', and the new
      range may not clash with other blocking stays (own id ignored; first
      violated J1 rule).

    Each request meets its booking as the accepted requests before it left it: ``old_*`` is that
    state, ``new_*`` the state after it.  A booking changes its status twice at most (arrival, then
    an end), so two passes that look for the earliest request that passes settle the statuses,
    and the dates are those of the last valid re-date before (``last_before``); no booking's
    requests are gathered in one task.  Clashes with other bookings are checked against the stored
    stays; clashes among new ranges of different bookings are the job of ``admit`` (J2).
    """
    d, c = as_date(as_of), F.col
    act, order = c("action"), ["arrival", "request_id"]
    at = F.struct(*order)
    rooms = T["room"].select("room_id", F.col("hotel_id").alias("booking_hotel"))
    b = T["booking"].select("booking_id", "room_id", "customer_id", F.col("start_date").alias("_start"),
                            F.col("end_date").alias("_end"), F.col("status").alias("_stored")).join(rooms, "room_id", "left")
    staff = T["employee"].select(F.col("employee_id").alias("actor_employee_id"),
                                 F.col("hotel_id").alias("actor_hotel"))
    j = left_join_known(left_join_known(requests, b, "booking_id"), staff, "actor_employee_id")
    missing = c("room_id").isNull()
    is_cust = c("actor") == "customer"
    scope = (c("actor") == "staff") & (c("actor_hotel").isNull() | (c("actor_hotel") != c("booking_hotel")))
    found = F.when(missing, "no_such_booking").when(scope, "other_hotel")

    def reason(st, start, end):
        """Why a request fails on a booking of this status and range; NULL: it passes."""
        open_ = st.isin(*BLOCKING_BOOKING)
        return (
            F.when(is_cust & (act != "cancel") & (act != "invalid"), "staff_only")
            .when(act == "redate", F.when(c("new_start").isNull() | c("new_end").isNull(), "no_date")
                  .when(c("new_start") < d, "start_in_past").when(c("new_end") <= c("new_start"), "bad_range")
                  .otherwise(found.when(st != "reserved", "not_reserved")))
            .when(act == "cancel", F.when(missing | (is_cust & (c("customer_id") != c("actor_customer_id"))),
                                          "no_such_booking")
                  .when(scope, "other_hotel")
                  .when(is_cust & (st != "reserved"), "not_cancellable")
                  .when(~is_cust & ~open_, "not_cancellable")
                  .when(end < d, "already_ended"))
            .when(act == "check_in", found.when(st != "reserved", "not_reserved").when(start != d, "not_arrival_day"))
            .when(act == "complete", found.when(~open_, "not_open").when(end >= d, "not_ended"))
            .otherwise("unknown_action"))

    # valid re-dates of bookings that are reserved at first; they hold until the status changes
    j = j.withColumn("_valid", reason(c("_stored"), c("_start"), c("_end")).isNull())
    redates = j.filter((act == "redate") & c("_valid")).select(
        F.col("request_id").alias("record_id"), "booking_id", "room_id", "customer_id",
        F.col("new_start").alias("start_date"), F.col("new_end").alias("end_date"))
    clash = first_violation(find_conflicts(T, {"booking": redates}, sides=("booking",))) \
        .select(F.col("record_id").alias("request_id"), F.col("rule").alias("_clash"))
    j = j.join(clash, "request_id", "left").withColumn(
        "_moved", F.when((act == "redate") & c("_valid") & c("_clash").isNull(),
                         F.struct(F.col("new_start").alias("start"), F.col("new_end").alias("end"))))
    j = last_before(j, ["booking_id"], order, "_moved", "_before")
    j = j.withColumn("_before", F.coalesce("_before", F.struct(F.col("_start").alias("start"), F.col("_end").alias("end"))))
    start, end = c("_before.start"), c("_before.end")
    j = j.withColumn("_st", F.col("_stored"))
    target = F.create_map(*[F.lit(x) for kv in TARGETS.items() for x in kv])
    for n in (1, 2):  # the earliest request that changes the status
        turn = j.filter(act.isin(*TARGETS) & reason(c("_st"), start, end).isNull())
        turn = turn.filter(c("_at1") < at) if n == 2 else turn
        turn = turn.groupBy("booking_id").agg(F.min(at).alias(f"_at{n}"), F.min_by(target[act], at).alias("_to"),
                                              F.min_by("_before", at).alias("_then"))
        j = left_join_known(j, turn, "booking_id")
        later = F.coalesce(at > c(f"_at{n}"), F.lit(False))
        j = j.withColumn("_st", F.when(later, c("_to")).otherwise(c("_st"))) \
            .withColumn("_before", F.when(later, c("_then")).otherwise(c("_before"))).drop("_to", "_then")
    j = j.withColumn("reason", F.coalesce(reason(c("_st"), start, end), F.when(act == "redate", c("_clash"))))
    ok = c("reason").isNull()
    moved = ok & (act == "redate")
    return j.select("request_id", "booking_id", "arrival", "action", ok.alias("accepted"), "reason",
                    c("_st").alias("old_status"), start.alias("old_start_date"), end.alias("old_end_date"),
                    F.when(ok & act.isin(*TARGETS), target[act]).otherwise(c("_st")).alias("new_status"),
                    F.when(moved, c("new_start")).otherwise(start).alias("new_start_date"),
                    F.when(moved, c("new_end")).otherwise(end).alias("new_end_date"))


def transition_changes(T, decided: DataFrame) -> DataFrame:
    """Accepted transitions as booking-shaped change rows for J4, with the state they met."""
    b = T["booking"].drop("status", "start_date", "end_date")
    return decided.filter("accepted").join(b, "booking_id").select(
        *[c for c in b.columns], F.col("new_status").alias("status"),
        F.col("new_start_date").alias("start_date"), F.col("new_end_date").alias("end_date"),
        "old_status", "old_start_date", "old_end_date", F.lit("update").alias("op"))


def bookings_after(T, decided: DataFrame) -> DataFrame:
    """The stored bookings as the accepted transitions leave them."""
    at = F.struct("arrival", "request_id")
    last = decided.filter("accepted").groupBy("booking_id").agg(F.max_by(
        F.struct(F.col("new_status").alias("status"), F.col("new_start_date").alias("start_date"),
                 F.col("new_end_date").alias("end_date")), at).alias("_last"))
    b = T["booking"].join(last, "booking_id", "left")
    return b.select(*[F.coalesce(F.col(f"_last.{x}"), F.col(x)).alias(x) if x in ("status", "start_date", "end_date")
                      else F.col(x) for x in T["booking"].columns])


def bookings_to_rentings(T, as_of, booking_ids: DataFrame | None = None) -> DataFrame:
    """Checked-in bookings running on ``as_of`` become active rentings
    (new ids after the current maximum, in booking id order).  Each new
    renting is checked with the J1 renting rules against the stored stays
    (its own source booking ignored); ``accepted``/``reason`` report the
    first violated rule.  The accepted bookings are completed by the caller
    (see ``transition_changes``)."""
    d = as_date(as_of)
    b = T["booking"].filter((F.col("status") == "checked_in") & (F.col("start_date") <= d)
                            & (d < F.col("end_date")))
    if booking_ids is not None:
        b = b.join(booking_ids.select("booking_id"), "booking_id", "left_semi")
    mx = T["renting"].agg(F.coalesce(F.max("renting_id"), F.lit(0))).scalar()
    ranked = global_rank(b.select("booking_id", "room_id", "customer_id",
                                  "created_by_employee_id", "start_date", "end_date"),
                         ["booking_id"], "_rk")
    new = ranked.select((mx + F.col("_rk")).alias("renting_id"), "room_id", "customer_id",
                        F.col("created_by_employee_id").alias("employee_id"),
                        F.col("booking_id").alias("source_booking_id"), "start_date", "end_date",
                        F.lit("active").alias("status")).checkpoint(eager=True)  # used 5 times
    clash = first_violation(find_conflicts(T, {"renting": new}, sides=("renting",)), "renting") \
        .select(F.col("record_id").alias("renting_id"), F.col("rule").alias("reason"))
    return new.join(clash, "renting_id", "left").withColumn("accepted", F.col("reason").isNull())


def intake_bookings(T, requests: DataFrame, as_of) -> DataFrame:
    """J17 (bookings, customer requests): start not before ``as_of``, end
    after start, room exists, customer exists (checked in this order)."""
    d = as_date(as_of)
    rooms = T["room"].select("room_id", "hotel_id")
    cust = T["customer"].select("customer_id", F.lit(True).alias("_cust"))
    j = requests.join(rooms, "room_id", "left").join(cust, "customer_id", "left")
    reason = F.when(F.col("start_date") < d, "start_in_past") \
        .when(F.col("end_date") <= F.col("start_date"), "bad_range") \
        .when(F.col("hotel_id").isNull(), "no_such_room") \
        .when(F.col("_cust").isNull(), "no_such_customer")
    return j.select("request_id", "arrival", "room_id", "customer_id", "start_date", "end_date",
                    "hotel_id", reason.isNull().alias("qualified"), reason.alias("reason"))


def intake_rentings(T, requests: DataFrame) -> DataFrame:
    """J17 (walk-in rentings by staff): end after start, room exists,
    customer found by SIN, room at the employee's hotel, customer not
    registered at another hotel (checked in this order)."""
    rooms = T["room"].select("room_id", "hotel_id")
    cust = T["customer"].select(F.col("legal_id").alias("customer_sin"), "customer_id",
                                F.col("hotel_id").alias("customer_hotel"))
    staff = T["employee"].select(F.col("employee_id").alias("staff_employee_id"),
                                 F.col("hotel_id").alias("staff_hotel"))
    j = requests.join(rooms, "room_id", "left").join(cust, "customer_sin", "left") \
        .join(staff, "staff_employee_id", "left")
    reason = F.when(F.col("end_date") <= F.col("start_date"), "bad_range") \
        .when(F.col("hotel_id").isNull(), "no_such_room") \
        .when(F.col("customer_id").isNull(), "no_such_customer") \
        .when(F.col("staff_hotel").isNull() | (F.col("staff_hotel") != F.col("hotel_id")), "other_hotel") \
        .when(F.col("customer_hotel").isNotNull() & (F.col("customer_hotel") != F.col("staff_hotel")),
              "customer_of_other_hotel")
    return j.select("request_id", "room_id", "customer_id", "staff_employee_id", "start_date",
                    "end_date", reason.isNull().alias("qualified"), reason.alias("reason"))


# Payment methods accepted at the desk and how they are stored.
DESK_METHODS = {"cash": "cash", "card": "credit"}


def intake_payments(T, requests: DataFrame) -> DataFrame:
    """J17 (payments by staff; ``actor`` 'admin' skips the hotel scope):
    amount at least 0.01, method 'cash' or 'card' (stored as 'credit',
    B6), renting exists, renting active, renting at the employee's hotel
    (checked in this order)."""
    rooms = T["room"].select("room_id", F.col("hotel_id").alias("renting_hotel"))
    r = T["renting"].select("renting_id", F.col("status").alias("_rs"), "room_id").join(rooms, "room_id", "left")
    staff = T["employee"].select("employee_id", F.col("hotel_id").alias("staff_hotel"))
    m = F.btrim(F.col("method_raw"))
    j = requests.join(r, "renting_id", "left").join(staff, "employee_id", "left")
    reason = F.when(F.col("amount").isNull() | (F.col("amount") < F.lit(0.01)), "amount_not_positive") \
        .when(~m.isin(*DESK_METHODS), "invalid_method") \
        .when(F.col("_rs").isNull(), "no_such_renting") \
        .when(F.col("_rs") != "active", "renting_not_active") \
        .when((F.col("actor") != "admin")
              & (F.col("staff_hotel").isNull() | (F.col("staff_hotel") != F.col("renting_hotel"))), "other_hotel")
    stored = F.when(m == "card", F.lit(DESK_METHODS["card"])).when(m == "cash", F.lit("cash"))
    return j.select("request_id", "renting_id", "employee_id", "amount", stored.alias("method"),
                    reason.isNull().alias("qualified"), reason.alias("reason"))


def first_touch_hotel(T, intake: DataFrame) -> DataFrame:
    """Customers without a hotel are attached to the hotel of the room
    of their first qualified request (accepted or not)."""
    first = intake.filter("qualified").groupBy("customer_id").agg(
        F.min_by("hotel_id", F.struct("arrival", "request_id")).alias("hotel_id"))
    return T["customer"].filter(F.col("hotel_id").isNull()).select("customer_id") \
        .join(first, "customer_id")



def complete_rentings(T, renting_ids: DataFrame) -> DataFrame:
    """Renting completion (J15, renting side): like the reference there is no
    guard (any existing id, any status, any hotel).  Returns renting-shaped
    change rows (``status`` = 'completed', ``old_status``, ``op``) for J4."""
    r = T["renting"].join(renting_ids.select("renting_id").distinct(), "renting_id", "left_semi")
    return r.withColumn("old_status", F.col("status")).withColumn("status", F.lit("completed")) \
        .withColumn("op", F.lit("update"))
