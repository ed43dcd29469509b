"""J15 over one batch in which re-dates meet each other: cells are released as well as claimed.

``apply_transitions`` looks clashes up in the stored stays.  Here a request meets every other
booking as the requests before it have left it: a cancelled, completed or moved booking has
released its days, a moved one holds its new days, and of two re-dates onto the same days the
first wins.

Only bookings that could get in each other's way need an order among them: those that some
re-date of the batch wants days of, and that have requests themselves.  They are linked by the
days (of a room or a guest) that they share, and every component of linked bookings is replayed
in (arrival, request_id) order by itself.  All other bookings go the parallel way of
``apply_transitions``, against the stored stays.

A component of more than ``REPLAY`` requests isn't gathered: the requests that come first for
their booking and on all of their days are decided at the same time, their outcome is applied,
and what is left is linked anew, until the components are small.  The earliest request is always
among them, so the rounds end by themselves.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.functions.columns import as_date
from innkeep.operators.components import components
from innkeep.operators.intervals import day_cells
from innkeep.plans.common import left_join_known
from innkeep.plans.conflicts import RULES, find_conflicts
from innkeep.plans.transitions import TARGETS, apply_transitions
from innkeep.session import ensure_checkpoint_dir
from innkeep.sources.schemas import BLOCKING_BOOKING

#: Requests of a component that one task may replay.
REPLAY = 100_000
CELL = ["kind", "key", "day"]
OUT = ("request_id long, booking_id long, arrival {at}, action string, accepted boolean, reason string, old_status string, "
       "old_start_date date, old_end_date date, new_status string, new_start_date date, new_end_date date")


def decide(r, state: tuple, as_of, perm: set, taken) -> str | None:
    """Why request ``r`` fails on a booking of ``state`` (status, start, end); None: it passes.

    ``perm``: rules that its new range breaks against stays nobody moves; ``taken(kind)``:
    whether a booking that has been moved, or may be, holds a day of it.
    """
    status, start, end = state
    open_, customer, act = status in BLOCKING_BOOKING, r.actor == "customer", r.action
    other_hotel = r.actor == "staff" and (pd.isna(r.actor_hotel) or r.actor_hotel != r.booking_hotel)
    if customer and act not in ("cancel", "invalid"):
        return "staff_only"
    if act == "redate":
        if r.new_start is None or r.new_end is None:
            return "no_date"
        if r.new_start < as_of:
            return "start_in_past"
        if r.new_end <= r.new_start:
            return "bad_range"
    elif act not in TARGETS:
        return "unknown_action"
    if act == "cancel" and customer and r.customer_id != r.actor_customer_id:
        return "no_such_booking"
    if other_hotel:
        return "other_hotel"
    if act == "cancel":
        if (status != "reserved") if customer else not open_:
            return "not_cancellable"
        return "already_ended" if end < as_of else None
    if act == "complete":
        return "not_open" if not open_ else "not_ended" if end >= as_of else None
    if status != "reserved":
        return "not_reserved"
    if act == "check_in":
        return "not_arrival_day" if start != as_of else None
    for rule in RULES["booking"]:
        if rule in perm or (rule.endswith("_booking") and taken(rule.split("_")[0])):
            return rule
    return None


def replay(rows: pd.DataFrame, as_of) -> pd.DataFrame:
    """Decide the requests of one component in order.

    Every row holds a booking (booking_id, room_id, customer_id, status, start, end); rows with
    a request_id are requests on it, the others only say that the booking is there.
    """
    rows = rows.astype(object).where(rows.notna(), None)
    now, place = {}, {"room": {}, "customer": {}}
    for b in rows.itertuples():
        now[b.booking_id] = (b.status, b.start, b.end)
        place["room"].setdefault(b.room_id, set()).add(b.booking_id)
        place["customer"].setdefault(b.customer_id, set()).add(b.booking_id)
    asked = rows[rows["request_id"].notna()].sort_values(["arrival", "request_id"], kind="stable")
    out = []
    for r in asked.itertuples():
        def taken(kind, r=r) -> bool:
            for other in place[kind][getattr(r, f"{kind}_id")]:
                st, a, z = now[other]
                if other != r.booking_id and st in BLOCKING_BOOKING and a < r.new_end and r.new_start < z and a < z:
                    return True
            return False

        state = now[r.booking_id]
        why = decide(r, state, as_of, set(r.perm if r.perm is not None else ()), taken)
        if why is None:
            now[r.booking_id] = ((state[0], r.new_start, r.new_end) if r.action == "redate" else (TARGETS[r.action], *state[1:]))
        out.append((r.request_id, r.booking_id, r.arrival, r.action, why is None, why, *state, *now[r.booking_id]))
    return pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])


def _touched(left: DataFrame, states: DataFrame) -> DataFrame:
    """(booking_id, request_id or null, cell): days of re-dates, and the days that bookings hold among them."""
    asked = left.filter("live").select("room_id", "customer_id", F.col("new_start").alias("start_date"), F.col("new_end").alias("end_date"))
    wanted = day_cells(asked, []).distinct()
    held = day_cells(states.filter(F.col("status").isin(*BLOCKING_BOOKING)).select(
        "booking_id", "room_id", "customer_id", F.col("start").alias("start_date"), F.col("end").alias("end_date")), ["booking_id"])
    new = left.filter("live").select("booking_id", "request_id", "room_id", "customer_id",
                                     F.col("new_start").alias("start_date"), F.col("new_end").alias("end_date"))
    held = held.join(wanted, CELL, "left_semi").select("booking_id", F.lit(None).cast("bigint").alias("request_id"), *CELL)
    return held.unionByName(day_cells(new, ["booking_id", "request_id"])).checkpoint(eager=True)


def _linked(touched: DataFrame) -> DataFrame:
    """(booking_id, root) of bookings that share a wanted day with another one."""
    first = touched.groupBy(*CELL).agg(F.min("booking_id").alias("lo"), F.max("booking_id").alias("hi")).filter("lo < hi")
    edges = touched.join(first, CELL).select(F.col("booking_id").alias("a"), F.col("lo").alias("b"))
    return components(edges).select(F.col("node").alias("booking_id"), "root").checkpoint(eager=True)


def apply_in_order(T, requests: DataFrame, as_of, replay_most: int | None = None) -> DataFrame:
    """Decide status and date changes one after another over all bookings (columns of
    ``apply_transitions``).

    Requests without a booking and requests of bookings that nobody else's re-date touches
    take the parallel way; the linked ones are replayed.
    """
    most = REPLAY if replay_most is None else replay_most
    spark = requests.sparkSession
    ensure_checkpoint_dir(spark)
    d = as_date(as_of)
    requests = requests.checkpoint(eager=True)
    asked = requests.filter("booking_id is not null").select("booking_id").distinct()
    b = T["booking"].join(asked, "booking_id", "left_semi").select(
        "booking_id", "room_id", "customer_id", "status", F.col("start_date").alias("start"), F.col("end_date").alias("end"))
    states = b.filter(F.col("status").isin(*BLOCKING_BOOKING)).checkpoint(eager=True)
    # a re-date that may pass at some time: the booking is reserved at first, its dates are in order
    live = (F.col("action") == "redate") & (F.col("actor") != "customer") & (F.col("new_start") >= d) & (F.col("new_end") > F.col("new_start"))
    joined = requests.join(states, "booking_id").withColumn("live", F.coalesce(live & (F.col("status") == "reserved"), F.lit(False)))
    roots = _linked(_touched(joined, states))
    plain = apply_transitions(T, requests.join(roots.select("booking_id"), "booking_id", "left_anti").select(*requests.columns), as_of)

    T_rest = {**T, "booking": T["booking"].join(roots.select("booking_id"), "booking_id", "left_anti")}
    left = joined.drop("status", "start", "end").join(roots.select("booking_id"), "booking_id", "left_semi")
    new = left.filter("live").select(F.col("request_id").alias("record_id"), "booking_id", "room_id", "customer_id",
                                     F.col("new_start").alias("start_date"), F.col("new_end").alias("end_date"))
    perm = find_conflicts(T_rest, {"booking": new}, sides=("booking",)).groupBy(F.col("record_id").alias("request_id")).agg(
        F.collect_set("rule").alias("perm"))
    rooms = T["room"].select("room_id", F.col("hotel_id").cast("bigint").alias("booking_hotel"))
    staff = T["employee"].select(F.col("employee_id").alias("actor_employee_id"), F.col("hotel_id").cast("bigint").alias("actor_hotel"))
    left = left_join_known(left.join(rooms, "room_id", "left"), staff, "actor_employee_id").join(perm, "request_id", "left").checkpoint(eager=True)
    states = states.join(roots.select("booking_id"), "booking_id", "left_semi")
    done = [plain]
    schema = OUT.format(at=requests.schema["arrival"].dataType.simpleString())
    play = lambda pdf: replay(pdf, as_of_date)
    as_of_date = spark.range(1).select(d.alias("d")).first()["d"]
    touched = None
    while not left.isEmpty():
        if done[1:]:
            touched = _touched(left, states)
            roots = _linked(touched)
        rows = left.join(states.drop("room_id", "customer_id"), "booking_id").join(roots, "booking_id", "left") \
            .withColumn("root", F.coalesce("root", "booking_id"))
        small = rows.groupBy("root").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("root")
        step = rows.join(small, "root", "left_semi").groupBy("root").applyInPandas(play, schema).checkpoint(eager=True)
        done.append(step)
        left = left.join(step.select("request_id"), "request_id", "left_anti").checkpoint(eager=True)
        if left.isEmpty():
            break
        # components share no day, so those just replayed don't count
        touched = _touched(left, states) if touched is None else touched
        step = _frontier(left, states, touched, play, schema)
        done.append(step)
        left = left.join(step.select("request_id"), "request_id", "left_anti").checkpoint(eager=True)
        moved = step.filter("accepted").select("booking_id", F.struct(F.col("new_status").alias("status"), F.col("new_start_date").alias("start"),
                                                                      F.col("new_end_date").alias("end")).alias("_now"))
        states = states.join(moved, "booking_id", "left").select("booking_id", "room_id", "customer_id", *[
            F.coalesce(F.col(f"_now.{c}"), F.col(c)).alias(c) for c in ("status", "start", "end")]).checkpoint(eager=True)
    out = done[0]
    for step in done[1:]:
        out = out.unionByName(step)
    return out


def _frontier(left: DataFrame, states: DataFrame, touched: DataFrame, play, schema: str) -> DataFrame:
    """Decisions of the requests that come first for their booking and on all days they touch."""
    turn = F.struct("arrival", "request_id")
    mine = left.groupBy("booking_id").agg(F.min(turn).alias("turn"))
    # a booking's held days count for each of its requests, so its first one stands for them
    held = touched.filter("request_id is null").join(mine, "booking_id").select("booking_id", *CELL, "turn")
    new = touched.filter("request_id is not null").join(left.select("request_id", turn.alias("turn")), "request_id") \
        .select("booking_id", *CELL, "turn")
    cells = held.unionByName(new).groupBy(*CELL, "booking_id").agg(F.min("turn").alias("turn"))
    lowest = cells.groupBy(*CELL).agg(F.min("turn").alias("first"))
    # a first request must come before all others' on the days that it holds or wants
    own = held.unionByName(new.join(mine, ["booking_id", "turn"], "left_semi").select("booking_id", *CELL, "turn"))
    late = own.join(lowest, CELL).filter(F.col("first") < F.col("turn")).select("booking_id").distinct()
    ready = mine.join(late, "booking_id", "left_anti").select(F.col("turn.request_id").alias("request_id"))
    asked = left.join(ready, "request_id", "left_semi")
    rows = asked.join(states.drop("room_id", "customer_id"), "booking_id").withColumn("root", F.col("request_id"))
    # the linked bookings that now hold a day of a ready re-date
    wants = touched.join(ready, "request_id", "left_semi").select("request_id", F.col("booking_id").alias("_own"), *CELL)
    holders = wants.join(touched.filter("request_id is null").drop("request_id"), CELL).filter(F.col("booking_id") != F.col("_own")) \
        .select(F.col("request_id").alias("root"), "booking_id").distinct().join(states, "booking_id")
    return rows.unionByName(holders, allowMissingColumns=True).groupBy("root").applyInPandas(play, schema).checkpoint(eager=True)
