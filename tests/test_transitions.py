"""J15 against a sequential replay, and the status stream after every micro-batch."""

import datetime as dt
import random

from innkeep.operators.rank import last_before
from innkeep.plans import transitions
from innkeep.plans.status import status_as_of
from innkeep.streaming import jobs

TODAY = dt.date(2024, 5, 10)


def day(n):
    return TODAY + dt.timedelta(days=n)


def tables(spark, bookings):
    return {
        "room": spark.createDataFrame([(r, 1 + r % 2, "available") for r in range(1, 7)],
                                      "room_id long, hotel_id long, current_status string"),
        "employee": spark.createDataFrame([(100, 1), (101, 2)], "employee_id long, hotel_id long"),
        "booking": spark.createDataFrame(bookings, "booking_id long, room_id long, customer_id long, start_date date, end_date date, status string"),
        "renting": spark.createDataFrame([], "renting_id long, room_id long, customer_id long, source_booking_id long, "
                                             "start_date date, end_date date, status string"),
    }


REQ = ("request_id long, booking_id long, arrival timestamp_ntz, action string, actor string, actor_employee_id long, "
       "actor_customer_id long, new_start date, new_end date")


def replay(bookings, requests):
    """The rules one request at a time; clashes are looked up in the stored stays."""
    stored = {b[0]: b for b in bookings}
    now = {b[0]: (b[5], b[3], b[4]) for b in bookings}
    hotel = {100: 1, 101: 2}
    out = {}
    for rid, bid, _at, act, actor, emp, cust, ns, ne in sorted(requests, key=lambda r: (r[2], r[0])):
        st, a, z = now.get(bid, (None, None, None))
        b = stored.get(bid)
        other = actor == "staff" and (emp not in hotel or (b and hotel[emp] != 1 + b[1] % 2))
        open_ = st in ("reserved", "checked_in")
        why = None
        if actor == "customer" and act != "cancel":
            why = "staff_only"
        elif act == "redate" and (ns is None or ne is None):
            why = "no_date"
        elif act == "redate" and ns < TODAY:
            why = "start_in_past"
        elif act == "redate" and ne <= ns:
            why = "bad_range"
        elif b is None or (actor == "customer" and b[2] != cust):
            why = "no_such_booking"
        elif other:
            why = "other_hotel"
        elif act in ("redate", "check_in") and st != "reserved":
            why = "not_reserved"
        elif act == "cancel" and (st != "reserved" if actor == "customer" else not open_):
            why = "not_cancellable"
        elif act == "complete" and not open_:
            why = "not_open"
        elif act == "cancel" and z < TODAY:
            why = "already_ended"
        elif act == "check_in" and a != TODAY:
            why = "not_arrival_day"
        elif act == "complete" and z >= TODAY:
            why = "not_ended"
        elif act == "redate":
            for k, name in ((1, "room_booking"), (2, "customer_booking")):
                if not why and any(o[0] != bid and o[k] == b[k] and o[5] in ("reserved", "checked_in")
                                   and o[3] < ne and ns < o[4] for o in bookings):
                    why = name
        if why is None:
            to = {"check_in": "checked_in", "cancel": "cancelled", "complete": "completed"}.get(act, st)
            now[bid] = (to, ns, ne) if act == "redate" else (to, a, z)
        out[rid] = (why, st, *now.get(bid, (None, None, None)))
    return out


def random_case(seed, n_requests, hot):
    rnd = random.Random(seed)
    bookings = []
    for i in range(1, 31):
        a = rnd.randint(-6, 4)
        bookings.append((i, rnd.randint(1, 6), rnd.randint(1, 12), day(a), day(a + rnd.randint(1, 5)),
                         rnd.choice(["reserved", "reserved", "reserved", "checked_in", "completed"])))
    requests = []
    for i in range(n_requests):
        bid = hot if hot and rnd.random() < 0.5 else rnd.randint(1, 32)
        actor = rnd.choice(["admin", "admin", "staff", "customer"])
        ns = rnd.choice([TODAY, TODAY, day(rnd.randint(-1, 40))])
        act = rnd.choice(["cancel", "check_in", "complete", "redate", "redate"]) if bid != hot or i > 0.9 * n_requests else "redate"
        requests.append((i, bid, dt.datetime(2024, 5, 1) + dt.timedelta(minutes=i // 2 * 7 % 911 if bid != hot else i), act, actor,
                         rnd.choice([100, 101, None]) if actor == "staff" else None,
                         rnd.randint(1, 12) if actor == "customer" else None,
                         ns if act == "redate" and rnd.random() < 0.95 else None, ns + dt.timedelta(days=rnd.randint(0, 3))))
    return bookings, requests


def decided(spark, bookings, requests):
    T = tables(spark, bookings)
    return T, transitions.apply_transitions(T, spark.createDataFrame(requests, REQ).repartition(5), TODAY)


def test_matches_replay(spark):
    for seed, n, hot in ((1, 150, 0), (2, 600, 7)):
        bookings, requests = random_case(seed, n, hot)
        got = {r.request_id: (r.reason, r.old_status, r.new_status, r.new_start_date, r.new_end_date)
               for r in decided(spark, bookings, requests)[1].collect()}
        assert got == replay(bookings, requests)
        assert len(got) == n


def test_cancel_and_check_in_of_one_booking(spark):
    """Contradicting requests: the earlier holds, the later meets the new status."""
    at = dt.datetime(2024, 5, 10, 9)
    base = (1, at, "check_in", "admin", None, None, None, None)
    for first, second, why in (("cancel", "check_in", "not_reserved"), ("check_in", "cancel", None)):
        requests = [(5, 1, at, first, *base[3:]), (6, 1, at, second, *base[3:])]
        out = decided(spark, [(1, 1, 1, TODAY, day(2), "reserved")], requests)[1].orderBy("request_id").collect()
        assert [r.reason for r in out] == [None, why]
        assert out[1].old_status == out[0].new_status


def test_empty_requests(spark):
    assert decided(spark, [(1, 1, 1, TODAY, day(2), "reserved")], [])[1].count() == 0


def test_last_before_hot_group(spark):
    rnd = random.Random(4)
    rows = [(None if i % 50 == 7 else 0 if i % 3 else rnd.randint(1, 9), i, rnd.choice([None, None, i])) for i in range(900)]
    got = {(r.g, r.o): r.p for r in last_before(spark.createDataFrame(rows, "g long, o long, v long"), ["g"], ["o"], "v", "p").collect()}
    last, want = {}, {}
    for g, o, v in rows:
        want[g, o] = last.get(g)
        last[g] = v if v is not None else last.get(g)
    assert got == want


def test_status_stream_after_each_batch(spark):
    """After k micro-batches the touched rooms' statuses are those of the batch form over the first k."""
    bookings, requests = random_case(11, 200, 0)
    T, all_ = decided(spark, bookings, requests)
    all_ = all_.checkpoint()
    src, out, ckpt = (jobs.scratch_dir(spark, x) for x in ("sc", "so", "sk"))
    for lo, hi in ((0, 70), (70, 140), (140, 200)):
        part = all_.join(ranks(spark, requests).filter(f"rank >= {lo} and rank < {hi}"), "request_id")
        transitions.transition_changes(T, part).coalesce(1).write.mode("append").parquet(src)
        emitted = jobs.status_stream(spark, T, src, TODAY, out, ckpt)
        upto = all_.join(ranks(spark, requests).filter(f"rank < {hi}"), "request_id")
        after = {**T, "booking": transitions.bookings_after(T, upto)}
        touched = {r.room_id for r in transitions.transition_changes(T, upto).collect()}
        want = {r.room_id: r.status for r in status_as_of(after, TODAY).collect() if r.room_id in touched}
        assert {r.room_id: r.status for r in jobs.latest_status(emitted).collect()} == want


def ranks(spark, requests):
    order = sorted(requests, key=lambda r: (r[2], r[0]))
    return spark.createDataFrame([(r[0], i) for i, r in enumerate(order)], "request_id long, rank long")
