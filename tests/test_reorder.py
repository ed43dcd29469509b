"""J15 in which re-dates of a batch meet each other, against a replay over all bookings."""


import pytest

from innkeep.plans import reorder
from innkeep.registry import AS_OF
from innkeep.sources.bindings import transition_requests
from tests.test_transitions import REQ, TODAY, random_case, tables


def replay_all(bookings, rentings, requests, hotel_of, staff, today):
    """Every request meets all bookings as those before it left them."""
    now = {b[0]: tuple(b[:6]) for b in bookings}
    out = {}
    for rid, bid, _at, act, actor, emp, cust, ns, ne in sorted(requests, key=lambda r: (r[2], r[0])):
        b = now.get(bid)
        st, a, z = (b[5], b[3], b[4]) if b else (None, None, None)
        other = b and actor == "staff" and (emp not in staff or staff[emp] != hotel_of[b[1]])
        open_ = st in ("reserved", "checked_in")
        why = None
        if actor == "customer" and act not in ("cancel", "invalid"):
            why = "staff_only"
        elif act == "redate" and (ns is None or ne is None):
            why = "no_date"
        elif act == "redate" and ns < today:
            why = "start_in_past"
        elif act == "redate" and ne <= ns:
            why = "bad_range"
        elif act == "invalid":
            why = "unknown_action"
        elif b is None or (act == "cancel" and actor == "customer" and b[2] != cust):
            why = "no_such_booking"
        elif other:
            why = "other_hotel"
        elif act in ("redate", "check_in") and st != "reserved":
            why = "not_reserved"
        elif act == "cancel" and (st != "reserved" if actor == "customer" else not open_):
            why = "not_cancellable"
        elif act == "complete" and not open_:
            why = "not_open"
        elif act == "cancel" and z < today:
            why = "already_ended"
        elif act == "check_in" and a != today:
            why = "not_arrival_day"
        elif act == "complete" and z >= today:
            why = "not_ended"
        elif act == "redate":
            for k, kind in ((1, "room"), (2, "customer")):
                if not why and any(o[0] != bid and o[k] == b[k] and o[5] in ("reserved", "checked_in")
                                   and o[3] < ne and ns < o[4] and o[3] < o[4] for o in now.values()):
                    why = f"{kind}_booking"
                if not why and any(r[k] == b[k] and r[6] == "active" and r[4] < ne and ns < r[5] and r[4] < r[5] for r in rentings):
                    why = f"{kind}_renting"
        if why is None:
            now[bid] = (*b[:3], ns, ne, st) if act == "redate" else (
                *b[:5], {"check_in": "checked_in", "cancel": "cancelled", "complete": "completed"}[act])
        after = now.get(bid)
        out[rid] = (why, st, a, z, *((after[5], after[3], after[4]) if after else (None,) * 3))
    return out


def outcome(df):
    return {r.request_id: (r.reason, r.old_status, r.old_start_date, r.old_end_date, r.new_status, r.new_start_date, r.new_end_date)
            for r in df.collect()}


@pytest.mark.parametrize("seed,n,hot,most", [(2, 500, 7, None), (1, 200, 0, 40)])
def test_equals_replay_over_all_bookings(spark, seed, n, hot, most):
    bookings, requests = random_case(seed, n, hot)
    T = tables(spark, bookings)
    hotel_of = {r: 1 + r % 2 for r in range(1, 7)}
    got = outcome(reorder.apply_in_order(T, spark.createDataFrame(requests, REQ).repartition(5), TODAY, most))
    want = replay_all(bookings, [], requests, hotel_of, {100: 1, 101: 2}, TODAY)
    assert got == want and len(got) == n
    assert {"room_booking", None} <= {w[0] for w in want.values()}


def test_moved_booking_frees_its_days(spark):
    from datetime import datetime, timedelta
    day = lambda k: TODAY + timedelta(days=k)
    bookings = [(1, 1, 1, day(1), day(3), "reserved"), (2, 1, 2, day(5), day(7), "reserved"), (3, 1, 3, day(9), day(11), "reserved")]
    ask = lambda i, b, a, z: (i, b, datetime(2024, 5, 1, 0, i), "redate", "admin", None, None, day(a), day(z))
    requests = [ask(1, 2, 1, 2), ask(2, 1, 20, 22), ask(3, 2, 1, 2), ask(4, 3, 21, 23), ask(5, 3, 5, 7)]
    for most in (None, 1):
        got = outcome(reorder.apply_in_order(tables(spark, bookings), spark.createDataFrame(requests, REQ), TODAY, most))
        assert {k: v[0] for k, v in got.items()} == {1: "room_booking", 2: None, 3: None, 4: "room_booking", 5: None}


def test_nothing_asked(spark):
    T = tables(spark, [(1, 1, 1, TODAY, TODAY, "reserved")])
    assert reorder.apply_in_order(T, spark.createDataFrame([], REQ), TODAY).count() == 0


def test_given_tables_equal_replay(spark, T_small):
    import datetime as dt
    requests = transition_requests(T_small["_raw"]["events"], T_small["_raw"]["orders"])
    cols = ["booking_id", "room_id", "customer_id", "start_date", "end_date", "status"]
    bookings = [tuple(r) for r in T_small["booking"].select(*cols).collect()]
    rentings = [tuple(r) for r in T_small["renting"].select("renting_id", "room_id", "customer_id", "source_booking_id",
                                                            "start_date", "end_date", "status").collect()]
    asked = [tuple(r) for r in requests.select(*[c.split()[0] for c in REQ.split(", ")]).collect()]
    hotel_of = dict(map(tuple, T_small["room"].select("room_id", "hotel_id").collect()))
    staff = dict(map(tuple, T_small["employee"].select("employee_id", "hotel_id").collect()))
    today = dt.date.fromisoformat(AS_OF) if isinstance(AS_OF, str) else AS_OF
    got = outcome(reorder.apply_in_order(T_small, requests, AS_OF))
    assert got == replay_all(bookings, rentings, asked, hotel_of, staff, today)


def test_components_are_linked_once_a_round(spark, monkeypatch):
    """Where every component is small, one linking is all that the replay needs."""
    calls = []
    monkeypatch.setattr(reorder, "components", lambda edges, real=reorder.components: calls.append(1) or real(edges))
    bookings, requests = random_case(3, 60, 7)
    got = outcome(reorder.apply_in_order(tables(spark, bookings), spark.createDataFrame(requests, REQ), TODAY))
    assert len(got) == 60 and len(calls) == 1
