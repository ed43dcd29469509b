"""Bookings and rentings in one arrival order, batch and stream, against a replay."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from innkeep.plans.arrivals import admit_all, admit_arrivals, with_accepted
from innkeep.plans.conflicts import RULES
from innkeep.registry import _arrivals
from innkeep.streaming import jobs

D0 = dt.date(2024, 1, 1)
REQ = ("request_id long, arrival timestamp_ntz, record_type string, room_id long, customer_id long, source_booking_id long, "
       "start_date date, end_date date")
BOOK = "booking_id long, room_id long, customer_id long, start_date date, end_date date, status string"
RENT = "renting_id long, room_id long, customer_id long, source_booking_id long, start_date date, end_date date, status string"


def replay(bookings, rentings, requests, rooms, guests):
    """Each request meets the stored stays and the requests accepted before it."""
    stays = [("booking", b[0], b[1], b[2], b[3], b[4]) for b in bookings if b[5] in ("reserved", "checked_in")]
    stays += [("renting", r[0], r[1], r[2], r[4], r[5]) for r in rentings if r[6] == "active"]
    known, out = {b[0] for b in bookings}, {}
    place = {}
    for s in stays:
        place.setdefault(("room", s[2]), []).append(s)
        place.setdefault(("customer", s[3]), []).append(s)
    for rid, _at, kind, room, guest, source, a, z in sorted(requests, key=lambda r: (r[1], r[0])):
        why = None
        if a is None or z is None or z <= a:
            why = "bad_range"
        elif room not in rooms:
            why = "no_such_room"
        elif guest not in guests:
            why = "no_such_customer"
        elif source is not None and source not in known:
            why = "no_such_booking"
        for rule in RULES[kind] if why is None else ():
            key, by = rule.split("_")
            others = place.get((key, room if key == "room" else guest), [])
            if any(s[0] == by and s[4] < z and a < s[5] and s[4] < s[5] and not (by == "booking" and kind == "renting" and s[1] == source)
                   for s in others):
                why = rule
                break
        if why is None:
            s = (kind, -rid - 1, room, guest, a, z)
            place.setdefault(("room", room), []).append(s)
            place.setdefault(("customer", guest), []).append(s)
        out[rid] = why
    return out


def random_case(seed, n):
    rng = random.Random(seed)
    day = lambda k: D0 + dt.timedelta(k)
    span = lambda: (lambda a: (day(a), day(a + rng.choice([0, 1, 2, 3, 6]))))(rng.randrange(40))
    bookings = [(i, rng.randrange(6), rng.randrange(9), *span(), rng.choice(["reserved", "checked_in", "cancelled"])) for i in range(25)]
    rentings = [(i, rng.randrange(6), rng.randrange(9), rng.choice([None, i]), *span(), rng.choice(["active", "completed"])) for i in range(12)]
    requests = []
    for i in range(n):
        kind, source = rng.choice(["booking", "renting"]), None
        room, guest, (a, z) = rng.randrange(7), rng.randrange(10), span()
        if kind == "renting" and rng.random() < 0.5:
            b = rng.choice(bookings)
            source, room, guest, a, z = rng.choice([b[0], 99]), b[1], b[2], b[3], b[4]
        requests.append((i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randrange(n)), kind, room, guest, source, a, z))
    return bookings, rentings, requests


def tables(spark, bookings, rentings):
    return {"booking": spark.createDataFrame(bookings, BOOK), "renting": spark.createDataFrame(rentings, RENT),
            "room": spark.range(6).withColumnRenamed("id", "room_id"), "customer": spark.range(9).withColumnRenamed("id", "customer_id")}


def reasons(df):
    rows = df.collect()
    assert all(r.accepted == (r.reason is None) for r in rows)
    return {r.request_id: r.reason for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_equals_replay(spark, seed):
    case = random_case(seed, 150)
    got = reasons(admit_all(tables(spark, *case[:2]), spark.createDataFrame(case[2], REQ).repartition(3)))
    assert got == replay(*case, set(range(6)), set(range(9)))
    assert None in got.values() and len(set(got.values()) & {*RULES["booking"]}) >= 3


def test_no_requests(spark):
    case = random_case(3, 0)
    assert admit_arrivals(tables(spark, *case[:2]), spark.createDataFrame([], REQ)).count() == 0


def test_stream_decides_as_it_goes_and_restarts(spark):
    """After each landed file the decisions so far are the replay's; a failed micro-batch and a
    restart repeat none."""
    bookings, rentings, requests = random_case(5, 120)
    T = tables(spark, bookings, rentings)
    requests.sort(key=lambda r: (r[1], r[0]))
    want = replay(bookings, rentings, requests, set(range(6)), set(range(9)))
    src, base = jobs.scratch_dir(spark, "t-req"), jobs.scratch_dir(spark, "t-adm")
    fails = []

    def breaks_once(T_, batch):
        decided = admit_all(T_, batch)
        if fails:
            fails.pop()
            raise RuntimeError("lost in the middle of a batch")
        return decided

    for lo, hi in ((0, 50), (50, 51), (51, 120)):
        spark.createDataFrame(requests[lo:hi], REQ).coalesce(1).write.mode("append").parquet(src)
        if lo == 51:
            fails.append(1)
            with pytest.raises(Exception, match="lost in the middle"):
                jobs.admission_stream(spark, T, src, base, breaks_once, with_accepted)
        rows = jobs.admission_stream(spark, T, src, base, breaks_once, with_accepted).collect()
        assert len(rows) == hi and {r.request_id: r.reason for r in rows} == {r[0]: want[r[0]] for r in requests[:hi]}
    assert {r.batch_id for r in rows} == {0, 1, 2}


def test_given_tables_equal_replay(spark, T_small):
    asked = _arrivals(T_small).checkpoint()
    cols = [c.split()[0] for c in REQ.split(", ")]
    pull = lambda name, cs: [tuple(r) for r in T_small[name].select(*cs).collect()]
    bookings = pull("booking", [c.split()[0] for c in BOOK.split(", ")])
    rentings = pull("renting", [c.split()[0] for c in RENT.split(", ")])
    want = replay(bookings, rentings, [tuple(r) for r in asked.select(*cols).collect()],
                  {r[0] for r in pull("room", ["room_id"])}, {r[0] for r in pull("customer", ["customer_id"])})
    assert reasons(admit_all(T_small, asked)) == want
    assert asked.filter(F.col("record_type") == "renting").count() > 0 and len(set(want.values())) >= 6
    src = jobs.stage_in_order(asked, jobs.scratch_dir(spark, "t-all"), ["arrival", "request_id"], 3)
    got = jobs.admission_stream(spark, T_small, src, jobs.scratch_dir(spark, "t-out"), admit_all, with_accepted)
    assert reasons(got) == want
