"""Interval operators against brute force on small random stays."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from innkeep.operators.intervals import occupied_days, overlap_exists, overlap_pairs

D0 = dt.date(2000, 1, 1)
stay = st.tuples(st.integers(0, 3), st.integers(0, 90), st.integers(0, 70))


def frame(spark, stays, id_col="id"):
    rows = [(i, k, D0 + dt.timedelta(s), D0 + dt.timedelta(s + n)) for i, (k, s, n) in enumerate(stays)]
    return spark.createDataFrame(rows, f"{id_col} long, k long, start_date date, end_date date")


def brute_pairs(stays):
    out = set()
    for i, (k1, s1, n1) in enumerate(stays):
        for j, (k2, s2, n2) in enumerate(stays):
            if i < j and k1 == k2 and n1 > 0 and n2 > 0 and s1 < s2 + n2 and s2 < s1 + n1:
                out.add((k1, i, j))
    return out


@settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(stay, max_size=25))
def test_pairs_and_flags_match_brute_force(spark, stays):
    df = frame(spark, stays)
    got = {tuple(r) for r in overlap_pairs(df, df, "k", "id", "id", same_side=True, width=7).collect()}
    exp = brute_pairs(stays)
    assert got == exp
    flagged = {r[0] for r in overlap_exists(df, df, "k", left_id="id", exclude_same_id=True,
                                            width=7).collect()}
    assert flagged == {i for _k, a, b in exp for i in (a, b)}


def test_edge_cases(spark):
    # touching, nested, identical, one-day, empty
    stays = [(1, 0, 2), (1, 2, 2), (2, 0, 10), (2, 3, 1), (3, 5, 3), (3, 5, 3), (4, 4, 0), (4, 3, 3)]
    df = frame(spark, stays)
    got = {tuple(r) for r in overlap_pairs(df, df, "k", "id", "id", same_side=True, width=4).collect()}
    assert got == brute_pairs(stays) == {(2, 2, 3), (3, 4, 5)}


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(stay, max_size=15), st.integers(0, 60), st.integers(0, 40))
def test_occupied_days(spark, stays, as_of_off, horizon):
    df = frame(spark, stays).withColumnRenamed("k", "room_id")
    as_of = D0 + dt.timedelta(as_of_off)
    got = {(r[0], r[1]) for r in occupied_days(df, as_of, horizon).collect()}
    exp = set()
    for (k, s, n) in stays:
        for d in range(s, s + n):
            day = D0 + dt.timedelta(d)
            if as_of <= day <= as_of + dt.timedelta(horizon):
                exp.add((k, day))
    assert got == exp


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 20), st.integers(0, 6),
                          st.sampled_from(["reserved", "checked_in", "cancelled", "completed", "active"])),
                max_size=20),
       st.integers(0, 25), st.sets(st.integers(0, 4)))
def test_status_as_of_brute_force(spark, stays, day_off, maint):
    from innkeep.plans.status import status_as_of
    day = D0 + dt.timedelta(day_off)
    b = [(i, k, D0 + dt.timedelta(s), D0 + dt.timedelta(s + n), stt)
         for i, (k, s, n, stt) in enumerate(stays) if stt != "active"]
    r = [(i, k, D0 + dt.timedelta(s), D0 + dt.timedelta(s + n), "active")
         for i, (k, s, n, stt) in enumerate(stays) if stt == "active"]
    T = {"room": spark.createDataFrame([(k, "maintenance" if k in maint else "available") for k in range(5)],
                                       "room_id long, current_status string"),
         "booking": spark.createDataFrame(b, "booking_id long, room_id long, start_date date, end_date date, status string"),
         "renting": spark.createDataFrame(r, "renting_id long, room_id long, start_date date, end_date date, status string")}
    got = {x.room_id: x.status for x in status_as_of(T, day).collect()}
    exp = {}
    for k in range(5):
        if k in maint:
            exp[k] = "maintenance"
        elif any(x[1] == k and x[2] <= day < x[3] for x in r):
            exp[k] = "rented"
        elif any(x[1] == k and x[4] in ("reserved", "checked_in") and x[2] <= day < x[3] for x in b):
            exp[k] = "booked"
        else:
            exp[k] = "available"
    assert got == exp
