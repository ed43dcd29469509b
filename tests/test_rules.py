"""J1 rules vs brute force; J22 value rules and column functions by example."""

import datetime as dt
import random

import pyspark.sql.functions as F
import pytest

from innkeep.functions import columns as C
from innkeep.functions import intake as R
from innkeep.plans.conflicts import find_conflicts

D0 = dt.date(2021, 1, 1)


def brute_rules(bookings, rentings):
    """bookings: (id, room, cust, s, e, status); rentings: (+ source_booking_id)."""
    ob = [b for b in bookings if b[5] in ("reserved", "checked_in")]
    ar = [r for r in rentings if r[5] == "active"]

    def ov(a, b):
        return a[3] < b[4] and b[3] < a[4] and a[3] < a[4] and b[3] < b[4]

    out = set()
    for n in ob:
        for key, k in (("room", 1), ("customer", 2)):
            if any(o[k] == n[k] and o[0] != n[0] and ov(n, o) for o in ob):
                out.add(("booking", n[0], f"{key}_booking"))
            if any(o[k] == n[k] and ov(n, o) for o in ar):
                out.add(("booking", n[0], f"{key}_renting"))
    for n in ar:
        for key, k in (("room", 1), ("customer", 2)):
            if any(o[k] == n[k] and o[0] != n[0] and ov(n, o) for o in ar):
                out.add(("renting", n[0], f"{key}_renting"))
            if any(o[k] == n[k] and (n[6] is None or o[0] != n[6]) and ov(n, o) for o in ob):
                out.add(("renting", n[0], f"{key}_booking"))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_find_conflicts_brute_force(spark, seed):
    rnd = random.Random(seed)
    bst = ["reserved", "checked_in", "cancelled", "completed"]
    rst = ["active", "completed", "cancelled"]
    bookings, rentings = [], []
    for i in range(40):
        s = rnd.randint(0, 40)
        bookings.append((i, rnd.randint(0, 5), rnd.randint(0, 5), D0 + dt.timedelta(s),
                         D0 + dt.timedelta(s + rnd.randint(0, 5)), rnd.choice(bst)))
    for i in range(40):
        s = rnd.randint(0, 40)
        src = rnd.choice([None, rnd.randint(0, 39)])
        rentings.append((100 + i, rnd.randint(0, 5), rnd.randint(0, 5), D0 + dt.timedelta(s),
                         D0 + dt.timedelta(s + rnd.randint(0, 5)), rnd.choice(rst), src))
    T = {"booking": spark.createDataFrame(bookings, "booking_id long, room_id long, customer_id long, "
                                                    "start_date date, end_date date, status string"),
         "renting": spark.createDataFrame(rentings, "renting_id long, room_id long, customer_id long, "
                                                    "start_date date, end_date date, status string, "
                                                    "source_booking_id long")}
    got = {tuple(r) for r in find_conflicts(T).collect()}
    assert got == brute_rules(bookings, rentings)


def evaluate(spark, values, rule, *args):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    val, reason = R.RULES[rule](F.col("x"), *args)
    return [(r[0], r[1]) for r in df.select(val.alias("v"), reason.alias("r")).collect()]


def test_intake_rules(spark):
    assert [r for _v, r in evaluate(spark, ["  A@b.co ", "a b@c.d", "x@y", None], "email")] == \
        [None, "invalid_email", "invalid_email", "required"]
    assert evaluate(spark, ["(613) 555-0101", "555-01"], "phone") == \
        [("6135550101", None), ("55501", "phone_not_10_digits")]
    assert [r for _v, r in evaluate(spark, ["123-456-789", "12345678"], "sin")] == [None, "sin_not_9_digits"]
    assert evaluate(spark, ["12abc", " 7", "0", "x1", "-3"], "int", 1) == \
        [(12, None), (7, None), (None, "not_int_ge_min"), (None, "not_int_ge_min"), (None, "not_int_ge_min")]
    assert evaluate(spark, ["9" * 45], "int", 1) == [(None, "not_int_ge_min")]  # overflow is a reject
    assert [r for _v, r in evaluate(spark, ["12.5kg", "abc", "0.001"], "number", 0.01)] == \
        [None, "not_number_ge_min", "not_number_ge_min"]
    assert evaluate(spark, ["Yes", "off", "maybe"], "bool") == [(True, None), (False, None), (None, "invalid_boolean")]
    assert [r for _v, r in evaluate(spark, ["2024-02-30", "2024-02-28", "24-2-1"], "date")] == \
        ["invalid_date", None, "invalid_date"]
    assert [r for _v, r in evaluate(spark, ["ab", "Good.Name_1", "bad name"], "username")] == \
        ["invalid_username", None, "invalid_username"]
    assert [r for _v, r in evaluate(spark, ["\tcash\n", "wire"], "enum", ["cash"])] == [None, "not_allowed"]
    assert [r for _v, r in evaluate(spark, ["", "abcdef"], "string", 5)] == ["required", "too_long"]


def test_column_functions(spark):
    df = spark.createDataFrame(
        [("12 King St,  Ottawa , ON", "Ann", None, "double", "checked in", "credit"),
         ("Only Name", "Bo", "Li", "other", "reserved", "card"),
         ("x,\tTab\t", "A", "B", "family", "x", "cash")],
        "addr string, f string, l string, cap string, st string, m string")
    rows = df.select(C.area("addr"), C.full_name("f", "l"), C.capacity_weight("cap"),
                     C.status_slug("st"), C.payment_method_label("m"),
                     C.payment_method_intake("m")).collect()
    assert [tuple(r) for r in rows] == [
        ("Ottawa", None, 2, "checked_in", "card", "credit"),
        ("Only Name", "Bo Li", 0, "reserved", "card", "credit"),
        ("\tTab\t", "A B", 4, "x", "cash", "cash")]
    ov = spark.createDataFrame([(1,)], "a int").select(
        C.overlaps(dt.date(2020, 1, 1), dt.date(2020, 1, 3), dt.date(2020, 1, 3), dt.date(2020, 1, 5)).alias("touch"),
        C.overlaps(dt.date(2020, 1, 2), dt.date(2020, 1, 2), dt.date(2020, 1, 1), dt.date(2020, 1, 5)).alias("empty"),
        C.covers(F.lit(dt.date(2020, 1, 1)), F.lit(dt.date(2020, 1, 3)), "2020-01-03").alias("end_excl")).first()
    assert (ov.touch, ov.empty, ov.end_excl) == (False, False, False)


def test_toronto_today(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 1, 1, 3, 0),)], "ts timestamp")
    assert df.select(C.toronto_today("ts")).first()[0] == dt.date(2025, 12, 31)
