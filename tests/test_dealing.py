"""Bookings and rentings are dealt by order: once, and into the session's partitions."""

import datetime as dt
import random

from innkeep.operators import bitmaps
from innkeep.sources import bindings

D0 = dt.datetime(2026, 3, 1)


def _tables(spark):
    rng = random.Random(4)
    day = lambda: D0 + dt.timedelta(rng.randrange(90))
    orders = [(k, k % 7, rng.choice("OPF"), day(), "1-URGENT") for k in range(40)]
    lines = [(rng.randrange(45), rng.randrange(9), rng.randrange(5), rng.randrange(1, 4), float(rng.randrange(1, 30)), rng.choice("NRA"), day())
             for _ in range(160)]
    lines += lines[:30] + [(None, 1, 1, 1, 2.0, "N", D0)]
    return (spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderdate timestamp_ntz, o_orderpriority string"),
            spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                                         "l_returnflag string, l_shipdate timestamp_ntz"), orders, lines)


def test_rentings_are_dealt_once(spark):
    orders, lineitem, stored, lines = _tables(spark)
    df = bindings.renting(orders, lineitem)
    got = {r.renting_id: (r.room_id, r.customer_id, r.start_date, r.end_date) for r in df.collect()}
    want, cust = {}, {k: c for k, c, *_ in stored}
    for key in {(x[0], x[3]) for x in lines if x[0] in cust}:
        own = [x for x in lines if (x[0], x[3]) == key]
        start = min(x[6] for x in own).date()
        want[key[0] * 10 + key[1]] = (min(x[1] for x in own), cust[key[0]], start, start + dt.timedelta(int(max(x[4] for x in own))))
    assert got == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [l_orderkey") == 1


def test_orders_are_not_merged_into_few_tasks(spark):
    orders, lineitem, stored, _ = _tables(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for df in (bindings.booking(orders, lineitem), bindings.renting(orders, lineitem)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert any("RepartitionByExpression [o_orderkey" in x and x.rstrip().endswith(f", {parts}") for x in plan.splitlines()), plan


def test_far_stays_leave_by_their_own_dates(spark):
    """Both ends of the horizon are filters that reach the stays' tables."""
    orders, lineitem, *_ = _tables(spark)
    near = bitmaps.occupancy(bindings.booking(orders, lineitem), D0.date() + dt.timedelta(30), 20)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("RepartitionByExpression [o_orderkey"):]
    assert "< 2026-04-20" in below.split("LogicalRDD")[0]


def test_stays_without_an_end_count_to_the_horizon(spark):
    first = D0.date()
    blocks = spark.createDataFrame([(1, None, first + dt.timedelta(2)), (2, first + dt.timedelta(1), None), (3, first + dt.timedelta(4), None)],
                                   "room_id long, start_date date, end_date date")
    got = {r.room_id: r.words for r in bitmaps.occupancy(blocks, first, 4).collect()}
    assert got == {1: [0b0011], 2: [0b1110]}
