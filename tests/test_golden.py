"""Values measured on the driver tables (FIXTURES.md)."""

import pyspark.sql.functions as F

from innkeep.plans import conflicts, status


def test_status_counts_sf001(T_mid):
    s = status.status_as_of(T_mid, "1998-06-15")
    got = {r.status: r["count"] for r in s.groupBy("status").count().collect()}
    assert got["rented"] + got["booked"] + got["available"] + got.get("maintenance", 0) == 2000


def test_conflict_flags_sf001(T_mid):
    f = conflicts.conflict_flags(T_mid)
    got = f.agg(F.count_if("has_renting_clash").alias("r"), F.count_if("has_booking_clash").alias("b")).first()
    assert (got.r, got.b) == (2041, 2608)


def test_pair_counts_sf001(T_mid):
    assert conflicts.booking_pairs(T_mid, "room_id").count() == 1623
    assert conflicts.booking_pairs(T_mid, "customer_id").count() == 1016
    assert conflicts.booking_renting_pairs(T_mid).count() == 2319


def _counts_without_maintenance(T, day):
    T2 = dict(T)
    T2["room"] = T["room"].withColumn("current_status", F.lit("available"))
    s = status.status_as_of(T2, day)
    return {r.status: r["count"] for r in s.groupBy("status").count().collect()}


def test_status_before_maintenance_rule(T_mid):
    assert _counts_without_maintenance(T_mid, "1998-06-15") == {"available": 1721, "booked": 139, "rented": 140}
    assert _counts_without_maintenance(T_mid, "2000-01-10") == {"available": 1734, "booked": 140, "rented": 126}


def test_admission_sf001(T_mid):
    from innkeep.registry import admission_requests, admit_requests
    res = admit_requests(T_mid, admission_requests(T_mid))
    got = res.agg(F.count(F.lit(1)).alias("n"), F.count_if("accepted").alias("a"), F.max("round").alias("r")).first()
    assert (got.n, got.a, got.r) == (7986, 3487, 3)


def test_key_defects_sf001(T_mid):
    from innkeep.registry import registry
    audit = {(r.table_name, r.rule): r.n_violations for r in registry()["constraint_audit"][0](T_mid).collect()}
    assert audit[("person", "check_legal_id")] == 137
    assert audit[("person", "pk_duplicate")] == 95


def test_hotels_without_staff_sf0001(T_small):
    from innkeep.plans.reports import staff_counts
    sc = staff_counts(T_small)
    assert sc.filter((F.col("managers") + F.col("employees")) == 0).count() == 15


def test_unavailable_list_form(T_small):
    from innkeep.plans.search import unavailable_ranges
    flat = {r.room_id: r.n_blocks for r in unavailable_ranges(T_small, "1998-06-15", horizon=5000).collect()}
    lists = {r.room_id: len(r.ranges) for r in
             unavailable_ranges(T_small, "1998-06-15", horizon=5000, as_list=True).collect()}
    assert flat == lists
