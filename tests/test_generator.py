"""Golden values of the generated demo data set (FIXTURES.md §3)."""

import datetime as dt

import pyspark.sql.functions as F
import pytest

from innkeep.plans import archive, reports, search, status
from innkeep.sources.generator import gen_tables

AS_OF = dt.date(2026, 4, 10)


@pytest.fixture(scope="module")
def G(spark):
    return gen_tables(spark, AS_OF)


def test_row_counts(G):
    counts = [G[t].count() for t in ("hotel_chain", "hotel", "room", "customer", "employee",
                                      "booking", "renting", "payment")]
    assert counts == [5, 40, 200, 120, 80, 20, 12, 8]


def test_active_reservations_per_chain(G):
    got = {r.chain_name: r.active_bookings for r in reports.active_per_chain(G).collect()}
    assert got == {"Cedar Key Hotels": 8, "Summit Harbor Group": 0, "Northern Bloom Inns": 0,
                   "Blue Ridge Stays": 0, "Lakeside Horizon": 0}


def test_status_and_areas(G):
    st = {r.room_id: r.status for r in status.status_as_of(G, AS_OF).collect()}
    assert sorted(k for k, v in st.items() if v == "rented") == [33, 34]
    assert sum(v == "available" for v in st.values()) == 198
    areas = {r.area: r.available_rooms for r in reports.rooms_per_area(G).collect()}
    assert areas["Winnipeg"] == 13 and areas["San Francisco"] == 10 and areas["Toronto"] == 15


def test_capacity_and_blocks(G):
    caps = {r.aggregated_capacity for r in reports.capacity_per_hotel(G).collect()}
    assert caps == {12}
    blocked = {r.room_id for r in search.blocked_rooms(G, AS_OF + dt.timedelta(5),
                                                       AS_OF + dt.timedelta(10)).collect()}
    assert blocked == {4, 5, 6, 7, 8, 9}


def test_archive_payments_employees(G):
    a = archive.archive_backfill(G)
    got = {r.record_type: r["count"] for r in a.groupBy("record_type").count().collect()}
    assert got == {"booking": 12, "renting": 10}
    tot = G["payment"].agg(F.sum("amount")).first()[0]
    assert str(tot) == "1500.00"
    emails = [r.email for r in G["employee"].join(G["person"], "legal_id")
              .orderBy("employee_id").limit(6).collect()]
    assert emails == [f"team{i}@workmail.com" for i in range(10, 16)]


def test_rooms_features(G):
    r = G["room"].agg(F.count_if("has_sea_view"), F.count_if("has_mountain_view"),
                      F.count_if("is_extendable"), F.min("base_price"), F.max("base_price")).first()
    assert (r[0], r[1], r[2], str(r[3]), str(r[4])) == (10, 16, 120, "100.00", "265.00")


def test_overlap_demo_rejected(spark, G):
    from innkeep.registry import admit_requests
    req = spark.createDataFrame(
        [(1, dt.datetime(2026, 4, 10, 12), 5, 25, AS_OF + dt.timedelta(6), AS_OF + dt.timedelta(7))],
        "request_id long, arrival timestamp, room_id long, customer_id long, start_date date, end_date date")
    r = admit_requests(G, req).collect()
    assert [(x.accepted, x.reason) for x in r] == [(False, "room_booking")]


def test_populate_issues_one_pass(G):
    from innkeep.functions.columns import blank_as_null
    from innkeep.plans.repair import populate_issues
    before = G["room"].filter(blank_as_null("issues").isNotNull()).count()
    picked = populate_issues(G["room"]).count()
    assert (before, before + picked) == (4, 43)


def test_delete_cascade_restrict_and_customer(spark, G):
    from innkeep.plans.tables import RestrictViolation, delete_cascade, delete_summary
    # hotel 1 -> its employees (cascade) are still referenced by rentings (RESTRICT)
    with pytest.raises(RestrictViolation):
        delete_cascade(G, "hotel", spark.createDataFrame([(1,)], "hotel_id long"))
    deleted, nulled = delete_cascade(G, "customer", spark.createDataFrame([(21,)], "customer_id long"))
    got = {(r.table_name, r.action): r.n_rows for r in delete_summary(deleted, nulled).collect()}
    assert got[("customer", "delete")] == 1
    assert got[("renting", "delete")] == 1      # renting 1 belongs to customer 21
    assert got[("payment", "delete")] == 1      # payment of renting 1
    assert got[("auth_account", "delete")] == 1
    assert got[("booking", "delete")] == 0


def test_archive_transitions_rules(spark, G):
    from innkeep.plans import archive as arch
    b = G["booking"]
    changes = (b.filter(F.col("booking_id") == 3).withColumn("status", F.lit("cancelled"))
               .withColumn("old_status", F.lit("reserved")).withColumn("op", F.lit("update"))
               .unionByName(b.filter(F.col("booking_id") == 4).withColumn("old_status", F.lit("reserved"))
                            .withColumn("op", F.lit("update")))
               .unionByName(b.filter(F.col("booking_id") == 11).withColumn("old_status", F.lit(None).cast("string"))
                            .withColumn("op", F.lit("insert"))))
    existing = arch.archive_backfill(G)
    out = arch.archive_transitions(G, changes, existing).collect()
    # 3: status really changed -> archived; 4: unchanged -> nothing; 11: already archived -> nothing
    assert [(r.source_booking_id, r.final_status) for r in out] == [(3, "cancelled")]


def test_overwrite_partitions(spark, tmp_path):
    from innkeep.sources.sinks import overwrite_partitions
    path = str(tmp_path / "facts")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string")
    overwrite_partitions(df, path, ["p"])
    overwrite_partitions(spark.createDataFrame([(3, "a")], "v int, p string"), path, ["p"])
    got = sorted((r.v, r.p) for r in spark.read.parquet(path).collect())
    assert got == [(2, "b"), (3, "a")]


def test_find_account_case_insensitive(G):
    from innkeep.plans.reports import find_account
    assert [r.username for r in find_account(G, "CUSTOMER7").collect()] == ["customer7"]
    assert [r.role for r in find_account(G, "Admin").collect()] == ["admin"]
