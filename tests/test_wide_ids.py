"""Legal ids of keys past a hundred million equal the bound ones in every query that builds them."""

import datetime as dt

from pyspark.sql import functions as F

from innkeep import registry
from innkeep.sources.bindings import _lpad_id

KEYS = [1, 99_999_999, 100_000_000, 150_000_000, 800_000_000, *range(8_000_000_000, 8_000_000_010)]


def wide_tables(spark):
    customer = spark.createDataFrame([(k, -1.0) for k in KEYS], "c_custkey long, c_acctbal double")
    person = customer.select(_lpad_id(200000000, F.col("c_custkey")).alias("legal_id"), F.lit("A").alias("first_name"), F.lit("B").alias("last_name"),
                             F.concat(F.lit("customer"), F.col("c_custkey").cast("string"), F.lit("@mail.example")).alias("email"))
    events = spark.createDataFrame([(i, dt.datetime(2020, 1, 1), k, "purchase") for i, k in enumerate(KEYS)],
                                   "event_id long, ts timestamp, user_id long, event_type string")
    part = spark.createDataFrame([(i,) for i in range(40)], "p_partkey long")
    supplier = spark.createDataFrame([(i,) for i in range(5)], "s_suppkey long")
    return {"person": person, "_raw": {"customer": customer, "events": events, "part": part, "supplier": supplier}}


def ids(spark, factor=1):
    bound = spark.createDataFrame([(k * factor,) for k in KEYS], "k long").select(_lpad_id(200000000, F.col("k")).alias("i"))
    return sorted(r["i"] for r in bound.collect())


def test_upsert_reaches_every_customer(spark):
    T = wide_tables(spark)
    new, rejects = registry._upserted(T)
    changed = [r["legal_id"] for r in new.join(T["person"], new.columns, "left_anti").collect()]
    assert sorted(changed + [r["legal_id"] for r in rejects.collect()]) == ids(spark)


def test_requests_name_the_bound_guest(spark):
    T = wide_tables(spark)
    assert sorted(r["customer_sin"] for r in registry.renting_requests(T).collect()) == ids(spark)
    assert sorted(r["customer_sin"] for r in registry.staff_booking_requests(T).collect()) == ids(spark, 2)


def test_migrated_ids_stay_different(spark):
    got = [r["legal_id"] for r in registry.q_migrate(wide_tables(spark)).collect()]
    assert sorted(got) == ids(spark) and len(set(got)) == len(KEYS)
