"""Driver tables -> domain tables (A1 over the TPC-H-ish driver data).

The driver data has no hotels, so every domain table is a projection of
driver tables.  The same expressions are written in DuckDB SQL in
``innkeep.plans.oracle`` so both engines see identical inputs.

Scale notes: ``hotel_chain``/``hotel`` come from ``region``/``nation`` and
have a fixed size (5 / 25 rows) at every scale factor, so they are the
only tables we broadcast unconditionally.  Everything else grows with
the data and is left to AQE (runtime statistics) to pick the join.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innkeep.sources.schemas import conform

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders",
                 "lineitem", "events", "documents", "pages", "conversations"]

# Fixed values of the bindings.
CAPACITY_BY_TYPE = {"ECONOMY": "single", "STANDARD": "double", "LARGE": "suite",
                    "PROMO": "family", "SMALL": "double", "MEDIUM": "other"}
PAYMENT_METHODS = ["cash", "credit", "debit", "online"]  # by l_orderkey % 4
STAFF_TITLES = ["Manager", "Receptionist", "Concierge"]  # by s_suppkey % 3
N_HOTELS = 25
EPOCH = _dt.date(1995, 1, 1)
HIRE_EPOCH = _dt.date(1990, 1, 1)
CREATED = _dt.datetime(2000, 1, 1)


def load_driver(spark: SparkSession, sf_dir: str, names=None) -> dict[str, DataFrame]:
    names = names or DRIVER_TABLES
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def _lpad_id(base: int, key) -> F.Column:
    """Legal id of a key: nine digits from ``base``, or, past a hundred
    million keys, the leading digit of ``base`` and the key in 18 digits.
    The ids of two bases never meet and none is cut short."""
    return F.when(key < 100_000_000, F.lpad((F.lit(base) + key).cast("string"), 9, "0")) \
        .otherwise(F.concat(F.lit(str(base)[0]), F.lpad(key.cast("string"), 18, "0")))


def hotel_chain(region: DataFrame) -> DataFrame:
    k = F.col("r_regionkey")
    return conform(region.select(
        k.cast("bigint").alias("chain_id"), F.col("r_name").alias("chain_name"),
        F.concat(F.lit("1 Central Plaza, "), F.col("r_name")).alias("central_office_address"),
        F.concat(F.lit("office"), k.cast("string"), F.lit("@chain.example")).alias("contact_email"),
        F.lpad(k.cast("string"), 10, "6").alias("contact_phone"),
        F.lit(CREATED).alias("created_at")), "hotel_chain")


def hotel(nation: DataFrame) -> DataFrame:
    n = F.col("n_nationkey")
    addr = F.when(n % 7 == 0, F.col("n_name")).otherwise(
        F.concat(F.col("n_name"), F.lit(" Street,  CITY_"), (n % 10).cast("string"), F.lit(" , X")))
    return conform(nation.select(
        n.cast("bigint").alias("hotel_id"), F.col("n_regionkey").cast("bigint").alias("chain_id"),
        F.col("n_name").alias("hotel_name"), (n % 5 + 1).cast("short").alias("category"),
        (F.lit(24) + n % 14).cast("int").alias("total_rooms"), addr.alias("address_line"),
        F.concat(F.lit("front"), n.cast("string"), F.lit("@hotel.example")).alias("contact_email"),
        F.lpad(n.cast("string"), 10, "4").alias("contact_phone"),
        F.lit(CREATED).alias("created_at")), "hotel")


def room(part: DataFrame) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    ptype = F.split_part(F.col("p_type"), F.lit(" "), F.lit(1))
    cap = F.lit(None).cast("string")
    for t, c in reversed(list(CAPACITY_BY_TYPE.items())):
        cap = F.when(ptype == t, F.lit(c)).otherwise(cap)
    return conform(part.select(
        k.alias("room_id"), (k % N_HOTELS).alias("hotel_id"),
        (F.expr("p_partkey div 25") + 100).cast("string").alias("room_number"),
        F.coalesce(cap, F.lit("other")).alias("capacity"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("base_price"),
        (size % 4 == 0).alias("has_sea_view"), (size % 3 == 0).alias("has_mountain_view"),
        (k % 2 == 0).alias("is_extendable"),
        F.when(size % 3 == 0, "WiFi, TV").when(size % 3 == 1, "WiFi")
         .otherwise("WiFi, TV, Mini bar").alias("amenities"),
        F.when(size % 9 == 0, F.col("p_name")).when(size % 9 == 1, F.lit("  "))
         .otherwise(F.lit(None).cast("string")).alias("issues"),
        F.when(size == 13, "maintenance").otherwise("available").alias("current_status")), "room")


def customer(cust: DataFrame) -> DataFrame:
    c = F.col("c_custkey")
    return conform(cust.select(
        c.alias("customer_id"), _lpad_id(200000000, c).alias("legal_id"),
        F.when(c % 5 == 0, F.lit(None)).otherwise(F.col("c_nationkey")).cast("bigint").alias("hotel_id"),
        F.date_add(F.lit(EPOCH), (c % 2000).cast("int")).alias("registration_date")), "customer")


def _customer_person(cust: DataFrame, legal_id) -> DataFrame:
    c = F.col("c_custkey")
    return cust.select(
        legal_id.alias("legal_id"), F.lit("SIN").alias("id_type"),
        F.split_part(F.col("c_name"), F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part(F.col("c_name"), F.lit("#"), F.lit(2)).alias("last_name"),
        F.concat(F.lit("customer"), c.cast("string"), F.lit("@mail.example")).alias("email"),
        F.lpad(c.cast("string"), 10, "9").alias("phone"),
        F.concat((c % 500).cast("string"), F.lit(" King Street, CITY_"),
                 (F.col("c_nationkey") % 10).cast("string")).alias("address_line"))


def _staff_person(supplier: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    return supplier.select(
        _lpad_id(700000000, s).alias("legal_id"), F.lit("SIN").alias("id_type"),
        F.split_part(F.col("s_name"), F.lit("#"), F.lit(1)).alias("first_name"),
        F.split_part(F.col("s_name"), F.lit("#"), F.lit(2)).alias("last_name"),
        F.concat(F.lit("staff"), s.cast("string"), F.lit("@hotel.example")).alias("email"),
        F.lpad(s.cast("string"), 10, "8").alias("phone"),
        F.concat((s % 300).cast("string"), F.lit(" Bay Street, CITY_"),
                 (F.col("s_nationkey") % 10).cast("string")).alias("address_line"))


def person(cust: DataFrame, supplier: DataFrame) -> DataFrame:
    """Clean persons (customers and staff); legal_id is unique."""
    clean = _lpad_id(200000000, F.col("c_custkey"))
    return conform(_customer_person(cust, clean).unionByName(_staff_person(supplier)), "person")


def person_raw(cust: DataFrame, supplier: DataFrame) -> DataFrame:
    """Persons with the key defects the repair job (J8) has to fix:
    custkey % 11 = 0 -> invalid id; else custkey % 13 = 0 -> id of custkey-1."""
    c = F.col("c_custkey")
    lid = F.when(c % 11 == 0, F.concat(F.lit("X"), c.cast("string"))) \
        .when(c % 13 == 0, _lpad_id(200000000, c - 1)) \
        .otherwise(_lpad_id(200000000, c))
    return conform(_customer_person(cust, lid).unionByName(_staff_person(supplier)), "person")


def employee(supplier: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    title = F.when(s % 3 == 0, STAFF_TITLES[0]).when(s % 3 == 1, STAFF_TITLES[1]) \
        .otherwise(STAFF_TITLES[2])
    return conform(supplier.select(
        s.alias("employee_id"), _lpad_id(700000000, s).alias("legal_id"),
        F.col("s_nationkey").cast("bigint").alias("hotel_id"), title.alias("role_title"),
        F.date_add(F.lit(HIRE_EPOCH), ((s * 37) % 3000).cast("int")).alias("hired_on"),
        (s % 3 == 0).alias("is_manager")), "employee")


def auth_account(supplier: DataFrame, cust: DataFrame) -> DataFrame:
    """Accounts for staff and customers; ids divisible by 7 have none (J14 input)."""
    s, c = F.col("s_suppkey"), F.col("c_custkey")
    role = F.when(s % 3 == 0, "manager").otherwise("employee")
    staff = supplier.filter(s % 7 != 0).select(
        (s * 2).alias("account_id"), role.alias("role"),
        F.concat(role, s.cast("string")).alias("username"), s.alias("employee_id"),
        F.lit(None).cast("bigint").alias("customer_id"), (s % 10 != 3).alias("is_active"),
        F.lit(CREATED).alias("created_at"))
    custs = cust.filter(c % 7 != 0).select(
        (c * 2 + 1).alias("account_id"), F.lit("customer").alias("role"),
        F.concat(F.lit("customer"), c.cast("string")).alias("username"),
        F.lit(None).cast("bigint").alias("employee_id"), c.alias("customer_id"),
        (c % 10 != 3).alias("is_active"), F.lit(CREATED).alias("created_at"))
    return conform(staff.unionByName(custs), "auth_account")


def _dealt(orders: DataFrame) -> DataFrame:
    """``orders`` by key into as many partitions as the session has for shuffles.  Merged by their
    packed bytes, of which a row has few, they would put very many orders into one task's sorts."""
    return orders.repartition(int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")


def booking(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    per_order = lineitem.groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("room_id"),
        F.max("l_quantity").cast("int").alias("nights"),
        F.min("l_suppkey").alias("created_by_employee_id"))
    start = F.col("o_orderdate").cast("date")
    st = F.col("o_orderstatus")
    status = F.when(st == "O", "reserved").when(st == "P", "checked_in") \
        .when((st == "F") & (F.col("o_orderpriority") < "3"), "cancelled") \
        .when(st == "F", "completed")
    orders = _dealt(orders)
    return conform(orders.join(per_order, orders.o_orderkey == per_order.l_orderkey).select(
        F.col("o_orderkey").alias("booking_id"), "room_id", F.col("o_custkey").alias("customer_id"),
        "created_by_employee_id", start.alias("start_date"),
        F.date_add(start, F.col("nights")).alias("end_date"), status.alias("status"),
        F.col("o_orderdate").alias("created_at")), "booking")


def renting(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """The lines are dealt by order once, so that they are grouped and joined in one sort's order."""
    per_line = lineitem.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("room_id"), F.min("l_suppkey").alias("employee_id"),
        F.min("l_shipdate").alias("first_ship"), F.max("l_quantity").cast("int").alias("nights"),
        F.min("l_returnflag").alias("flag"))
    start = F.col("first_ship").cast("date")
    flag = F.col("flag")
    status = F.when(flag == "N", "active").when(flag == "R", "completed").when(flag == "A", "cancelled")
    return conform(per_line.join(_dealt(orders).select("o_orderkey", "o_custkey"),
                                 per_line.l_orderkey == orders.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("renting_id"), "room_id",
        F.col("o_custkey").alias("customer_id"), "employee_id",
        F.when(F.col("l_linenumber") == 1, F.col("l_orderkey")).alias("source_booking_id"),
        start.alias("start_date"), F.date_add(start, F.col("nights")).alias("end_date"),
        status.alias("status"), F.col("first_ship").alias("created_at")), "renting")


def payment(lineitem: DataFrame) -> DataFrame:
    """One payment per lineitem row (a bag: the driver has no payment key,
    so ``payment_id`` is NULL)."""
    k = F.col("l_orderkey")
    method = F.element_at(F.array(*[F.lit(m) for m in PAYMENT_METHODS]), (k % 4 + 1).cast("int"))
    return conform(lineitem.select(
        F.lit(None).cast("bigint").alias("payment_id"),
        (k * 10 + F.col("l_linenumber")).alias("renting_id"), F.col("l_suppkey").alias("employee_id"),
        F.col("l_extendedprice").cast("decimal(12,2)").alias("amount"), method.alias("method"),
        F.col("l_shipdate").alias("paid_at")), "payment")


def bind_tables(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All domain tables as lazy DataFrames (nothing is computed here)."""
    return {
        "hotel_chain": hotel_chain(raw["region"]),
        "hotel": hotel(raw["nation"]),
        "room": room(raw["part"]),
        "customer": customer(raw["customer"]),
        "person": person(raw["customer"], raw["supplier"]),
        "person_raw": person_raw(raw["customer"], raw["supplier"]),
        "employee": employee(raw["supplier"]),
        "auth_account": auth_account(raw["supplier"], raw["customer"]),
        "booking": booking(raw["orders"], raw["lineitem"]),
        "renting": renting(raw["orders"], raw["lineitem"]),
        "payment": payment(raw["lineitem"]),
    }


def load_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    raw = load_driver(spark, sf_dir)
    t = bind_tables(raw)
    t["_raw"] = raw
    return t


def _k_from_props() -> F.Column:
    return F.coalesce(F.get_json_object(F.col("props"), "$.k").try_cast("int"), F.lit(0))


def booking_requests(events: DataFrame, part: DataFrame) -> DataFrame:
    """Arriving booking requests (J2/J17/L3) from ``events`` (not 'error').

    room = (event_id * 7919) % (#parts div 4): requests crowd the first
    quarter of the rooms so that they clash.  ``#parts`` is a scalar
    subquery over ``part``.
    """
    n_rooms = part.agg((F.count(F.lit(1)) / 4).cast("bigint")).scalar()
    e = F.col("event_id")
    start = F.date_add(F.col("ts").cast("date"), _k_from_props())
    return events.filter(F.col("event_type") != "error").select(
        e.alias("request_id"), F.col("ts").alias("arrival"), F.col("user_id").alias("customer_id"),
        ((e * 7919) % n_rooms).alias("room_id"), start.alias("start_date"),
        F.date_add(start, (F.lit(1) + e % 5).cast("int")).alias("end_date"))


def arrival_requests(events: DataFrame, part: DataFrame, bookings: DataFrame) -> DataFrame:
    """Bookings and rentings in one arrival order (J2, L3): every event is a request.

    'purchase' is a walk-in renting, 'signup' a renting of the stored booking event_id (its room,
    guest and days, where there is such a booking), anything else a booking.  Rooms are
    (event_id * 7919) % (#parts + 3), so a few don't exist; every 97th range is the wrong way round.
    """
    n_rooms = part.agg(F.count(F.lit(1)) + 3).scalar()
    e, et = F.col("event_id"), F.col("event_type")
    start = F.date_add(F.col("ts").cast("date"), _k_from_props())
    nights = F.when(e % 97 == 0, -1).otherwise(F.lit(1) + e % 5).cast("int")
    kept = bookings.select(F.col("booking_id").alias("event_id"), F.col("room_id").alias("_room"), F.col("customer_id").alias("_guest"),
                           F.col("start_date").alias("_start"), F.col("end_date").alias("_end"))
    from_stored = F.col("_room").isNotNull()
    pick = lambda own, other: F.when(from_stored, F.col(own)).otherwise(other)
    asked = events.filter(et.eqNullSafe("signup")).join(kept, "event_id", "left").unionByName(
        events.filter(~et.eqNullSafe("signup")), allowMissingColumns=True)
    return asked.select(
        e.alias("request_id"), F.col("ts").alias("arrival"),
        F.when(et.isin("purchase", "signup"), "renting").otherwise("booking").alias("record_type"),
        pick("_room", (e * 7919) % n_rooms).alias("room_id"), pick("_guest", F.col("user_id")).alias("customer_id"),
        F.when(et == "signup", e).alias("source_booking_id"), pick("_start", start).alias("start_date"),
        pick("_end", F.date_add(start, nights)).alias("end_date"))


# Event type -> transition action.
ACTIONS = {"click": "check_in", "view": "cancel", "purchase": "complete", "signup": "redate",
           "error": "invalid"}


def transition_requests(events: DataFrame, orders: DataFrame) -> DataFrame:
    """Status-change requests (J15) from ``events``: four events to a booking
    (booking_id = event_id rounded down to a multiple of four).

    Actor: admin when user_id % 10 = 0, staff (employee user_id) when
    user_id is even, else a customer.  A customer actor is normally the
    owner of the booking (o_custkey of that order); when user_id % 4 = 1
    it is customer user_id instead (a request on someone else's booking).
    """
    et = F.col("event_type")
    action = F.lit(None).cast("string")
    for k, v in reversed(list(ACTIONS.items())):
        action = F.when(et == k, F.lit(v)).otherwise(action)
    e, u = F.col("event_id"), F.col("user_id")
    new_start = F.date_add(F.col("ts").cast("date"), _k_from_props())
    is_redate = et == "signup"
    role = F.when(u % 10 == 0, "admin").when(u % 2 == 0, "staff").otherwise("customer")
    owner = orders.select(F.col("o_orderkey").alias("booking_id"), "o_custkey")
    return events.withColumn("booking_id", e - e % 4).join(owner, "booking_id", "left").select(
        e.alias("request_id"), "booking_id", F.col("ts").alias("arrival"),
        F.coalesce(action, F.lit("invalid")).alias("action"), role.alias("actor"),
        F.when(role == "staff", u).alias("actor_employee_id"),
        F.when(role == "customer", F.when(u % 4 == 1, u).otherwise(F.col("o_custkey"))).alias("actor_customer_id"),
        F.when(is_redate, new_start).alias("new_start"),
        F.when(is_redate, F.date_add(new_start, (F.lit(1) + e % 5).cast("int"))).alias("new_end"))


def register_changes(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Writes to the registers (J18), one per event and register, in event order.

    'purchase' (and for customers 'signup') inserts, anything else updates.  Names, addresses and
    hotels are dealt so that changes want values of their neighbours, of each other and of
    stored rows, some ids don't exist and some fields are invalid.
    """
    ev = raw["events"]
    e, u, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
    n_staff = raw["supplier"].agg(F.count(F.lit(1))).scalar()
    n_rooms = raw["part"].agg(F.count(F.lit(1))).scalar()
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    insert = et == "purchase"
    base = [e.alias("change_id"), e.alias("ord")]
    person = [text("First", e % 50).alias("first_name"), F.lit("Last").alias("last_name"),
              F.lpad(e.cast("string"), 10, "5").alias("phone"), text("Street ", e).alias("address_line")]
    joins = insert | (et == "signup")
    customers = ev.select(
        *base, F.when(joins, "insert").otherwise("update").alias("op"), F.when(~joins, u).alias("customer_id"),
        F.when(e % 3 == 1, (e % 25).cast("bigint")).alias("scope_hotel"),
        F.when(insert, _lpad_id(300000000, e - e % 3)).when(joins, _lpad_id(200000000, u)).alias("legal_id"), *person,
        F.when(et == "error", "not an address").when(joins, text("new", e - e % 4, "@mail.example"))
         .otherwise(text("Customer", u + e % 2, "@mail.example ")).alias("email"),
        F.concat(F.lit("2024-01-0"), (e % 9 + 1).cast("string")).alias("registration_date"),
        F.when(joins & (e % 4 != 0), text("guest", e - e % 5)).when(~joins & (e % 2 == 0), text("customer", u + e % 5)).alias("username"))
    employees = ev.select(
        *base, F.when(insert, "insert").otherwise("update").alias("op"), F.when(~insert, e % (n_staff + 2)).alias("employee_id"),
        F.when(e % 4 == 1, (e % 25).cast("bigint")).alias("scope_hotel"), F.when(insert, _lpad_id(800000000, e - e % 2)).alias("legal_id"), *person,
        F.when(insert, text("hired", e - e % 3, "@hotel.example")).otherwise(text("staff", e % n_staff + e % 2, "@hotel.example")).alias("email"),
        (e % 26).alias("hotel_id"), F.lit("Clerk").alias("role_title"), F.lit("2024-02-03").alias("hired_on"),
        F.when(e % 6 == 0, "manager").when(e % 50 == 1, "owner").otherwise("employee").alias("account_role"),
        text("desk", e % (2 * n_staff)).alias("username"))
    hotels = ev.select(
        *base, F.when(insert, "insert").otherwise("update").alias("op"), F.when(~insert, e % 28).alias("hotel_id"),
        (e % 6).alias("chain_id"), text("NATION_", e % 31).alias("hotel_name"), (e % 6).cast("string").alias("category"), (10 + e % 20).alias("total_rooms"),
        text("Road ", e, ", City").alias("address_line"), text("h", e, "@x.example").alias("contact_email"), F.lpad(e.cast("string"), 10, "6").alias("contact_phone"))
    rooms = ev.select(
        *base, F.when(insert, "insert").otherwise("update").alias("op"), F.when(~insert, (e * 7919) % (n_rooms + 5)).alias("room_id"),
        (e % 26).alias("hotel_id"), (e % 37 + 100).cast("string").alias("room_number"),
        F.when(e % 40 == 3, "other").otherwise("double").alias("capacity"), (F.lit(100) + e % 90).alias("base_price"), F.lit("Wi-Fi").alias("amenities"),
        F.when(e % 3 == 0, "stain").alias("issues"), F.lit("available").alias("current_status"))
    return {"customer": customers, "employee": employees, "hotel": hotels, "room": rooms}
