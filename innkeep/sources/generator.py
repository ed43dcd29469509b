"""A2: deterministic demo data set at any scale, built with ``spark.range``.

Shape follows the reference seed: chains of hotels, ``rooms_per_hotel``
rooms per hotel (hotel-major room ids), guests and staff with generated
names, a few bookings/rentings around ``as_of`` and payments for the
rentings that were active or completed when inserted.  Everything is a
pure function of the parameters; ids are assigned in the documented
order (employee ids follow the text order of their e-mail addresses).

Used as test input and for scale experiments; no registered query runs on
it (registered queries read the driver tables).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innkeep.operators.rank import global_rank
from innkeep.sources.schemas import conform

# Fixed values (must equal the reference seed): chain rows, city list,
# hotel name stems, first and last names, per-slot room capacity and amenities.
CHAINS = [
    ("Cedar Key Hotels", "145 Wellington St W, Toronto, ON", "ops@cedarkeyhotels.com", "4165558101"),
    ("Summit Harbor Group", "455 Burrard St, Vancouver, BC", "contact@summitharbor.com", "6045558201"),
    ("Northern Bloom Inns", "700 Rene-Levesque Blvd, Montreal, QC", "service@northernbloom.com", "5145558301"),
    ("Blue Ridge Stays", "25 Atlantic Ave, Boston, MA", "desk@blueridgestays.com", "6175558401"),
    ("Lakeside Horizon", "520 Pike St, Seattle, WA", "help@lakesidehorizon.com", "2065558501"),
]
CITIES = ["Toronto", "Ottawa", "Montreal", "Vancouver", "Calgary", "Edmonton", "Winnipeg",
          "Halifax", "Boston", "New York", "Chicago", "Seattle", "San Francisco", "Los Angeles"]
HOTEL_STEMS = ["Cedar Point", "Harbor View", "Skyline Court", "Maple Arc", "North Gate",
               "Aurora Bay", "Elm Grove", "Riverlight", "Summit Crest", "Pine Terrace"]
FIRST_NAMES = ["Liam", "Noah", "Oliver", "Elijah", "James", "William", "Benjamin", "Lucas", "Henry",
               "Theodore", "Emma", "Olivia", "Ava", "Sophia", "Isabella", "Mia", "Evelyn", "Harper",
               "Camila", "Gianna"]
LAST_NAMES = ["Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis",
              "Rodriguez", "Martinez", "Hernandez", "Lopez", "Gonzalez", "Wilson", "Anderson",
              "Thomas", "Taylor", "Moore", "Jackson", "Martin"]
SLOT_CAPACITY = ["single", "double", "suite", "family"]  # slot 1..4, later slots 'double'
SLOT_AMENITIES = ["WiFi, TV", "WiFi, TV, Mini-Fridge", "WiFi, TV, Balcony, Mini-Bar",
                  "WiFi, TV, Sofa-bed, Kitchenette"]  # slot 1..4
OTHER_AMENITIES = "WiFi, TV, Air Conditioning"
SEED_ISSUE = "Minor paint damage"
STAFF_TITLE = "Guest Services Agent"


def _pick(values, idx0):
    """``values[idx0]`` for a 0-based Column index (cycled)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx0 % len(values) + 1).cast("int"))


def gen_tables(spark: SparkSession, as_of, n_hotels: int = 40, rooms_per_hotel: int = 5,
               n_customers: int = 120, n_staff: int = 80, n_bookings: int = 20,
               n_rentings: int = 12, partitions: int | None = None) -> dict[str, DataFrame]:
    d0 = _dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of
    D = F.lit(d0)
    parts = partitions or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    per_chain = -(-n_hotels // len(CHAINS))

    def rng(n):
        return spark.range(1, n + 1, numPartitions=parts).withColumnRenamed("id", "g")

    chain = spark.createDataFrame(
        [(i + 1, *c) for i, c in enumerate(CHAINS)],
        "chain_id long, chain_name string, central_office_address string, contact_email string, "
        "contact_phone string").withColumn("created_at", F.lit(None).cast("timestamp"))
    g = F.col("g")
    hotel = rng(n_hotels).select(
        g.alias("hotel_id"), (((g - 1) / per_chain).cast("long") + 1).alias("chain_id"),
        F.concat(_pick(HOTEL_STEMS, g - 1), F.lit(" Hotel "), g.cast("string")).alias("hotel_name"),
        ((g - 1) % 5 + 1).cast("short").alias("category"),
        (24 + g % 14).cast("int").alias("total_rooms"),
        F.concat((120 + g).cast("string"), F.lit(" Market Street, "), _pick(CITIES, g - 1)).alias("address_line"),
        F.concat(F.lit("frontdesk"), g.cast("string"), F.lit("@hotels.example")).alias("contact_email"),
        F.concat(F.lit("5557"), F.lpad(g.cast("string"), 6, "0")).alias("contact_phone"),
        F.lit(None).cast("timestamp").alias("created_at"))
    hotel = conform(hotel, "hotel")

    # Hotel x slot 1..rooms_per_hotel; room ids hotel-major
    seq = F.col("seq")
    h = F.col("hotel_id")
    room = hotel.select("hotel_id").withColumn("seq", F.explode(F.sequence(F.lit(1), F.lit(rooms_per_hotel))))
    room = conform(room.select(
        ((h - 1) * rooms_per_hotel + seq).alias("room_id"), "hotel_id",
        (100 + seq).cast("string").alias("room_number"),
        F.when(seq <= 4, _pick(SLOT_CAPACITY, seq - 1)).otherwise("double").alias("capacity"),
        (85 + h * 3 + seq * 12).cast("decimal(10,2)").alias("base_price"),
        ((h % 7 == 0) & seq.isin(3, 4)).alias("has_sea_view"),
        ((h % 5 == 0) & seq.isin(3, 4)).alias("has_mountain_view"),
        seq.isin(2, 4, 5).alias("is_extendable"),
        F.when(seq <= 4, _pick(SLOT_AMENITIES, seq - 1)).otherwise(OTHER_AMENITIES).alias("amenities"),
        F.when((seq == 5) & (h % 9 == 0), F.lit(SEED_ISSUE)).alias("issues"),
        F.lit("available").alias("current_status")), "room")

    def people(n, base, offset, email_fmt, phone_prefix, street_base, street):
        return rng(n).select(
            g, F.lpad((base + g).cast("string"), 9, "0").alias("legal_id"), F.lit("SIN").alias("id_type"),
            _pick(FIRST_NAMES, offset + g - 1).alias("first_name"),
            _pick(LAST_NAMES, ((offset + g - 1) / 20).cast("long")).alias("last_name"),
            F.concat(F.lit(email_fmt[0]), g.cast("string"), F.lit(email_fmt[1])).alias("email"),
            F.concat(F.lit(phone_prefix), F.lpad(g.cast("string"), 6, "0")).alias("phone"),
            F.concat((street_base + g).cast("string"), F.lit(street)).alias("address_line"))

    guests = people(n_customers, 200000000, 0, ("guest", "@staymail.com"), "6138", 40, " Willow Crescent")
    staff = people(n_staff, 700000000, n_customers, ("team", "@workmail.com"), "3439", 80, " Lakeview Drive")
    person = conform(guests.drop("g").unionByName(staff.drop("g")), "person")

    # Guests are the persons with a guest mail address (LIKE prefix/suffix),
    # numbered in legal_id order (g follows it)
    guests = guests.filter(F.col("email").like("guest%@staymail.com"))
    staff = staff.filter(F.col("email").like("team%@workmail.com"))
    rn = F.col("g")
    customer = conform(guests.select(
        rn.alias("customer_id"), "legal_id", ((rn - 1) % n_hotels + 1).alias("hotel_id"),
        F.date_sub(D, (rn % 400).cast("int")).alias("registration_date")), "customer")

    # employee ids follow the text order of the e-mail (team10 < team1@ < team2...)
    emp = global_rank(staff, ["email"], "rn")
    r = F.col("rn")
    employee = conform(emp.select(
        r.alias("employee_id"), "legal_id", (((r - 1) / 2).cast("long") + 1).alias("hotel_id"),
        F.when(r % 2 == 1, "Manager").otherwise(STAFF_TITLE).alias("role_title"),
        F.date_sub(D, (r % 365).cast("int")).alias("hired_on"), (r % 2 == 1).alias("is_manager")), "employee")

    e = F.col("employee_id")
    role = F.when(F.col("is_manager"), "manager").otherwise("employee")
    accounts = spark.createDataFrame([(1, "admin", "admin")], "account_id long, role string, username string") \
        .select("account_id", "role", "username", F.lit(None).cast("long").alias("employee_id"),
                F.lit(None).cast("long").alias("customer_id"))
    accounts = accounts.unionByName(employee.select(
        (e + 1).alias("account_id"), role.alias("role"), F.concat(role, e.cast("string")).alias("username"),
        e.alias("employee_id"), F.lit(None).cast("long").alias("customer_id")))
    accounts = accounts.unionByName(customer.select(
        (F.col("customer_id") + n_staff + 1).alias("account_id"), F.lit("customer").alias("role"),
        F.concat(F.lit("customer"), F.col("customer_id").cast("string")).alias("username"),
        F.lit(None).cast("long").alias("employee_id"), "customer_id"))
    auth_account = conform(accounts.withColumn("is_active", F.lit(True))
                           .withColumn("created_at", F.lit(None).cast("timestamp")), "auth_account")

    booking = conform(rng(n_bookings).select(
        g.alias("booking_id"), g.alias("room_id"), g.alias("customer_id"),
        ((g - 1) % n_staff + 1).alias("created_by_employee_id"),
        F.date_add(D, g.cast("int")).alias("start_date"), F.date_add(D, (g + 2).cast("int")).alias("end_date"),
        F.when(g <= 2, "completed").when(g <= 10, "reserved").when(g <= 15, "completed")
         .otherwise("cancelled").alias("status"),
        F.lit(None).cast("timestamp").alias("created_at")), "booking")

    first4 = g <= 4
    renting = conform(rng(n_rentings).select(
        g.alias("renting_id"), (30 + g).alias("room_id"), (20 + g).alias("customer_id"),
        ((g - 1) % n_staff + 1).alias("employee_id"), F.lit(None).cast("long").alias("source_booking_id"),
        F.when(first4, F.date_sub(D, 1)).otherwise(F.date_sub(D, (g + 5).cast("int"))).alias("start_date"),
        F.when(first4, F.date_add(D, 2)).otherwise(F.date_sub(D, (g + 2).cast("int"))).alias("end_date"),
        F.when(g <= 2, "completed").when(g <= 4, "active").when(g <= 8, "completed")
         .otherwise("cancelled").alias("status"),
        F.lit(None).cast("timestamp").alias("created_at")), "renting")

    # payments for rentings that were active or completed when inserted (ids 1..8)
    pay = rng(n_rentings).filter(g <= 8)
    payment = conform(pay.select(
        g.alias("payment_id"), g.alias("renting_id"), ((g - 1) % n_staff + 1).alias("employee_id"),
        (120 + g * 15).cast("decimal(12,2)").alias("amount"),
        _pick(["cash", "credit", "debit", "online"], g).alias("method"),
        F.lit(None).cast("timestamp").alias("paid_at")), "payment")
    # stored room status as the sync trigger leaves it: status at as_of
    from innkeep.plans.status import status_as_of
    T0 = {"room": room, "booking": booking, "renting": renting}
    st = status_as_of(T0, d0).withColumnRenamed("status", "_st")
    room = conform(room.join(st, "room_id").withColumn("current_status", F.col("_st")), "room")
    return {"hotel_chain": conform(chain, "hotel_chain"), "hotel": hotel, "room": room,
            "person": person, "person_raw": person, "customer": customer, "employee": employee,
            "auth_account": auth_account, "booking": booking, "renting": renting, "payment": payment}
