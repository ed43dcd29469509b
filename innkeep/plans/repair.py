"""Data repair jobs (J8-J14), each a pure function of its inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.functions.columns import as_date, blank_as_null, view_flags
from innkeep.operators.rank import global_rank, rank_within_groups

SIN_RE = "^[0-9]{9}$"

# Issue texts assigned by J12 (by rank % 4) and the room
# capacity cycle used by J13 (by slot % 5).
ISSUE_TEXTS = ["Minor paint damage near balcony door", "AC filter noise at high fan speed",
               "Bathroom sink drains slowly", "Desk lamp flickers intermittently"]
CAPACITY_CYCLE = ["single", "double", "suite", "family", "double"]
FIRST_ROOM_NUMBER = 100
NEW_ROOM_AMENITIES = "WiFi, TV"
# Fixed values for staff created by J13: titles (manager, employee), first
# names, last-name prefixes (+ hotel id), mail suffix, street suffix.
STAFF_TITLES = ["Manager", "Guest Services Agent"]
NEW_STAFF_FIRST = ["Hotel", "Frontdesk"]
NEW_STAFF_LAST = ["Manager", "Employee"]
NEW_STAFF_MAIL = "@workmail.com"
NEW_STAFF_STREET = " Service Road"
DEFAULT_MAX_SIN = 100000000


def duplicate_rank(person: DataFrame, tie: str = "email") -> DataFrame:
    """rank inside each legal_id (1 = keeps the id), ordered by ``tie``.
    Distributed even when one id has a huge number of copies."""
    return rank_within_groups(person, ["legal_id"], [F.col(tie).asc_nulls_last()], "duplicate_rank")


def repair_keys(person: DataFrame, tie: str = "email") -> DataFrame:
    """Invalid or duplicate legal ids get ``max valid id + rank``
    (rank over ``(legal_id, tie)``), zero padded to 9 digits; id_type is
    forced to 'SIN'.  Returns the whole repaired table plus ``old_legal_id``.

    A row whose new id would need more than 9 digits gets none: its id is
    NULL and ``key_overflow`` marks it as a reject (``repair_rejects``).
    """
    ranked = duplicate_rank(person, tie)
    bad = ~F.col("legal_id").rlike(SIN_RE) | (F.col("duplicate_rank") > 1)
    max_sin = person.filter(F.col("legal_id").rlike(SIN_RE)) \
        .agg(F.coalesce(F.max(F.col("legal_id").cast("bigint")), F.lit(DEFAULT_MAX_SIN)).alias("m"))
    to_fix = global_rank(ranked.filter(bad), ["legal_id", tie], "fix_rank")
    m = max_sin.scalar()  # one-row aggregate as a scalar subquery
    fixed = to_fix.withColumn("m", m).select(
        *[c for c in person.columns if c != "legal_id"],
        F.col("legal_id").alias("old_legal_id"),
        F.when(F.col("m") + F.col("fix_rank") <= 999999999,
               F.lpad((F.col("m") + F.col("fix_rank")).cast("string"), 9, "0")).alias("legal_id"),
        ((F.col("m") + F.col("fix_rank")) > 999999999).alias("key_overflow"))
    good = ranked.filter(~bad).select(*[c for c in person.columns],
                                      F.col("legal_id").alias("old_legal_id"),
                                      F.lit(False).alias("key_overflow"))
    out = good.unionByName(fixed)
    return out.withColumn("id_type", F.lit("SIN"))


def repair_rejects(repaired: DataFrame) -> DataFrame:
    """Rows of ``repair_keys`` for which no nine-digit id was left."""
    return repaired.filter("key_overflow")


def populate_issues(room: DataFrame) -> DataFrame:
    """Among rooms without issues (NULL or blank), ranked by room id,
    every 5th gets an issue text chosen by rank % 4.  Returns the picked rooms."""
    cand = global_rank(room.filter(blank_as_null("issues").isNull()).select("room_id"),
                       ["room_id"], "rn")
    texts = F.array(*[F.lit(t) for t in ISSUE_TEXTS])
    return cand.filter(F.col("rn") % 5 == 0).select(
        "room_id", "rn", F.element_at(texts, (F.col("rn") % 4 + 1).cast("int")).alias("issues"))


def attribute_customer_hotel(T) -> DataFrame:
    """Customers without a hotel get the smallest hotel id among
    their bookings' rooms, else among their rentings' rooms."""
    rooms = T["room"].select("room_id", "hotel_id")
    bh = T["booking"].join(rooms, "room_id").groupBy("customer_id") \
        .agg(F.min("hotel_id").alias("booking_hotel"))
    rh = T["renting"].join(rooms, "room_id").groupBy("customer_id") \
        .agg(F.min("hotel_id").alias("renting_hotel"))
    both = bh.join(rh, "customer_id", "full_outer")
    return (T["customer"].filter(F.col("hotel_id").isNull()).select("customer_id")
            .join(both, "customer_id", "left")
            .select("customer_id", F.coalesce("booking_hotel", "renting_hotel").alias("hotel_id")))


# Legacy room column -> current column.
LEGACY_ROOM_COLUMNS = {"hotel_room_id": "hotel_id", "room_capacity": "capacity", "price": "base_price",
                       "status": "current_status", "extendable": "is_extendable", "problems": "issues"}


def legacy_rooms(part: DataFrame) -> DataFrame:
    """Driver-derived room rows in the mixed old/new layout (J11 input):
    current columns are NULL on some rows, legacy columns carry values, and
    a ``view`` code is set on some rows."""
    k, s = F.col("p_partkey"), F.col("p_size")
    cap = F.when(s % 4 == 0, "single").when(s % 4 == 1, "double").when(s % 4 == 2, "suite").otherwise("family")
    view = F.when(s % 11 == 0, "sea").when(s % 11 == 1, "sea_mountain").when(s % 11 == 2, "mountain")
    return part.select(
        k.alias("room_id"),
        F.when(s % 10 != 0, k % 25).alias("hotel_id"), (k % 25).alias("hotel_room_id"),
        F.when(s % 7 != 0, cap).alias("capacity"), cap.alias("room_capacity"),
        F.when(s % 8 != 0, F.col("p_retailprice").cast("decimal(10,2)")).alias("base_price"),
        F.col("p_retailprice").cast("decimal(10,2)").alias("price"),
        F.when(s % 6 != 0, F.lit("available")).alias("current_status"),
        F.when(s == 13, "maintenance").otherwise("available").alias("status"),
        F.when(s % 5 != 0, k % 2 == 0).alias("is_extendable"), (s % 2 == 0).alias("extendable"),
        F.lit(None).cast("string").alias("issues"), F.when(s % 9 == 0, F.col("p_name")).alias("problems"),
        (s % 4 == 0).alias("has_sea_view"), (s % 3 == 0).alias("has_mountain_view"), view.alias("view"))


def coalesce_legacy_columns(room: DataFrame) -> DataFrame:
    """Fold legacy columns into the current ones, driven by
    ``df.columns``.  A current value wins, else the legacy value; a
    non-NULL legacy ``view`` code sets both view flags; legacy columns are
    dropped.  Columns that are absent are left alone."""
    cols = set(room.columns)
    out = room
    for legacy, new in LEGACY_ROOM_COLUMNS.items():
        if legacy in cols and new in cols:
            out = out.withColumn(new, F.coalesce(F.col(new), F.col(legacy)))
    if "view" in cols:
        sea, mountain = view_flags("view")
        has_view = F.col("view").isNotNull()
        out = out.withColumn("has_sea_view", F.when(has_view, sea).otherwise(F.col("has_sea_view"))) \
                 .withColumn("has_mountain_view", F.when(has_view, mountain).otherwise(F.col("has_mountain_view")))
    return out.drop(*[c for c in [*LEGACY_ROOM_COLUMNS, "view"] if c in cols])


def fill_rooms(T, min_rooms: int = 5) -> DataFrame:
    """J13 (rooms): hotels with fewer than ``min_rooms`` rooms get new rooms
    numbered with the first unused numbers from 100.  Slot ``i`` (existing
    count + k - 1) picks the capacity cycle and price 95 + 2*hotel + 12*i.

    Candidates per hotel are ``100 .. 100 + used + need - 1``, which always
    hold at least ``need`` free numbers; explosion is bounded by that.
    """
    rooms = T["room"].select("hotel_id", "room_number")
    used = rooms.groupBy("hotel_id").agg(F.count(F.lit(1)).alias("used"))
    need = T["hotel"].select("hotel_id").join(used, "hotel_id", "left") \
        .select("hotel_id", F.coalesce("used", F.lit(0)).alias("used")) \
        .withColumn("need", F.lit(min_rooms) - F.col("used")).filter(F.col("need") > 0)
    cand = need.select("hotel_id", "used", "need", F.explode(F.sequence(
        F.lit(FIRST_ROOM_NUMBER), F.lit(FIRST_ROOM_NUMBER) + F.col("used") + F.col("need") - 1))
        .alias("num")).withColumn("room_number", F.col("num").cast("string"))
    free = cand.join(rooms, ["hotel_id", "room_number"], "left_anti")
    picked = rank_within_groups(free, ["hotel_id"], ["num"], "k").filter(F.col("k") <= F.col("need"))
    slot = F.col("used") + F.col("k") - 1
    caps = F.array(*[F.lit(c) for c in CAPACITY_CYCLE])
    cap = F.element_at(caps, (slot % 5 + 1).cast("int"))
    return picked.select(
        "hotel_id", "room_number", slot.alias("slot"), cap.alias("capacity"),
        (F.lit(95) + F.col("hotel_id") * 2 + slot * 12).cast("decimal(10,2)").alias("base_price"),
        F.lit(False).alias("has_sea_view"), F.lit(False).alias("has_mountain_view"),
        cap.isin("double", "family").alias("is_extendable"), F.lit(NEW_ROOM_AMENITIES).alias("amenities"),
        F.lit(None).cast("string").alias("issues"), F.lit("available").alias("current_status"))


def fill_staff(T, as_of) -> DataFrame:
    """J13 (staff): hotels without a manager get one, hotels without a
    non-manager employee get one.  New staff are numbered in (hotel id,
    manager first) order: employee id = current maximum + rank, legal id =
    largest valid SIN + rank; the person fields follow fixed patterns."""
    e = T["employee"].groupBy("hotel_id").agg(
        F.count_if(F.col("is_manager")).alias("m"), F.count_if(~F.col("is_manager")).alias("n"))
    h = T["hotel"].select("hotel_id").join(e, "hotel_id", "left")
    mgr = h.filter(F.coalesce("m", F.lit(0)) == 0).select("hotel_id", F.lit(True).alias("is_manager"))
    emp = h.filter(F.coalesce("n", F.lit(0)) == 0).select("hotel_id", F.lit(False).alias("is_manager"))
    new = mgr.unionByName(emp)
    mx = T["employee"].agg(F.coalesce(F.max("employee_id"), F.lit(0))).scalar()
    max_sin = T["person"].filter(F.col("legal_id").rlike(SIN_RE)).agg(
        F.coalesce(F.max(F.col("legal_id").cast("bigint")), F.lit(DEFAULT_MAX_SIN))).scalar()
    ranked = global_rank(new.withColumn("_o", F.when(F.col("is_manager"), 0).otherwise(1)),
                         ["hotel_id", "_o"], "rk")
    sin = max_sin + F.col("rk")
    # past nine digits there is no id: the row is a reject without one
    sin_txt = F.when(sin <= 999999999, F.lpad(sin.cast("string"), 9, "0"))
    mgr_c = F.col("is_manager")
    hid = F.col("hotel_id").cast("string")
    phone = (F.lit(2000000000) + sin % 7000000000).cast("string")
    return ranked.select(
        (mx + F.col("rk")).alias("employee_id"), "hotel_id", "is_manager",
        F.when(mgr_c, STAFF_TITLES[0]).otherwise(STAFF_TITLES[1]).alias("role_title"),
        sin_txt.alias("legal_id"),
        F.when(mgr_c, NEW_STAFF_FIRST[0]).otherwise(NEW_STAFF_FIRST[1]).alias("first_name"),
        F.concat(F.when(mgr_c, NEW_STAFF_LAST[0]).otherwise(NEW_STAFF_LAST[1]), hid).alias("last_name"),
        F.concat(F.when(mgr_c, "manager").otherwise("employee"), F.lit(".hotel"), hid, F.lit("."), sin_txt,
                 F.lit(NEW_STAFF_MAIL)).alias("email"),
        F.substring(phone, -10, 10).alias("phone"),
        F.concat((F.col("hotel_id") + 300).cast("string"), F.lit(NEW_STAFF_STREET)).alias("address_line"),
        as_date(as_of).alias("hired_on"))


def missing_accounts(T) -> DataFrame:
    """Accounts to create for staff and customers without one,
    plus one administrator when none exists (no credentials)."""
    acc = T["auth_account"]
    e = T["employee"].join(acc.filter(F.col("employee_id").isNotNull()).select("employee_id"),
                           "employee_id", "left_anti")
    role = F.when(F.col("is_manager"), "manager").otherwise("employee")
    staff = e.select(role.alias("role"), F.concat(role, F.col("employee_id").cast("string")).alias("username"),
                     "employee_id", F.lit(None).cast("bigint").alias("customer_id"))
    c = T["customer"].join(acc.filter(F.col("customer_id").isNotNull()).select("customer_id"),
                           "customer_id", "left_anti")
    custs = c.select(F.lit("customer").alias("role"),
                     F.concat(F.lit("customer"), F.col("customer_id").cast("string")).alias("username"),
                     F.lit(None).cast("bigint").alias("employee_id"), "customer_id")
    has_admin = acc.filter(F.col("role") == "admin").agg(F.count(F.lit(1)).alias("n"))
    admin = has_admin.filter("n = 0").select(
        F.lit("admin").alias("role"), F.lit("admin").alias("username"),
        F.lit(None).cast("bigint").alias("employee_id"), F.lit(None).cast("bigint").alias("customer_id"))
    return staff.unionByName(custs).unionByName(admin).withColumn("is_active", F.lit(True))



class MigrationIncomplete(RuntimeError):
    pass


def migrate_fk(child: DataFrame, person: DataFrame, old_key: str = "person_id",
               new_key: str = "legal_id", check: bool = True) -> DataFrame:
    """Replace a legacy ``person_id`` reference by ``legal_id``.

    The precheck counts rows whose reference does not resolve (one
    aggregate); any such row fails the migration instead of leaving NULLs.
    """
    mapping = person.select(F.col(old_key), F.col(new_key).alias("_new"))
    j = child.join(mapping, old_key, "left")
    if new_key in child.columns:  # keep values already migrated, fill the rest
        j = j.withColumn("_new", F.coalesce(F.col(new_key), F.col("_new"))).drop(new_key)
    if check:
        missing = j.agg(F.count_if(F.col("_new").isNull()).alias("n")).first()["n"]
        if missing:
            raise MigrationIncomplete(f"{missing} rows without a {new_key}")
    return j.drop(old_key).withColumnRenamed("_new", new_key)
