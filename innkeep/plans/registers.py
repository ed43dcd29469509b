"""The registers of customers, employees, hotels and rooms, written in order.

A change is one row: change_id, ord, op ('insert' | 'update') and the fields it sets (null: left
as it is).  It writes all of its tables or none: a customer is a person, a customer row and an
account.  ``decide_writes`` decides the changes one after another under the unique values; fields
are checked first by the intake rules, in the order the reference's forms check them.  The
functions return the decisions and the new versions of the tables, of which only rows
with an accepted change differ.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.functions import intake
from innkeep.operators.rank import global_rank
from innkeep.operators.unit_writes import EXISTS, NOT_FOUND, OUT_OF_SCOPE, decide_writes
from innkeep.sources.schemas import ENUMS

PERSON = ["first_name", "last_name", "email", "phone", "address_line"]
TURN = F.struct


@dataclass
class Written:
    """Decisions (change_id, id, accepted, reason) and new table versions by name."""
    decided: DataFrame
    tables: dict[str, DataFrame]


def _checked(changes: DataFrame, rules: dict, required: dict[str, list[str]]) -> DataFrame:
    """Fields cleaned by their rules, and ``reason``: the first field that fails.  ``required``:
    per operation the fields that must be given; others may be null."""
    changes = changes.repartition("change_id")  # the rules cost more than the scan, whose tasks may be few
    clean, reason = {}, None
    for name, (rule, *args) in rules.items():
        value, why = getattr(intake, f"rule_{rule}")(F.col(name).cast("string"), *args)
        must = F.lit(False)
        for op, names in required.items():
            if name in names:
                must = must | (F.col("op") == op)
        given = F.col(name).isNotNull()
        fails = F.when(must | given, why)
        reason = fails if reason is None else F.coalesce(reason, fails)
        clean[name] = F.when(given, value)
    return changes.withColumn("reason", reason).withColumns(clean)


def _with_ids(changes: DataFrame, key: str, current: DataFrame) -> DataFrame:
    """Inserts get ids after the current maximum in (ord, change_id) order, as a sequence deals them."""
    top = current.agg(F.coalesce(F.max(key), F.lit(0))).scalar()
    new = global_rank(changes.filter("op = 'insert'").select("change_id", "ord"), ["ord", "change_id"], "_rk")
    return changes.join(new.select("change_id", "_rk"), "change_id", "left") \
        .withColumn(key, F.when(F.col("op") == "insert", top + F.col("_rk")).otherwise(F.col(key))).drop("_rk").checkpoint(eager=True)


def _decide(changes: DataFrame, entities: DataFrame, held: DataFrame, sets: dict[str, Column], prefix: str, key: str, scope, new_home,
            extra_reason: Column | None = None) -> DataFrame:
    """changes with ``accepted`` and ``reason``; ``sets``: name of the rule to (applies, value)."""
    changes = changes.withColumn("entity", F.concat(F.lit(prefix), F.col(key).cast("string")))
    valid = changes.filter("reason is null")
    names = list(sets)
    wanted = valid.select("change_id", F.explode(F.array(*[
        F.struct(F.lit(i).alias("uq"), applies.alias("applies"), value.cast("string").alias("value"))
        for i, (applies, value) in enumerate(sets.values())])).alias("s")).select("change_id", "s.*").filter("applies").drop("applies")
    done = decide_writes(entities, held, valid.select("change_id", "ord", "entity", "op", scope.cast("string").alias("scope"),
                                                      new_home.cast("string").alias("new_home")), wanted)
    why = F.when(F.col("code") == EXISTS, "exists").when(F.col("code") == NOT_FOUND, "not_found") \
        .when(F.col("code") == OUT_OF_SCOPE, "out_of_scope").when(F.col("code").isNotNull(), F.get(F.array(*[F.lit(n) for n in names]), F.col("code")))
    out = changes.join(done.select("change_id", "accepted", why.alias("_why")), "change_id", "left")
    return out.withColumn("reason", F.coalesce("reason", "_why")).withColumn("accepted", F.coalesce("accepted", F.lit(False))) \
        .drop("_why", "entity").checkpoint(eager=True)


def _folded(changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Per entity the last value that an accepted change gave each field."""
    turn = F.struct("ord", "change_id")
    return changes.filter("accepted").groupBy(key).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), turn)).alias(f"_{c}") for c in fields])


def _merged(current: DataFrame, folded: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows of ``current`` under the folded changes, and the rows that are new."""
    joined = current.join(folded, key, "full_outer")
    return joined.select(key, *[F.coalesce(F.col(f"_{c}").cast(current.schema[c].dataType), F.col(c)).alias(c) if c in fields else F.col(c)
                                for c in current.columns if c != key])


def _replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with their key."""
    names = [c for c in old.columns if c in new.columns]
    kept = old.join(new.select(key), key, "left_anti")
    return kept.unionByName(new.select(*[F.col(c).cast(old.schema[c].dataType).alias(c) for c in names]), allowMissingColumns=True).select(*old.columns)


def _holders(T) -> DataFrame:
    """Who holds legal ids, e-mails and user names: (entity, legal_id, email), (entity, username)."""
    c = T["customer"].select(F.concat(F.lit("c:"), F.col("customer_id").cast("string")).alias("_c"), "legal_id")
    e = T["employee"].select(F.concat(F.lit("e:"), F.col("employee_id").cast("string")).alias("_e"), "legal_id")
    people = T["person"].join(c, "legal_id", "left").join(e, "legal_id", "left").select(
        F.coalesce("_c", "_e", F.concat(F.lit("p:"), "legal_id")).alias("entity"), "legal_id", "email")
    a = T["auth_account"]
    accounts = a.select(F.coalesce(F.concat(F.lit("c:"), a.customer_id.cast("string")), F.concat(F.lit("e:"), a.employee_id.cast("string")),
                                   F.concat(F.lit("a:"), a.account_id.cast("string"))).alias("entity"), "username")
    return people, accounts


def _held(parts: list[tuple[DataFrame, str, int]]) -> DataFrame:
    out = None
    for df, column, uq in parts:
        one = df.select("entity", F.lit(uq).alias("uq"), F.col(column).cast("string").alias("value")).filter("value is not null")
        out = one if out is None else out.unionByName(one)
    return out


def _people_tables(T, before: DataFrame, after: DataFrame, own: str, key: str, fields: list[str], roles: Column) -> dict[str, DataFrame]:
    """New versions of person, ``own`` and auth_account from the wide rows that changed."""
    new_accounts = after.join(before.select(key), key, "left_anti")
    top = T["auth_account"].agg(F.coalesce(F.max("account_id"), F.lit(0))).scalar()
    dealt = global_rank(new_accounts, [key], "_rk").withColumn("account_id", top + F.col("_rk")).withColumn("is_active", F.lit(True)).drop("_rk")
    accounts = after.join(before.select(key), key, "left_semi").filter("account_id is not null").unionByName(dealt).withColumn("role", roles)
    return {"person": _replaced(T["person"], after.withColumn("id_type", F.lit("SIN")), "legal_id"),
            own: _replaced(T[own], after.select(key, *fields), key),
            "auth_account": _replaced(T["auth_account"], accounts, "account_id")}


def _wide(T, own: str, key: str) -> DataFrame:
    acc = T["auth_account"].filter(F.col(key).isNotNull()).select(key, "account_id", "username", "is_active", F.col("role").alias("account_role"))
    return T[own].join(T["person"].select("legal_id", *PERSON), "legal_id").join(acc, key, "left")


def write_customers(T, changes: DataFrame) -> Written:
    """Customers with their person and account; fields: customer_id (of updates), scope_hotel (of
    staff, null: administrators), legal_id, hotel_id, registration_date, username and the person's.
    New customers without a user name are ``customer<id>``; staff update customers of their hotel only."""
    rules = {"legal_id": ("sin",), "first_name": ("string", 80), "last_name": ("string", 80), "email": ("email",), "phone": ("phone",),
             "address_line": ("string", 255), "registration_date": ("date",), "username": ("username",)}
    basic = [*PERSON, "registration_date"]
    ch = _with_ids(_checked(changes, rules, {"insert": ["legal_id", *basic], "update": basic}), "customer_id", T["customer"])
    insert = F.col("op") == "insert"
    ch = ch.withColumn("username", F.when(insert & F.col("username").isNull(), F.concat(F.lit("customer"), F.col("customer_id").cast("string")))
                       .otherwise(F.col("username"))).withColumn("hotel_id", F.when(insert, F.col("scope_hotel")))
    people, accounts = _holders(T)
    entities = T["customer"].select(F.concat(F.lit("c:"), F.col("customer_id").cast("string")).alias("entity"), F.col("hotel_id").cast("string").alias("home"))
    sets = {"taken_legal_id": (insert, F.col("legal_id")), "taken_email": (F.lit(True), F.col("email")),
            "taken_username": (F.col("username").isNotNull(), F.col("username"))}
    held = _held([(people, "legal_id", 0), (people, "email", 1), (accounts, "username", 2)])
    ch = _decide(ch, entities, held, sets, "c:", "customer_id", F.when(~insert, F.col("scope_hotel")), F.when(insert, F.col("hotel_id")))
    fields = ["legal_id", "hotel_id", *basic, "username"]
    folded = _folded(ch, "customer_id", fields)
    before = _wide(T, "customer", "customer_id").join(folded.select("customer_id"), "customer_id", "left_semi").checkpoint(eager=True)
    after = _merged(before, folded, "customer_id", fields).checkpoint(eager=True)
    tables = _people_tables(T, before, after, "customer", "customer_id", ["legal_id", "hotel_id", "registration_date"], F.lit("customer"))
    return Written(ch.select("change_id", F.col("customer_id").alias("id"), "accepted", "reason"), tables)


def write_employees(T, changes: DataFrame) -> Written:
    """Employees with their person and account; fields: employee_id (of updates), scope_hotel (of
    managers, null: administrators), legal_id, hotel_id, role_title, hired_on, account_role,
    username and the person's.  A hotel has one manager; managers create and update
    accounts of role 'employee' at their own hotel only."""
    rules = {"legal_id": ("sin",), "first_name": ("string", 80), "last_name": ("string", 80), "email": ("email",), "phone": ("phone",),
             "address_line": ("string", 255), "hotel_id": ("int", 1), "role_title": ("string", 80), "hired_on": ("date",),
             "username": ("username",), "account_role": ("enum", ["manager", "employee"])}
    scoped = F.col("scope_hotel").isNotNull()
    ch = changes.withColumn("hotel_id", F.when(scoped, F.col("scope_hotel")).otherwise(F.col("hotel_id"))) \
        .withColumn("account_role", F.when(scoped, F.lit("employee")).otherwise(F.col("account_role")))
    basic = [*PERSON, "hotel_id", "role_title", "hired_on", "username", "account_role"]
    ch = _checked(ch, rules, {"insert": ["legal_id", *basic], "update": basic})
    known = T["hotel"].select("hotel_id", F.lit(True).alias("_known"))
    ch = ch.join(known, "hotel_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("_known").isNull(), "no_such_hotel"))).drop("_known")
    ch = _with_ids(ch, "employee_id", T["employee"])
    people, accounts = _holders(T)
    insert = F.col("op") == "insert"
    wide = _wide(T, "employee", "employee_id")
    named = F.concat(F.lit("e:"), F.col("employee_id").cast("string")).alias("entity")
    home = lambda role: F.concat_ws(":", F.col("hotel_id").cast("string"), role)
    entities = wide.select(named, home(F.col("account_role")).alias("home"))
    managers = T["employee"].filter("is_manager").select(named, "hotel_id")
    sets = {"second_manager": (F.lit(True), F.when(F.col("account_role") == "manager", F.col("hotel_id"))), "taken_legal_id": (insert, F.col("legal_id")),
            "taken_email": (F.lit(True), F.col("email")), "taken_username": (F.lit(True), F.col("username"))}
    held = _held([(managers, "hotel_id", 0), (people, "legal_id", 1), (people, "email", 2), (accounts, "username", 3)])
    ch = _decide(ch, entities, held, sets, "e:", "employee_id",
                 F.when(~insert & F.col("scope_hotel").isNotNull(), F.concat(F.col("scope_hotel").cast("string"), F.lit(":employee"))),
                 home(F.col("account_role")))
    ch = ch.withColumn("is_manager", F.col("account_role") == "manager")
    fields = ["legal_id", *basic, "is_manager"]
    folded = _folded(ch, "employee_id", fields)
    before = wide.join(folded.select("employee_id"), "employee_id", "left_semi").checkpoint(eager=True)
    after = _merged(before, folded, "employee_id", fields).checkpoint(eager=True)
    tables = _people_tables(T, before.filter("account_id is not null"), after, "employee", "employee_id",
                            ["legal_id", "hotel_id", "role_title", "hired_on", "is_manager"], F.col("account_role"))
    return Written(ch.select("change_id", F.col("employee_id").alias("id"), "accepted", "reason"), tables)


def _write_one(T, table: str, key: str, changes: DataFrame, rules: dict, required: list[str], parent: tuple[str, str, str],
               unique: tuple[str, list[str]]) -> Written:
    """A register of one table with a parent and one unique key."""
    ch = _checked(changes, rules, {"insert": required, "update": required})
    ptable, pkey, missing = parent
    ch = ch.join(T[ptable].select(pkey, F.lit(True).alias("_known")), pkey, "left")
    ch = _with_ids(ch.withColumn("reason", F.coalesce("reason", F.when(F.col("_known").isNull(), missing))).drop("_known"), key, T[table])
    named = F.concat(F.lit("x:"), F.col(key).cast("string")).alias("entity")
    value = F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in unique[1]]))
    stored = T[table].select(named, value.alias("value"))
    ch = _decide(ch, stored.select("entity", F.lit(None).cast("string").alias("home")), _held([(stored, "value", 0)]),
                 {unique[0]: (F.lit(True), value)}, "x:", key, F.lit(None), F.lit(None))
    fields = [c for c in changes.columns if c in T[table].columns and c != key]
    folded = _folded(ch, key, fields)
    before = T[table].join(folded.select(key), key, "left_semi")
    after = _merged(before, folded, key, fields).checkpoint(eager=True)
    return Written(ch.select("change_id", F.col(key).alias("id"), "accepted", "reason"), {table: _replaced(T[table], after, key)})


def write_hotels(T, changes: DataFrame) -> Written:
    """Hotels: chain_id, hotel_name (unique in its chain), category 1 to 5, total_rooms, address_line, contact_email, contact_phone."""
    rules = {"chain_id": ("int", 0), "hotel_name": ("string", 140), "category": ("int", 1), "total_rooms": ("int", 1),
             "address_line": ("string", 255), "contact_email": ("email",), "contact_phone": ("phone",)}
    ranged = changes.withColumn("category", F.when(F.col("category").cast("string").rlike("^[1-5]$"), F.col("category").cast("string")).otherwise(""))
    return _write_one(T, "hotel", "hotel_id", ranged, rules, list(rules), ("hotel_chain", "chain_id", "no_such_chain"),
                      ("taken_name", ["chain_id", "hotel_name"]))


def write_rooms(T, changes: DataFrame) -> Written:
    """Rooms: hotel_id, room_number (unique in its hotel), capacity, base_price, views, amenities, issues, current_status."""
    sizes = [c for c in ENUMS["room", "capacity"] if c != "other"]
    rules = {"hotel_id": ("int", 0), "room_number": ("string", 10), "capacity": ("enum", sizes), "base_price": ("number", 0.01),
             "amenities": ("string", 4000), "issues": ("string", 4000, False), "current_status": ("enum", ENUMS["room", "current_status"])}
    must = [c for c in rules if c != "issues"]
    return _write_one(T, "room", "room_id", changes, rules, must, ("hotel", "hotel_id", "no_such_hotel"), ("taken_number", ["hotel_id", "room_number"]))
