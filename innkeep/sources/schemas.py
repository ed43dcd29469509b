"""A1: domain table schemas, enums, keys and the foreign-key graph.

Ids are ``bigint`` (driver keys are BIGINT and outgrow INT at scale).
"""

from __future__ import annotations

from pyspark.sql import types as T

# Timestamps are TIMESTAMP_NTZ (wall-clock, like the driver data and the
# reference's TIMESTAMP without time zone): results do not depend on the
# session time zone.
L, I, S, D, TS, B = (T.LongType(), T.IntegerType(), T.StringType(), T.DateType(),
                     T.TimestampNTZType(), T.BooleanType())
MONEY = T.DecimalType(10, 2)


def _st(*fields):
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SCHEMAS: dict[str, T.StructType] = {
    "hotel_chain": _st(("chain_id", L, False), ("chain_name", S, False),
                       ("central_office_address", S, True), ("contact_email", S, True),
                       ("contact_phone", S, True), ("created_at", TS, True)),
    "hotel": _st(("hotel_id", L, False), ("chain_id", L, False), ("hotel_name", S, False),
                 ("category", T.ShortType(), False), ("total_rooms", I, False),
                 ("address_line", S, False), ("contact_email", S, True),
                 ("contact_phone", S, True), ("created_at", TS, True)),
    "person": _st(("legal_id", S, False), ("id_type", S, False), ("first_name", S, False),
                  ("last_name", S, False), ("email", S, True), ("phone", S, True),
                  ("address_line", S, True)),
    "customer": _st(("customer_id", L, False), ("legal_id", S, False), ("hotel_id", L, True),
                    ("registration_date", D, True)),
    "employee": _st(("employee_id", L, False), ("legal_id", S, False), ("hotel_id", L, False),
                    ("role_title", S, False), ("hired_on", D, True), ("is_manager", B, False)),
    "auth_account": _st(("account_id", L, False), ("role", S, False), ("username", S, False),
                        ("employee_id", L, True), ("customer_id", L, True),
                        ("is_active", B, False), ("created_at", TS, True)),
    "room": _st(("room_id", L, False), ("hotel_id", L, False), ("room_number", S, False),
                ("capacity", S, False), ("base_price", MONEY, False),
                ("has_sea_view", B, False), ("has_mountain_view", B, False),
                ("is_extendable", B, False), ("amenities", S, True), ("issues", S, True),
                ("current_status", S, False)),
    "booking": _st(("booking_id", L, False), ("room_id", L, False), ("customer_id", L, False),
                   ("created_by_employee_id", L, True), ("start_date", D, False),
                   ("end_date", D, False), ("status", S, False), ("created_at", TS, True)),
    "renting": _st(("renting_id", L, False), ("room_id", L, False), ("customer_id", L, False),
                   ("employee_id", L, False), ("source_booking_id", L, True),
                   ("start_date", D, False), ("end_date", D, False), ("status", S, False),
                   ("created_at", TS, True)),
    "archive": _st(("archive_id", L, True), ("record_type", S, False),
                   ("source_booking_id", L, True), ("source_renting_id", L, True),
                   ("chain_name", S, True), ("hotel_name", S, True), ("room_number", S, True),
                   ("customer_full_name", S, True), ("customer_legal_id", S, True),
                   ("start_date", D, True), ("end_date", D, True), ("final_status", S, True),
                   ("archived_at", TS, True)),
    "payment": _st(("payment_id", L, True), ("renting_id", L, False), ("employee_id", L, False),
                   ("amount", T.DecimalType(12, 2), False), ("method", S, False),
                   ("paid_at", TS, True)),
}

# Fixed values of the data model (enumerations and status sets).
ENUMS = {
    ("room", "capacity"): ["single", "double", "suite", "family", "other"],
    ("room", "current_status"): ["available", "booked", "rented", "maintenance"],
    ("booking", "status"): ["reserved", "checked_in", "cancelled", "completed"],
    ("renting", "status"): ["active", "completed", "cancelled"],
    ("payment", "method"): ["cash", "credit", "debit", "online"],
    ("auth_account", "role"): ["admin", "manager", "employee", "customer"],
    ("archive", "record_type"): ["booking", "renting"],
}
BLOCKING_BOOKING = ["reserved", "checked_in"]
BLOCKING_RENTING = ["active"]
FINAL_STATUSES = ["completed", "cancelled"]

PRIMARY_KEYS = {
    "hotel_chain": ["chain_id"], "hotel": ["hotel_id"], "person": ["legal_id"],
    "customer": ["customer_id"], "employee": ["employee_id"], "auth_account": ["account_id"],
    "room": ["room_id"], "booking": ["booking_id"], "renting": ["renting_id"],
    "archive": ["archive_id"], "payment": ["payment_id"],
}

UNIQUE_KEYS = {
    "hotel_chain": [["chain_name"]],
    "hotel": [["chain_id", "hotel_name"]],
    "person": [["email"]],
    "customer": [["legal_id"]],
    "employee": [["legal_id"]],
    "auth_account": [["username"], ["employee_id"], ["customer_id"]],
    "room": [["hotel_id", "room_number"]],
}

# (child, child column, parent, parent column, on-delete action)
FOREIGN_KEYS = [
    ("hotel", "chain_id", "hotel_chain", "chain_id", "cascade"),
    ("customer", "legal_id", "person", "legal_id", "cascade"),
    ("customer", "hotel_id", "hotel", "hotel_id", "set_null"),
    ("employee", "legal_id", "person", "legal_id", "cascade"),
    ("employee", "hotel_id", "hotel", "hotel_id", "cascade"),
    ("auth_account", "employee_id", "employee", "employee_id", "cascade"),
    ("auth_account", "customer_id", "customer", "customer_id", "cascade"),
    ("room", "hotel_id", "hotel", "hotel_id", "cascade"),
    ("booking", "room_id", "room", "room_id", "cascade"),
    ("booking", "customer_id", "customer", "customer_id", "cascade"),
    ("booking", "created_by_employee_id", "employee", "employee_id", "set_null"),
    ("renting", "room_id", "room", "room_id", "cascade"),
    ("renting", "customer_id", "customer", "customer_id", "cascade"),
    ("renting", "employee_id", "employee", "employee_id", "restrict"),
    ("renting", "source_booking_id", "booking", "booking_id", "set_null"),
    ("archive", "source_booking_id", "booking", "booking_id", "set_null"),
    ("archive", "source_renting_id", "renting", "renting_id", "set_null"),
    ("payment", "renting_id", "renting", "renting_id", "cascade"),
    ("payment", "employee_id", "employee", "employee_id", "restrict"),
]


def conform(df, table: str):
    """Select and cast ``df`` to the declared schema of ``table``."""
    from pyspark.sql import functions as F
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name)
                      for f in SCHEMAS[table].fields])
