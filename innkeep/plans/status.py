"""Room status at a date.

rented (active renting covers the day) > booked (open booking covers the
day) > available; a stored ``maintenance`` status is never overwritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.functions.columns import covers
from innkeep.plans.common import active_rentings, open_bookings


def status_as_of(T, day, rooms: DataFrame | None = None) -> DataFrame:
    rooms = rooms if rooms is not None else T["room"]
    rented = active_rentings(T).filter(covers("start_date", "end_date", day)) \
        .select("room_id").distinct().withColumn("_rented", F.lit(True))
    booked = open_bookings(T).filter(covers("start_date", "end_date", day)) \
        .select("room_id").distinct().withColumn("_booked", F.lit(True))
    r = rooms.select("room_id", "current_status") \
        .join(rented, "room_id", "left").join(booked, "room_id", "left")
    status = F.when(F.col("current_status") == "maintenance", "maintenance") \
        .when(F.col("_rented"), "rented").when(F.col("_booked"), "booked").otherwise("available")
    return r.select("room_id", status.alias("status"))
