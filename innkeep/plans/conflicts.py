"""Overlap rules between bookings and rentings (re-aimed triggers).

Rules, in the order a violation is reported (first one wins in J2):
  booking: room_booking, room_renting, customer_booking, customer_renting
  renting: room_renting, room_booking, customer_renting, customer_booking
A record never clashes with itself; on the renting side the booking it
was created from (``source_booking_id``) is ignored.  Only the booking
side has no such exception, so a checked-in booking with its own active
renting is reported once, as a booking violation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.operators.intervals import overlap_pairs
from innkeep.operators.sweep import sweep
from innkeep.plans.common import active_rentings, open_bookings

# Rule order per record type.
RULES = {
    "booking": ["room_booking", "room_renting", "customer_booking", "customer_renting"],
    "renting": ["room_renting", "room_booking", "customer_renting", "customer_booking"],
}


def booking_pairs(T, key: str) -> DataFrame:
    """Overlapping open-booking pairs sharing ``key`` (a < b)."""
    ob = open_bookings(T)
    return overlap_pairs(ob, ob, key, "booking_id", "booking_id", same_side=True)


def booking_renting_pairs(T, key: str = "room_id") -> DataFrame:
    """Open booking × active renting pairs sharing ``key``."""
    return overlap_pairs(open_bookings(T), active_rentings(T), key, "booking_id", "renting_id")


def _by_kind(stays: DataFrame, kinds) -> DataFrame:
    """A row per stay and kind of key (room, guest); rows without the key have none."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"{k}_id").cast("bigint").alias("key")) for k in kinds])
    return stays.select(*[c for c in stays.columns if c not in ("room_id", "customer_id")], F.explode(keys).alias("_k")) \
        .select("_k.*", *[c for c in stays.columns if c not in ("room_id", "customer_id")]).filter("key is not null")


def _stays(T, side: str) -> DataFrame:
    """Blocking stays of one side as rows of the sweep."""
    rows, sid = _side(T, side)
    return rows.select(F.lit(side).alias("side"), F.col(sid).cast("bigint").alias("id"), "room_id", "customer_id",
                       "start_date", "end_date", *(["source_booking_id"] if side == "renting" else []))


def conflict_flags(T) -> DataFrame:
    """Per open booking, whether it clashes (by room) with an active
    renting / another open booking.  One sweep over the stays of each room."""
    bookings, rentings = _stays(T, "booking"), _stays(T, "renting").drop("source_booking_id")
    rows = bookings.withColumn("probe", F.lit(True)).unionByName(rentings.withColumn("probe", F.lit(False)))
    hit = sweep(_by_kind(rows, ["room"]).withColumn("held", F.lit(True)), ["kind", "key"], ["booking", "renting"], {"booking": "id"})
    known = hit.select(F.col("id").alias("booking_id"), "hit_renting", "hit_booking")
    return open_bookings(T).select("booking_id").join(known, "booking_id", "left").select(
        "booking_id", F.coalesce("hit_renting", F.lit(False)).alias("has_renting_clash"),
        F.coalesce("hit_booking", F.lit(False)).alias("has_booking_clash"))


def _side(T, kind):
    if kind == "booking":
        return open_bookings(T), "booking_id"
    return active_rentings(T), "renting_id"


def _narrowed_to_candidates(T, candidates: dict | None):
    """With candidate rows, only stored stays inside the candidates' overall
    date range can clash.  The range (two values, one small aggregate) is
    applied as literal filters, so they reach the Parquet scan and prune
    row groups of date-clustered tables."""
    if not candidates:
        return T
    frames = [c.select("start_date", "end_date") for c in candidates.values()]
    allc = frames[0]
    for f in frames[1:]:
        allc = allc.unionByName(f)
    lo, hi = allc.agg(F.min("start_date"), F.max("end_date")).first()
    T = dict(T)
    for name in ("booking", "renting"):
        if lo is None:
            T[name] = T[name].filter(F.lit(False))
        else:
            T[name] = T[name].filter((F.col("start_date") < F.lit(hi)) & (F.col("end_date") > F.lit(lo)))
    return T


def find_conflicts(T, candidates: dict | None = None, sides=("booking", "renting")) -> DataFrame:
    """``(record_type, record_id, rule)`` for every rule a blocking
    record violates against the blocking records of ``T``.

    ``candidates`` optionally maps ``'booking'``/``'renting'`` to frames
    of new rows to test instead of the stored ones.  A candidate's id is
    ``record_id`` where it has that column; the stored row of its
    ``booking_id``/``renting_id`` is its own and ignored.  All rules come
    from one sweep over the stays of each room and of each guest.
    """
    if candidates:
        # candidates feed the date bounds and the join: compute them once
        candidates = {k: v.checkpoint(eager=True) for k, v in candidates.items()}
    T = _narrowed_to_candidates(T, candidates)
    kinds = ("room", "customer")
    no_id = F.lit(None).cast("bigint")
    rows = []
    for side in ("booking", "renting"):
        own, source = F.col("id"), (F.col("source_booking_id") if side == "renting" else None)
        skips = {"skip_booking": own if side == "booking" else source, "skip_renting": own if side == "renting" else no_id}
        asked = side in sides and not (candidates and side in candidates)
        rows.append(_stays(T, side).withColumns(skips).drop("source_booking_id").withColumns(
            {"record_id": own, "held": F.lit(True), "probe": F.lit(asked)}))
        if side in sides and candidates and side in candidates:
            new, sid = candidates[side], _side(T, side)[1]
            rid = F.col("record_id") if "record_id" in new.columns else F.col(sid)
            own = F.col(sid).cast("bigint")
            skips = {"skip_booking": own if side == "booking" else F.col("source_booking_id").cast("bigint"),
                     "skip_renting": own if side == "renting" else no_id}
            rows.append(new.select(F.lit(side).alias("side"), rid.cast("bigint").alias("id"), "room_id", "customer_id", "start_date", "end_date",
                                   *[v.alias(k) for k, v in skips.items()], rid.alias("record_id"), F.lit(False).alias("held"), F.lit(True).alias("probe")))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    swept = _by_kind(every, kinds)
    if candidates:  # rooms and guests that nobody asks for need no sweep
        swept = swept.checkpoint(eager=True)
        swept = swept.join(swept.filter("probe").select("kind", "key").distinct(), ["kind", "key"], "left_semi")
    hit = sweep(swept, ["kind", "key"], ["booking", "renting"], {s: f"skip_{s}" for s in ("booking", "renting")})
    rules = [F.when(F.col(f"hit_{s}"), F.concat("kind", F.lit(f"_{s}"))) for s in ("booking", "renting")]
    return (hit.select(F.col("side").alias("record_type"), "record_id", F.explode(F.array(*rules)).alias("rule"))
            .filter("rule is not null").distinct())


def first_violation(hits: DataFrame, side: str = "booking") -> DataFrame:
    """Reduce ``find_conflicts`` output to the first violated rule per record."""
    order = F.create_map(*[x for i, r in enumerate(RULES[side]) for x in (F.lit(r), F.lit(i))])
    return (hits.filter(F.col("record_type") == side)
                .groupBy("record_id")
                .agg(F.min(F.struct(order[F.col("rule")].alias("o"), F.col("rule").alias("r")))
                     .alias("m"))
                .select("record_id", F.col("m.r").alias("rule")))
