"""Occupancy bitmaps against sets of days."""

import datetime as dt
import random

import pytest

from innkeep.operators import bitmaps

D0 = dt.date(2026, 3, 1)


@pytest.mark.parametrize("days", [1, 63, 64, 65, 221])
def test_bits_equal_sets(spark, days):
    rng = random.Random(days)
    day = lambda k: D0 + dt.timedelta(k)
    blocks = [(rng.randrange(5), day(a), day(a + rng.choice([0, 1, 3, 64, 130, 400]))) for a in (rng.randrange(-80, days + 9) for _ in range(14))]
    blocks += [(6, day(-5), day(days + 5)), (7, day(63), day(65)), (8, day(0), day(0))]
    taken = {r: set() for r in range(10)}
    for r, a, b in blocks:
        taken[r] |= {k for k in range(days) if a <= day(k) < b}
    rooms = spark.range(10).withColumnRenamed("id", "room_id")
    stored = bitmaps.occupancy(spark.createDataFrame(blocks, "room_id long, start_date date, end_date date"), D0, days)
    words = bitmaps.for_all(rooms, stored, days).checkpoint()
    pairs = lambda df: sorted(map(tuple, df.collect()))
    assert pairs(bitmaps.days_of(words, D0, days)) == sorted((r, day(k)) for r in taken for k in taken[r])
    assert pairs(bitmaps.days_of(words, D0, days, occupied=False)) == sorted((r, day(k)) for r in taken for k in range(days) if k not in taken[r])
    runs = []
    for r in taken:
        open_ = [k for k in range(days) if k not in taken[r]]
        starts = [k for k in open_ if k - 1 not in open_]
        runs += [(r, day(a), day(next(k for k in range(a, days + 1) if k not in open_))) for a in starts]
    assert pairs(bitmaps.free_ranges(words, D0, days)) == sorted(runs)
    a, b = sorted(rng.sample(range(days + 1), 2))
    free = words.filter(bitmaps.is_free(words["words"], a, b))
    assert {r.room_id for r in free.collect()} == {r for r in taken if not taken[r] & set(range(a, b))}
