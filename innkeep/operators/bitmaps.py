"""Occupancy bitmaps (J25/J26): a room's days inside a horizon as bits of a few long words.

A block of days is a mask per word, worked out from its two ends; the masks of a room are joined
by ``bit_or``, which combines before the shuffle, so neither the nights of a stay nor the
stays of a busy room become rows.  Whether a room is free on some days, which days are open and
where the free stretches begin are bit operations on the words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.functions.columns import as_date

WORD = 64


def n_words(days: int) -> int:
    return -(-days // WORD)


def _below(n: Column) -> Column:
    """A word whose lowest ``n`` bits (0 to 64) are set."""
    all_set = F.lit(-1).cast("bigint")
    return F.when(n >= WORD, all_set).otherwise(F.bitwise_not(F.call_function("shiftleft", all_set, n)))


def mask(first: Column, last: Column, word: int) -> Column:
    """Bits of the days first <= day < last that fall into the word (numbers of days; null: none)."""
    inside = lambda c: F.greatest(F.least(c - word * WORD, F.lit(WORD)), F.lit(0)).cast("int")
    bits = _below(inside(last)).bitwiseAND(F.bitwise_not(_below(inside(first))))
    return F.when(first < last, bits).otherwise(F.lit(0).cast("bigint"))


def occupancy(blocks: DataFrame, start, days: int, key: str = "room_id") -> DataFrame:
    """(key, words): bit d of the words is set where a block covers the day ``start`` + d, d < ``days``.
    Keys without a block inside the horizon have no row."""
    d0 = as_date(start)
    a = F.greatest(F.datediff("start_date", d0), F.lit(0))
    b = F.least(F.datediff("end_date", d0), F.lit(days))
    # both ends by themselves, so that far stays leave before they are joined or sorted
    starts, ends = F.col("start_date"), F.col("end_date")
    live = blocks.filter((starts.isNull() | (starts < F.date_add(d0, days))) & (ends.isNull() | (ends > d0)))
    near = live.select(key, a.alias("_a"), b.alias("_b")).filter(F.col("_a") < F.col("_b"))
    words = near.groupBy(key).agg(*[F.bit_or(mask(F.col("_a"), F.col("_b"), w)).alias(f"_w{w}") for w in range(n_words(days))])
    return words.select(key, F.array(*[F.col(f"_w{w}") for w in range(n_words(days))]).alias("words"))


def for_all(rooms: DataFrame, bitmaps: DataFrame, days: int, key: str = "room_id") -> DataFrame:
    """(key, words) of every row of ``rooms``; those without a block have no bit set."""
    empty = F.array(*[F.lit(0).cast("bigint")] * n_words(days))
    return rooms.select(key).join(bitmaps, key, "left").select(key, F.coalesce("words", empty).alias("words"))


def _bit(words: Column, day: Column) -> Column:
    return F.getbit(F.element_at(words, (F.floor(day / WORD) + 1).cast("int")), (day % WORD).cast("int"))


def days_of(bitmaps: DataFrame, start, days: int, occupied: bool = True, key: str = "room_id") -> DataFrame:
    """(key, day) of all days that are occupied, or open."""
    wanted = F.filter(F.sequence(F.lit(0), F.lit(days - 1)), lambda d: _bit(F.col("words"), d) == int(occupied))
    return bitmaps.select(key, F.explode(wanted).alias("_d")).select(key, F.date_add(as_date(start), F.col("_d")).alias("day"))


def is_free(words: Column, first: int, last: int) -> Column:
    """Whether no day first <= day < last is occupied."""
    hit = [F.element_at(words, w + 1).bitwiseAND(mask(F.lit(first), F.lit(last), w)) for w in range(n_words(last))]
    out = hit[0] == 0
    for h in hit[1:]:
        out = out & (h == 0)
    return out


def free_ranges(bitmaps: DataFrame, start, days: int, key: str = "room_id") -> DataFrame:
    """(key, free_from, free_to): the stretches of open days, half-open, inside the horizon."""
    d = as_date(start)
    every = F.sequence(F.lit(0), F.lit(days - 1))
    turned = lambda step: F.filter(every, lambda x: (_bit(F.col("words"), x) == 0) & (
        (x == (0 if step < 0 else days - 1)) | (_bit(F.col("words"), F.least(F.greatest(x + step, F.lit(0)), F.lit(days - 1))) == 1)))
    runs = bitmaps.select(key, turned(-1).alias("a"), turned(1).alias("b")).select(key, F.explode(F.arrays_zip("a", "b")).alias("r"))
    return runs.select(key, F.date_add(d, F.col("r.a")).alias("free_from"), F.date_add(d, F.col("r.b") + 1).alias("free_to"))
