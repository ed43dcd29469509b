"""Clash tests by an interval sweep: one row per stay, hot keys cut into chunks.

Stays of a key are swept in the order of their starts.  Two half-open stays overlap exactly
where the later one starts before the earlier one ends, so a row clashes with an earlier row
if the latest end so far lies beyond its start, and with a later row if the next start lies
before its end.  One stay (its own, or the one it comes from) may be left out, so the two
latest ends and the two next starts of each side say all.

Rows are range-partitioned on key and start, so a hot key lies in several chunks.  What a
chunk needs of the others are the two latest ends before it and the two next starts after it:
they join it as rows of their own.  Only the first and the last key of a chunk can go on in
another one, so these rows are a few per chunk, and the driver adds them up.
"""

from __future__ import annotations

import datetime as _dt
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innkeep.operators.scan import CHUNK, chunked

_FIRST = _dt.date.min
_SEQ_LAST = (1 << 63) - 1


def _carried(placed: DataFrame, by: list[str]) -> list[tuple]:
    """(chunk, *key, start, end, side, id, seq): rows that stand in a chunk for those before and after."""
    key = F.struct(*by)
    chunks_of = defaultdict(list)
    for c, lo, hi in placed.groupBy(CHUNK).agg(F.min(key).alias("lo"), F.max(key).alias("hi")).collect():  # a row per chunk
        for k in {tuple(lo), tuple(hi)}:
            chunks_of[k].append(c)
    # a key that goes on is the last of one chunk and the first of the next
    groups = {k: cs for k, cs in chunks_of.items() if len(cs) > 1}
    if not groups:
        return []
    spark = placed.sparkSession
    where = spark.createDataFrame([(c, *k) for k, cs in groups.items() for c in cs], placed.select(CHUNK, *by).schema)
    w = Window.partitionBy(CHUNK, *by, "side")
    found = (placed.filter("held").join(F.broadcast(where), [CHUNK, *by], "left_semi")  # at most two keys of a chunk
             .withColumn("_last", F.row_number().over(w.orderBy(F.desc("end_date"), "_seq")))
             .withColumn("_next", F.row_number().over(w.orderBy("start_date", "_seq"))).filter("_last <= 2 or _next <= 2")
             .orderBy(CHUNK, "start_date", "_seq").select(CHUNK, *by, "start_date", "end_date", "side", "id", "_last", "_next").collect())
    rows = []
    for ahead in (True, False):
        here = defaultdict(list)
        for c, *rest, last, following in found:
            if (last if ahead else following) <= 2:
                here[c, tuple(rest[:len(by)])].append(tuple(rest[len(by):]))
        for k, chunks in groups.items():
            best: dict = {}
            for c in sorted(chunks, reverse=not ahead):
                rows += [(c, *k, _FIRST if ahead else start, end, side, i, 0 if ahead else _SEQ_LAST - n)
                         for own in best.values() for n, (start, end, side, i) in enumerate(reversed(own))]
                for row in here.get((c, k), []):
                    own = best.setdefault(row[2], [])
                    own.append(row)
                    own.sort(key=(lambda r: r[1]) if ahead else (lambda r: r[0]), reverse=ahead)
                    del own[2:]
    return rows


def sweep(rows: DataFrame, by: list[str], sides: list[str], skip: dict[str, str]) -> DataFrame:
    """The probes of ``rows`` with, for each side, whether a held row of it overlaps the probe.

    ``rows``: the columns ``by``, start_date, end_date, side, id (unique within a side), held,
    probe (booleans); ``skip``: for a side the column with the id that doesn't count (null: none).
    Output: all columns of the probes and ``hit_<side>``.  Empty ranges overlap nothing.
    """
    spark = rows.sparkSession
    live = rows.filter(F.col("start_date") < F.col("end_date"))
    placed = chunked(live, [*by, "start_date", "side", "id"]).withColumn("_seq", F.monotonically_increasing_id())
    carried = _carried(placed, by)
    every = placed
    if carried:
        names = [CHUNK, *by, "start_date", "end_date", "side", "id", "_seq"]
        extra = spark.createDataFrame(carried, placed.select(*names).schema)
        every = placed.unionByName(extra.withColumns({"held": F.lit(True), "probe": F.lit(False)}), allowMissingColumns=True)
    group = Window.partitionBy(CHUNK, *by)
    up = group.orderBy("start_date", "_seq").rowsBetween(Window.unboundedPreceding, -1)
    down = group.orderBy(F.desc("start_date"), F.desc("_seq")).rowsBetween(Window.unboundedPreceding, -1)
    mine = {s: F.col("held") & (F.col("side") == s) for s in sides}
    span = F.struct("end_date", "id"), F.struct("start_date", "id")
    out = every.select("*", *[F.max(F.when(mine[s], span[0])).over(up).alias(f"_end_{s}") for s in sides])
    # the second latest end: of each row's own and the latest before it, the lesser
    lesser = {s: F.when(mine[s] & F.col(f"_end_{s}").isNotNull(), F.least("end_date", f"_end_{s}.end_date")) for s in sides}
    out = out.select("*", *[F.max(lesser[s]).over(up).alias(f"_end2_{s}") for s in sides])
    out = out.select("*", *[F.last(F.when(mine[s], span[1]), ignorenulls=True).over(down).alias(f"_next_{s}") for s in sides])
    out = out.select("*", *[F.last(F.when(mine[s], F.struct(F.col(f"_next_{s}.start_date").alias("at"))), ignorenulls=True).over(down).alias(f"_next2_{s}")
                            for s in sides])

    def hit(s: str):
        end, nxt, no = F.col(f"_end_{s}"), F.col(f"_next_{s}"), F.col(skip[s]) if s in skip else F.lit(None)
        other = lambda x: no.isNull() | (x["id"] != no)
        before = F.when(other(end), end["end_date"]).otherwise(F.col(f"_end2_{s}")) > F.col("start_date")
        after = F.when(other(nxt), nxt["start_date"]).otherwise(F.col(f"_next2_{s}.at")) < F.col("end_date")
        return (F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))).alias(f"hit_{s}")

    return out.filter("probe").select(*rows.columns, *[hit(s) for s in sides])
