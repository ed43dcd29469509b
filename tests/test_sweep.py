"""The interval sweep against all pairs, with hot keys cut into chunks."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from innkeep.operators.sweep import sweep

DAY = dt.date(2026, 1, 1)
SCHEMA = "key long, start_date date, end_date date, side string, id long, held boolean, probe boolean, no_a long"


def brute(rows):
    out = []
    for x in rows:
        if not x[6] or x[1] >= x[2]:
            continue
        hits = []
        for side, skip in (("a", x[7]), ("b", None)):
            hits.append(any(y is not x and y[5] and y[3] == side and y[0] == x[0] and y[4] != skip and y[1] < x[2] and x[1] < y[2] and y[1] < y[2] for y in rows))
        out.append((x[0], x[3], x[4], *hits))
    return sorted(out)


@pytest.mark.parametrize("seed,days,parts", [(0, 40, 8), (1, 400, 8), (2, 3000, 8), (3, 90, 3), (4, 6, 16)])
def test_sweep_equals_all_pairs(spark, seed, days, parts):
    rng = random.Random(seed)
    rows = []
    for i in range(260):
        start = DAY + dt.timedelta(rng.randrange(days))
        held = rng.random() < 0.7
        rows.append((rng.choice([1, 1, 1, 1, 2, 3]), start, start + dt.timedelta(rng.choice([0, 1, 1, 2, 5, 60])), rng.choice("ab"), i,
                     held, not held or rng.random() < 0.5, rng.choice([None, i, rng.randrange(260)])))
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = sweep(spark.createDataFrame(rows, SCHEMA).repartition(4), ["key"], ["a", "b"], {"a": "no_a"})
        got = sorted(map(tuple, got.select("key", "side", "id", "hit_a", "hit_b").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == brute(rows)


def test_nothing_to_sweep(spark):
    assert sweep(spark.createDataFrame([], SCHEMA), ["key"], ["a"], {}).count() == 0
    empty = [(1, DAY, DAY, "a", 1, True, True, None)]
    assert sweep(spark.createDataFrame(empty, SCHEMA), ["key"], ["a"], {}).filter(F.col("hit_a")).count() == 0
