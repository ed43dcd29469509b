"""Running sums over groups cut into chunks."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from innkeep.operators.scan import running_sums


@pytest.mark.parametrize("group", [["g"], []])
def test_running_sums_equal_a_loop(spark, group):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 7, 7, 7, 7]), i, rng.randrange(9)) for i in range(700)]
    df = spark.createDataFrame(rows, "g long, i long, v long").repartition(5)
    got = running_sums(df, group, ["i"], {"n": F.lit(1), "s": F.col("v")}, n_parts=6)
    assert got.columns == ["g", "i", "v", "n", "s"]
    n, s, want = defaultdict(int), defaultdict(int), {}
    for g, i, v in sorted(rows, key=lambda r: r[1]):
        k = g if group else 0
        n[k] += 1
        s[k] += v
        want[i] = (n[k], s[k])
    assert {r["i"]: (r["n"], r["s"]) for r in got.collect()} == want
    assert running_sums(df.limit(0), group, ["i"], {"n": F.lit(1)}).count() == 0
