"""Exact dedup, sharding and mixing against brute force on small frames."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from innkeep.llm import exact_dedup, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, parts=5):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def awkward(n=120, seed=1):
    rng = random.Random(seed)
    texts = [None, "", " ", "a", "A", "ä ö", "x" * 50_000] + [" ".join(rng.choices("ab cd ef gh".split(), k=rng.randint(1, 4))) for _ in range(20)]
    rows = [(i, rng.choice(texts), rng.choice(["en", None]), rng.choice(["s0", "s0", "s1", None]), None) for i in range(n)]
    rows += [rows[3], rows[3], (None, "a", "en", "s0", 1), (None, "only null", None, None, None)]
    return rows


@pytest.mark.parametrize("keep", ["min", "max"])
@pytest.mark.parametrize("bits", [1, 4])
def test_exact_groups_equal_brute_force(spark, keep, bits):
    rows = awkward()
    got = exact_dedup.exact_groups(frame(spark, rows, 9), keep=keep, bits=bits).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    pick = {"min": min, "max": max}[keep]
    want = []
    for r in rows:
        ids = groups[r[1] or ""]
        known = [i for i in ids if i is not None]
        best = pick(known) if known else None
        want.append((r[0], best, len(ids), r[0] == best, hashlib.sha256((r[1] or "").encode()).hexdigest()))
    order = lambda x: tuple(str(v) for v in x)
    assert sorted((tuple(r) for r in got), key=order) == sorted(want, key=order)


def test_exact_groups_hot_copy_and_empty_table(spark):
    rows = [(i, "hot", None, None, None) for i in range(400)] + [(1000 + i, f"t{i}", None, None, None) for i in range(5)]
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(frame(spark, rows, 16), keep="max").collect()}
    assert len(got) == 405 and got[7]["keep_id"] == 399 and got[7]["group_size"] == 400 and got[1003]["kept"]
    assert exact_dedup.exact_groups(frame(spark, [], 1)).count() == 0


def test_extra_and_clashing_columns(spark):
    df = frame(spark, awkward(30)).withColumn("run", F.lit("x")).withColumn("best", F.lit(1)).withColumn("sha", F.lit(2))
    assert exact_dedup.exact_groups(df).count() == df.count()
    assert sharding.assign_shards(df.withColumn("shard", F.lit(1)).withColumn("slot", F.lit(1))).count() == df.count()
    more = df.withColumn("tokens", F.lit(1)).withColumn("domain", F.lit("q")).withColumn("language", F.lit("q")).withColumn("pos", F.lit(0))
    assert mixing.mixture(more, share=0.5, max_epochs=1).columns == more.columns


def test_native_plan_has_no_python(spark):
    plan = exact_dedup.exact_groups(frame(spark, awkward(20)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_runs_are_sorted_and_merged_in_order(spark):
    digests = exact_dedup.sorted_runs(frame(spark, awkward(20), 40))
    runs = digests.select("run", *exact_dedup.KEY, F.struct("id").alias("best"), F.lit(1).alias("n"))
    plan = exact_dedup._merge(runs, F.min)._jdf.queryExecution().executedPlan().toString()
    steps = [x for x in plan.splitlines() if "Aggregate" in x or "Sort [" in x or "hashpartitioning" in x]
    found = [next(w for w in ("SortAggregate", "Sort [run", "hashpartitioning(run", "other") if w in x or w == "other") for x in steps]
    assert found == ["SortAggregate", "Sort [run", "hashpartitioning(run", "SortAggregate", "Sort [run"]


def test_shards_law_slots_and_growth(spark):
    rows = awkward(600, 5)
    got = sharding.assign_shards(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_key, slots = defaultdict(set), defaultdict(list)
    for r in got:
        by_key[r["doc_id"]].add((r["shard"], r["grown_shard"]))
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and 0 <= r["shard"] < 24
        assert r["grown_shard"] in (r["shard"], 24)
    assert all(len(v) == 1 for v in by_key.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = sorted((str(r[0]), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    assert sharding.assign_shards(frame(spark, [], 1)).count() == 0


def test_shards_follow_weights_and_confine_movement(spark):
    tree = [("a", "r0", 0, 1.0), ("a", "r1", 1, 3.0), ("b", "r0", 2, 4.0)]
    heavier = [("a", "r0", 0, 1.0), ("a", "r1", 1, 3.0), ("b", "r0", 2, 8.0)]
    inner = [("a", "r0", 0, 2.0), ("a", "r1", 1, 2.0), ("b", "r0", 2, 4.0)]
    df = spark.range(20_000).select(*[sharding.shard_column(F.col("id"), t).alias(n) for n, t in (("x", tree), ("y", heavier), ("z", inner))])
    rows = df.collect()
    share = [sum(r["x"] == s for r in rows) / len(rows) for s in range(3)]
    assert all(abs(a - b) < 0.02 for a, b in zip(share, (1 / 8, 3 / 8, 1 / 2), strict=True))
    assert all(r["y"] in (r["x"], 2) for r in rows)  # only into the heavier subtree
    assert all((r["z"] == 2) == (r["x"] == 2) for r in rows)  # the other region is untouched


def test_numbered_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 16)
    df = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).alias("g"))
    got = sharding.numbered(df, "g", ["doc_id"]).collect()
    for g in range(3):
        own = sorted(r["slot"] for r in got if r["g"] == g)
        assert own == list(range(len(own)))


def brute_budget(supply, weight, budget):
    """Water level by bisection."""
    alive = {k: (supply[k] if weight[k] > 0 else 0) for k in supply}
    if sum(alive.values()) <= budget:
        return {k: float(v) for k, v in alive.items()}
    lo, hi = 0.0, 1e12
    for _ in range(300):
        mid = (lo + hi) / 2
        if sum(min(alive[k], mid * weight[k]) for k in alive) <= budget:
            lo = mid
        else:
            hi = mid
    return {k: min(alive[k], lo * weight[k]) for k in alive}


def test_leaf_budgets_equal_brute_force(spark):
    rng = random.Random(3)
    leaves = [(d, l, s, rng.randint(0, 2000)) for d in ("x", "y", "z") for l in ("en", "de") for s in ("s1", "s2", "s3")]
    weights = {("x",): 5.0, ("y",): 0.0, ("*", "en"): 3.0, ("x", "en", "s2"): 7.0}
    df = spark.createDataFrame(leaves, "domain string, language string, source string, tokens long")
    total = 0.55 * 2 * sum(x[3] for x in leaves)
    got = {(r["domain"], r["language"], r["source"]): r["budget"] for r in mixing.leaf_budgets(df, total, weights, 2).collect()}
    tree = defaultdict(lambda: defaultdict(dict))
    for d, l, s, t in leaves:
        tree[d][l][s] = 2 * t
    wd = {"x": 5.0, "y": 0.0, "z": 1.0}
    top = brute_budget({d: sum(sum(x.values()) for x in tree[d].values()) for d in tree}, wd, total)
    for d in tree:
        mid = brute_budget({l: sum(tree[d][l].values()) for l in tree[d]}, {"en": 3.0, "de": 1.0}, top[d])
        for l in tree[d]:
            low = brute_budget(tree[d][l], {s: weights.get((d, l, s), 1.0) for s in tree[d][l]}, mid[l])
            for s, v in low.items():
                assert math.isclose(got[d, l, s], v, rel_tol=1e-6, abs_tol=1e-3), (d, l, s)


@pytest.mark.parametrize("bin_rows", [2048, 8])
def test_mixture_takes_the_longest_prefix(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(mixing, "BIN_ROWS", bin_rows)
    rng = random.Random(9)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)), rng.choice(["en", "de"]), rng.choice(["s0", "s0", "s0", "s1"]), 0) for i in range(500)]
    df = frame(spark, rows)
    got = mixing.select_mixture(df, share=0.9, max_epochs=3, weights={("*", "de"): 4.0}).collect()
    assert len(got) == 500
    leaves = defaultdict(list)
    for r in got:
        assert r["tokens"] == len(rows[r["doc_id"]][1].split())
        leaves[r["language"], r["source"]].append(r)
    assert len(leaves) == 4
    for own in leaves.values():
        spent, budget = sum(r["n_taken"] * r["tokens"] for r in own), own[0]["leaf_budget"]
        low = min(r["n_taken"] for r in own)
        assert all(r["n_taken"] <= 3 for r in own) and max(r["n_taken"] for r in own) - low <= 1
        assert spent <= budget + 1e-3 and budget - spent <= 9
    total = sum(r["tokens"] * r["n_taken"] for r in got)
    assert total <= 0.9 * sum(r["tokens"] for r in got) + 1e-3
    rows_out = mixing.mixture(df, share=0.9, max_epochs=3, weights={("*", "de"): 4.0})
    assert rows_out.columns == df.columns and rows_out.count() == sum(r["n_taken"] for r in got)


def test_mixture_awkward_and_empty(spark):
    rows = awkward(80)
    df = frame(spark, rows)
    got = mixing.select_mixture(df, share=0.7, max_epochs=1).collect()
    assert len(got) == len(rows) and {r["n_taken"] for r in got} <= {0, 1}
    assert mixing.mixture(frame(spark, [], 1)).count() == 0
