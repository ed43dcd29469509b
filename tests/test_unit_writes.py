"""Ordered writes under unique values against a loop."""

import random

import pytest

from innkeep.operators.unit_writes import EXISTS, NOT_FOUND, OUT_OF_SCOPE, decide_writes

CHANGES = "change_id long, ord long, entity string, op string, scope string, new_home string"


def loop(entities, held, changes, sets):
    home, own = dict(entities), {}
    for e, q, v in held:
        own.setdefault(e, {})[q] = v
    out = {}
    for cid, _ord, e, op, scope, new_home in sorted(changes, key=lambda c: (c[1], c[0])):
        mine = sorted((q, v) for c, q, v in sets if c == cid)
        holder = {}
        for x, qs in own.items():
            for pair in qs.items():
                holder.setdefault(pair, set()).add(x)
        if op == "insert" and e in home:
            code = EXISTS
        elif op == "update" and e not in home:
            code = NOT_FOUND
        elif op == "update" and scope is not None and home[e] != scope:
            code = OUT_OF_SCOPE
        else:
            code = next((q for q, v in mine if v is not None and holder.get((q, v), set()) - {e}), None)
        if code is None:
            home[e] = new_home if new_home is not None else home.get(e)
            for q, v in mine:
                own.setdefault(e, {}).pop(q, None)
                if v is not None:
                    own[e][q] = v
        out[cid] = code
    return out


def case(seed, n):
    rng = random.Random(seed)
    names = [f"e{i}" for i in range(14)]
    entities = [(e, rng.choice("xy")) for e in names[:9]]
    free = [(q, f"v{i}") for q in range(3) for i in range(14)]
    rng.shuffle(free)
    held, seen = [], set()
    for e, _ in entities:
        for q, v in free:
            if (e, q) not in seen and rng.random() < 0.6 and (q == 0 or (q, v) not in {(b, c) for _, b, c in held}):
                seen.add((e, q))
                held.append((e, q, v))
    changes = [(i, rng.randrange(n), rng.choice(names), rng.choice(["insert", "update", "update"]), rng.choice([None, None, "x"]),
                rng.choice([None, "x", "y"])) for i in range(n)]
    sets = [(i, q, rng.choice([None, *[f"v{k}" for k in range(14)]])) for i in range(n) for q in range(3) if rng.random() < 0.5]
    return entities, held, changes, sets


@pytest.mark.parametrize("seed,n,most", [(2, 150, None), (3, 24, 8)])
def test_equals_loop(spark, seed, n, most):
    entities, held, changes, sets = case(seed, n)
    frame = spark.createDataFrame
    got = decide_writes(frame(entities, "entity string, home string"), frame(held, "entity string, uq int, value string"),
                        frame(changes, CHANGES).repartition(3), frame(sets, "change_id long, uq int, value string"), most).collect()
    assert {r.change_id: r.code for r in got} == loop(entities, held, changes, sets)
    assert all(r.accepted == (r.code is None) for r in got) and len(got) == n


def test_chain_is_replayed_not_walked(spark):
    """Each of 3,000 changes takes the value that the one before it gives up."""
    n = 3000
    entities = [(f"e{i}", None) for i in range(n)]
    held = [(f"e{i}", 0, f"v{i}") for i in range(n)]
    changes = [(i, i, f"e{i}", "update", None, None) for i in range(n)]
    sets = [(i, 0, "free" if i == 0 else f"v{i - 1}") for i in range(n)]
    frame = spark.createDataFrame
    got = decide_writes(frame(entities, "entity string, home string"), frame(held, "entity string, uq int, value string"),
                        frame(changes, CHANGES), frame(sets, "change_id long, uq int, value string"))
    assert got.count() == n == got.filter("accepted").count()


def test_no_changes(spark):
    frame = spark.createDataFrame
    assert decide_writes(frame([], "entity string, home string"), frame([], "entity string, uq int, value string"),
                         frame([], CHANGES), frame([], "change_id long, uq int, value string")).count() == 0


def test_hot_values_need_a_step_a_slice_not_a_change(spark):
    """300 changes on 3 entities that want 2 values: slices of 100 changes, not a round for each."""
    rng = random.Random(5)
    entities, held = [("e0", "x"), ("e1", "x")], [("e0", 0, "v0")]
    changes = [(i, i, f"e{rng.randrange(3)}", rng.choice(["insert", "update"]), None, None) for i in range(300)]
    sets = [(i, 0, rng.choice([None, "v0", "v1"])) for i in range(300)]
    frame = spark.createDataFrame
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))
    got = decide_writes(frame(entities, "entity string, home string"), frame(held, "entity string, uq int, value string"),
                        frame(changes, CHANGES), frame(sets, "change_id long, uq int, value string"), 100).collect()
    assert {r.change_id: r.code for r in got} == loop(entities, held, changes, sets)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - jobs < 200


def test_many_slices_hand_on_what_they_leave(spark):
    """Slices of 5 changes equal the loop, homes, moved and given up values and several holders included; a
    slice is a few jobs however many tables it might have to join."""
    entities, held, changes, sets = case(11, 100)
    frame, tracker = spark.createDataFrame, spark.sparkContext.statusTracker()

    def decided(most):
        before = len(tracker.getJobIdsForGroup(None))
        got = decide_writes(frame(entities, "entity string, home string"), frame(held, "entity string, uq int, value string"),
                            frame(changes, CHANGES).repartition(3), frame(sets, "change_id long, uq int, value string"), most).collect()
        assert {r.change_id: r.code for r in got} == loop(entities, held, changes, sets) and len(got) == 100
        return len(tracker.getJobIdsForGroup(None)) - before

    few, many = decided(50), decided(5)
    assert many - few < 18 * 6  # 18 slices more
