"""Ordered writes of entities under unique values: each change succeeds or fails as a whole.

A change inserts or updates one entity (a customer with its person and account, a room ...) and
sets unique values (legal id, e-mail, room number ...).  Changes are decided one after another in
(ord, change_id) order: an insert fails if the entity is there, an update if it isn't, or is out
of the writer's scope; a change fails at the first unique value (in the order of ``uq``) that
another entity holds then (stored values may have several holders).  An accepted change gives up its entity's old values, so a later one
may take them.

Changes are linked where they share an entity or a wanted value, a value's present holder
included if it has changes itself.  Every component of at most ``REPLAY`` changes is replayed by
itself.  A larger one is cut along (ord, change_id) into slices of that many changes, replayed one
after another, so the steps are as many as the slices and not as the longest chain of changes.

What a slice leaves is handed on row by row: an entity's home goes to the next slice that changes
the entity, a held value to the next one that changes its holder or wants it.  Rows lie in a folder
for each slice under the checkpoint folder; a step reads its own folder and adds to later ones, so
it costs what its slice touches and no table is written anew.
"""

from __future__ import annotations

import json
import os
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from innkeep.operators.components import components
from innkeep.operators.rank import rank_within_groups
from innkeep.session import ensure_checkpoint_dir

REPLAY = 200_000
#: Changes of small components that are replayed in one group.
BIN = 5_000
EXISTS, NOT_FOUND, OUT_OF_SCOPE = -3, -2, -1
OUT = "change_id long, entity string, accepted boolean, code int"
#: Kinds of rows that a slice reads: entities that are there, values held by an entity, changes, values held by
#: entities without changes, and the next slices that change an entity or want a value.
ENTITY, HELD, CHANGE, FIXED, NEXT_CHANGED, NEXT_WANTED = range(6)
#: Folder of the decisions, beside those of the slices.
DECIDED = -1
#: Rows of a slice, few and flat columns, whose sizes Spark adds up for every row that it hands to Python.  ``text``
#: is a home, a value, or what a change asks as JSON.
ROW = "kind int, grp string, change_id long, ord {ord}, entity string, text string, uq int, e_next int, v_next int"
LEFT = "kind int, grp string, change_id long, entity string, accepted boolean, code int, text string, uq int, e_next int, v_next int, dest int"
_LEFT = pa.schema([("kind", pa.int32()), ("grp", pa.string()), ("change_id", pa.int64()), ("entity", pa.string()), ("accepted", pa.bool_()), ("code", pa.int32()),
                   ("text", pa.string()), ("uq", pa.int32()), ("e_next", pa.int32()), ("v_next", pa.int32()), ("dest", pa.int32())])


def _replay(rows: pa.Table) -> pa.Table:
    """Decide the changes of some whole components, or of a slice of one, in order."""
    names = ["kind", "entity", "uq", "text", "e_next", "v_next"]
    state = rows.filter(pc.not_equal(rows["kind"], CHANGE)).select(names)
    home, values, fixed, e_next, v_next, e_now, v_now = {}, {}, set(), {}, {}, {}, {}
    for kind, entity, q, v, e, w in zip(*[state.column(c).to_pylist() for c in names], strict=True):
        if kind == ENTITY:
            home.setdefault(entity, v)
        elif kind == HELD:
            values.setdefault(entity, {})[q] = v
            e_next[entity], v_next[q, v] = e, w
        elif kind == FIXED:
            fixed.add((q, v))
        elif kind == NEXT_CHANGED:
            e_now[entity] = e
        else:
            v_now[q, v] = w
    owner: dict = {}
    for entity, own in values.items():
        for pair in own.items():
            owner.setdefault(pair, set()).add(entity)
    asked = rows.filter(pc.equal(rows["kind"], CHANGE)).sort_by([("ord", "ascending"), ("change_id", "ascending"), ("entity", "ascending")])
    entities = asked["entity"].to_pylist()
    wanted = set()
    codes = []
    none: frozenset = frozenset()
    for entity, text in zip(entities, asked["text"].to_pylist(), strict=True):
        ask = json.loads(text)
        op, scope, new_home = ask.get("op"), ask.get("scope"), ask.get("home")
        sets = [(x["uq"], x["value"]) for x in ask.get("sets", ())]
        wanted.update(sets)
        if op == "insert" and entity in home:
            code = EXISTS
        elif op == "update" and entity not in home:
            code = NOT_FOUND
        elif op == "update" and scope is not None and home[entity] != scope:
            code = OUT_OF_SCOPE
        else:
            code = None
            for pair in sets:
                holders = owner.get(pair, none)
                if pair in fixed or len(holders) > (entity in holders):
                    code = pair[0]
                    break
        if code is None:
            own = values.setdefault(entity, {})
            for q in ask.get("resets", ()):
                owner.get((q, own.pop(q, None)), set()).discard(entity)
            for pair in sets:
                q = pair[0]
                owner.get((q, own.get(q)), set()).discard(entity)
                own[q] = pair[1]
                owner.setdefault(pair, set()).add(entity)
            home[entity] = new_home if new_home is not None else home.get(entity)
        codes.append(code)
    # what is touched here goes on to the next slice that touches it; the rest keeps where it was bound for
    for entity in entities:
        e_next[entity] = e_now.get(entity)
    for pair in wanted:
        v_next[pair] = v_now.get(pair)
    left = [(ENTITY, entity, None, home[entity], e, None, e) for entity, e in e_next.items() if e is not None and entity in home]
    for entity, own in values.items():
        e = e_next[entity]
        for pair in own.items():
            w = v_next[pair]
            if e is not None or w is not None:
                left.append((HELD, entity, *pair, e, w, w if e is None else e if w is None else min(e, w)))
    left += [(FIXED, None, *pair, None, v_next[pair], v_next[pair]) for pair in fixed if v_next.get(pair) is not None]
    code = pa.array(codes, pa.int32())
    decided = {"kind": [CHANGE] * len(codes), "change_id": asked["change_id"], "entity": asked["entity"], "accepted": code.is_null(), "code": code, "dest": [DECIDED] * len(codes)}
    kept = dict(zip([*names, "dest"], zip(*left, strict=True), strict=True)) if left else {}
    kept["grp"] = [rows["grp"][0].as_py()] * len(left)
    table = lambda n, own: pa.table([pa.nulls(n, f.type) if f.name not in own else own[f.name].cast(f.type) if isinstance(own[f.name], (pa.Array, pa.ChunkedArray))
                                     else pa.array(own[f.name], f.type) for f in _LEFT], schema=_LEFT)
    return pa.concat_tables([table(len(codes), decided), table(len(left), kept)])


def _onward(touches: DataFrame, key: list[str], kind: int, name: str) -> DataFrame:
    """For every slice that touches a key, the next one that does."""
    later = touches.select(*key, "grp", "dest").distinct() \
        .withColumn(name, F.lead("dest").over(Window.partitionBy(*key).orderBy("dest")))  # a key has a row a slice
    return later.filter(F.col(name).isNotNull()).withColumn("kind", F.lit(kind))


def decide_writes(entities: DataFrame, held: DataFrame, changes: DataFrame, sets: DataFrame, replay_most: int | None = None) -> DataFrame:
    """``(change_id, entity, accepted, code)``; code: None, EXISTS, NOT_FOUND, OUT_OF_SCOPE or the uq taken.

    ``entities``: entity, home; ``held``: entity, uq, value (no nulls); ``changes``: change_id, ord,
    entity, op, scope (null: any), new_home (null: as it was); ``sets``: change_id, uq, value of the
    unique values that a change sets (null: given up).
    """
    most = REPLAY if replay_most is None else replay_most
    spark = changes.sparkSession
    base = os.path.join(ensure_checkpoint_dir(spark), "unit_writes", uuid.uuid4().hex)
    own_sets = sets.groupBy("change_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct(F.col("uq").cast("int").alias("uq"), "value")))).alias("sets"),
        F.collect_list(F.when(F.col("value").isNull(), F.col("uq").cast("int"))).alias("resets"))
    asked = changes.select("change_id", "ord", "entity", "op", "scope", "new_home").join(own_sets, "change_id", "left").checkpoint(eager=True)
    if asked.isEmpty():
        return spark.createDataFrame([], OUT)
    mine = asked.select("entity").distinct()
    of_values = lambda df, *extra: df.select(*extra, F.explode("sets").alias("s")).select(*extra, "s.uq", "s.value")
    wants = of_values(asked, "change_id")
    wanted = wants.select("uq", "value").distinct()
    # only entities with changes, and wanted values, matter
    entities = entities.join(mine, "entity", "left_semi").select("entity", "home").checkpoint(eager=True)
    held = held.select("entity", F.col("uq").cast("int").alias("uq"), "value")
    held = held.join(mine, "entity", "left_semi").withColumn("named", F.lit(True)).unionByName(
        held.join(wanted, ["uq", "value"], "left_semi").join(mine, "entity", "left_anti").withColumn("named", F.lit(False))).checkpoint(eager=True)
    first_own = asked.groupBy("entity").agg(F.min("change_id").alias("change_id"))
    held_wanted = held.filter("named").join(wanted, ["uq", "value"], "left_semi").join(first_own, "entity")
    # two keys of one hash only put more changes into a component
    value_key = F.xxhash64("uq", "value").alias("key")
    touched = asked.select(F.xxhash64(F.lit("e"), "entity").alias("key"), "change_id") \
        .unionByName(wants.select(value_key, "change_id")).unionByName(held_wanted.select(value_key, "change_id"))
    lowest = touched.groupBy("key").agg(F.min("change_id").alias("first"))
    links = touched.join(lowest, "key").select(F.col("change_id").alias("a"), F.col("first").alias("b"))
    roots = components(links).withColumnRenamed("node", "change_id")
    asked = asked.join(roots, "change_id", "left").withColumn("root", F.coalesce("root", "change_id")).checkpoint(eager=True)
    sizes = asked.groupBy("root").count().filter(F.col("count") > min(BIN, most)).checkpoint(eager=True)
    large = sizes.filter(F.col("count") > most).select("root")
    # a group is one component, or a bin of small ones, which don't meet
    n_bins = asked.count() // BIN + 1
    small = asked.join(large, "root", "left_anti").join(sizes, "root", "left").withColumn("dest", F.lit(0)).withColumn(
        "grp", F.when(F.col("count").isNull(), F.concat(F.lit("b"), F.pmod(F.xxhash64("root"), F.lit(n_bins)).cast("string")))
        .otherwise(F.concat(F.lit("r"), F.col("root").cast("string")))).drop("count", "root")
    turns, last = small, 0
    if not large.isEmpty():
        rest = rank_within_groups(asked.join(large, "root", "left_semi"), ["root"], [F.col(c).asc_nulls_last() for c in ("ord", "change_id", "entity")], "_n") \
            .withColumn("dest", F.floor((F.col("_n") - 1) / most).cast("int")).withColumn("grp", F.concat(F.lit("r"), F.col("root").cast("string"))) \
            .drop("_n", "root").checkpoint(eager=True)
        turns, last = small.unionByName(rest), rest.agg(F.max("dest")).first()[0]
    by_entity = turns.groupBy("entity").agg(F.first("grp").alias("e_grp"), F.min("dest").alias("e_next"))
    by_value = of_values(turns, "grp", "dest").groupBy("uq", "value").agg(F.first("grp").alias("v_grp"), F.min("dest").alias("v_next"))
    first = F.least("e_next", "v_next").alias("dest")
    parts = [
        # an entity that is listed n times gets each of its changes n times
        turns.join(entities.select("entity"), "entity", "left").select(
            F.lit(CHANGE).alias("kind"), "grp", "change_id", "ord", "entity", F.to_json(F.struct("op", "scope", F.col("new_home").alias("home"), "sets", "resets")).alias("text"), "dest"),
        entities.join(by_entity, "entity").select(F.lit(ENTITY).alias("kind"), F.col("e_grp").alias("grp"), "entity", F.col("home").alias("text"), "e_next", F.col("e_next").alias("dest")),
        held.filter("named").drop("named").join(by_entity, "entity").join(by_value, ["uq", "value"], "left").select(
            F.lit(HELD).alias("kind"), F.col("e_grp").alias("grp"), "entity", "uq", F.col("value").alias("text"), "e_next", "v_next", first),
        held.filter("not named").select("uq", "value").distinct().join(by_value, ["uq", "value"]).select(
            F.lit(FIXED).alias("kind"), F.col("v_grp").alias("grp"), "uq", F.col("value").alias("text"), "v_next", F.col("v_next").alias("dest"))]
    if last:
        parts += [_onward(rest, ["entity"], NEXT_CHANGED, "e_next"), _onward(of_values(rest, "grp", "dest").withColumnRenamed("value", "text"), ["uq", "text"], NEXT_WANTED, "v_next")]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    every.repartition("dest", F.pmod(F.xxhash64("change_id", "entity", "text"), F.lit(32))).write.partitionBy("dest").parquet(base)
    row = ROW.format(ord=asked.schema["ord"].dataType.simpleString())
    for n in range(last + 1):
        now = spark.read.schema(row).parquet(f"{base}/dest={n}")
        now.groupBy("grp").applyInArrow(_replay, LEFT).write.mode("append").partitionBy("dest").parquet(base)
    return spark.read.schema(OUT).parquet(f"{base}/dest={DECIDED}")
