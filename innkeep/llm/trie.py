"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns.  Sequences are told apart by running sums of
SHA-256 digests of (place, role, text), 240 bits of them, taken over chunks, so no conversation
is gathered in one task.  A node is named by its depth and its smallest member.

The tour enters a node, walks its children in the order of their names, and leaves it: every
node has an enter and an exit arc, and each arc knows its successor.  ``list_rank`` turns
successors into places: of the arcs about one in ``SPARSE`` is a ruler; all others jump by
doubling until they meet the next ruler, and the rulers are a list an eighth as long, ranked the
same way.  The last ``BASE`` arcs are ranked in one task.  Prefix sums over the places then give
each subtree its sums: what lies between its two arcs.

Defined cases: null conversation ids belong to no conversation and are left out; null turns come
first, null roles and texts are empty; equal turn numbers are ordered by role and text; rows
that repeat are turns of their own; conversations that lend turns or have none left still are
members of the root; an empty table has no nodes.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.llm.store import stored
from innkeep.operators.scan import running_sums

#: One arc in so many is a ruler; so many arcs are ranked in one task.
SPARSE, BASE = 8, 1 << 16
LANES = 4


def ordered_turns(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, role, text): the turns of every conversation, numbered from 0."""
    known = rows.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    numbered = running_sums(known, ["conv"], ["turn", "role", "text"], {"pos": F.lit(1)})
    return numbered.select("conv", (F.col("pos") - 1).alias("pos"), "role", "text")


def rebuilt(turns: DataFrame, block: int = 20, most: int = 4) -> DataFrame:
    """(conv, pos, role, text) with conversations' beginnings taken from others.

    Conversation c begins with the first h = crc32(c) % ``most`` turns of c - c % ``block`` and
    goes on with its own after the first h.
    """
    convs = turns.select("conv").distinct().select(
        "conv", (F.col("conv") - F.col("conv") % block).alias("lender"),
        F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(most)).alias("h"))
    heads = turns.filter(F.col("pos") < most - 1).withColumnRenamed("conv", "lender")
    lent = convs.join(heads, "lender").filter("pos < h").select("conv", "pos", "role", "text")
    n_lent = lent.groupBy("conv").agg(F.count(F.lit(1)).alias("k"))
    shift = convs.select("conv", "h").join(n_lent, "conv", "left").select("conv", "h", F.coalesce("k", F.lit(0)).alias("k"))
    own = turns.join(shift, "conv").filter("pos >= h").select("conv", (F.col("k") + F.col("pos") - F.col("h")).alias("pos"), "role", "text")
    return lent.unionByName(own)


def nodes_and_members(convs: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members).  nodes: depth, conv, parent (smallest member of the parent), n_convs, words;
    members: depth, node (its conv), conv, last (whether the conversation ends there)."""
    body = F.concat_ws(":", F.col("pos").cast("string"), F.octet_length("role").cast("string"), F.concat("role", "text"))
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    light = turns.select("conv", "pos", F.sha2(body, 256).alias("sha"), words.alias("words"))
    lanes = {f"k{i}": F.conv(F.substring("sha", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(LANES)}
    keyed = running_sums(light, ["conv"], ["pos"], lanes).select(
        (F.col("pos") + 1).alias("depth"), "conv", "words", F.concat_ws(":", *[F.col(k).cast("string") for k in lanes]).alias("key"))
    root = convs.select(F.lit(0).cast("long").alias("depth"), "conv", F.lit(0).cast("long").alias("words"), F.lit("").alias("key"))
    keyed = stored(keyed.withColumn("depth", F.col("depth").cast("long")).unionByName(root), "prefixes")
    named = stored(keyed.groupBy("depth", "key").agg(F.min("conv").alias("node"), F.count(F.lit(1)).alias("n_convs"),
                                                     F.max("words").alias("words")), "names")
    ends = keyed.groupBy("conv").agg(F.max("depth").alias("end"))
    members = stored(keyed.join(named.select("depth", "key", "node"), ["depth", "key"]).join(ends, "conv")
                     .select("depth", "node", "conv", (F.col("depth") == F.col("end")).alias("last")), "members")
    above = members.select((F.col("depth") + 1).alias("depth"), F.col("conv").alias("node"), F.col("node").alias("parent"))
    nodes = named.select("depth", "node", "n_convs", "words").join(above, ["depth", "node"], "left")
    return nodes.select("depth", F.col("node").alias("conv"), "parent", "n_convs", "words"), members


def tour_arcs(nodes: DataFrame) -> DataFrame:
    """nodes with ``id`` (from 0, siblings in a row by name), and its arcs' successors ``enter_next``,
    ``exit_next``: arc 2 * id enters, arc 2 * id + 1 leaves; the tour's last arc has none."""
    numbered = running_sums(nodes, [], ["depth", "parent", "conv"], {"id": F.lit(1)}).withColumn("id", F.col("id") - 1)
    numbered = stored(numbered, "numbered")
    first = numbered.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("conv")).agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("n_children"))
    parents = numbered.select((F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent"), F.col("id").alias("parent_id"))
    beside = numbered.select((F.col("id") - 1).alias("id"), F.col("depth").alias("b_depth"), F.col("parent").alias("b_parent"))
    joined = numbered.join(first, ["depth", "conv"], "left").join(parents, ["depth", "parent"], "left").join(beside, "id", "left")
    sibling = (F.col("b_depth") == F.col("depth")) & (F.col("b_parent") == F.col("parent"))
    return joined.select(
        "id", "depth", "conv", "parent", "n_convs", "words", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce(2 * F.col("first"), 2 * F.col("id") + 1).alias("enter_next"),
        F.when(sibling, 2 * (F.col("id") + 1)).otherwise(2 * F.col("parent_id") + 1).alias("exit_next"))


def list_rank(arcs: DataFrame, sparse: int = SPARSE, base: int = BASE) -> DataFrame:
    """(arc, pos): places from 1 of the arcs of one list; ``arcs``: arc, next (null: the last)."""
    links = stored(arcs.select("arc", F.col("next").cast("long").alias("next"), F.lit(1).cast("long").alias("far")), "list")
    return _to_end(links, sparse, base, 0).select("arc", (F.lit(links.count() + 1) - F.col("dist")).alias("pos"))


def _to_end(links: DataFrame, sparse: int, base: int, level: int) -> DataFrame:
    """(arc, dist): the sum of ``far`` from an arc to the end of the list, its own included.

    ``links``: arc, next, far (the distance from the arc to the next one).
    """
    if links.count() <= base:
        return stored(links.repartition(1).mapInPandas(_walk, "arc long, dist long"), "walked")
    is_ruler = F.pmod(F.xxhash64("arc", F.lit(level)), F.lit(sparse)) == 0
    next_is_ruler = F.pmod(F.xxhash64("next", F.lit(level)), F.lit(sparse)) == 0
    jumps = links.select("arc", "next", "far", (F.col("next").isNull() | next_is_ruler).alias("done"))
    settled = []
    while True:  # every arc's jump doubles until it meets a ruler or the end
        jumps = stored(jumps, "jumps")
        settled.append(jumps.filter("done"))
        moving = jumps.filter(~F.col("done"))
        if moving.isEmpty():
            break
        known = settled[0]
        for s in settled[1:]:
            known = known.unionByName(s)
        ahead = known.unionByName(moving).select(F.col("arc").alias("next"), F.col("next").alias("n2"), F.col("far").alias("f2"), F.col("done").alias("d2"))
        jumps = moving.join(ahead, "next").select("arc", F.col("n2").alias("next"), (F.col("far") + F.col("f2")).alias("far"), F.col("d2").alias("done"))
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    out = stored(out.select("arc", "next", "far", is_ruler.alias("ruler")), "settled")
    ruled = _to_end(stored(out.filter("ruler").select("arc", "next", "far"), "list"), sparse, base, level + 1)
    plain = out.filter(~F.col("ruler")).join(ruled.select(F.col("arc").alias("next"), "dist"), "next", "left")
    return stored(ruled.unionByName(plain.select("arc", (F.col("far") + F.coalesce("dist", F.lit(0))).alias("dist"))), "ranked")


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Distances of a short list, from its end backwards."""
    frames = list(frames)
    if not frames:
        return
    links = pd.concat(frames)
    back = {None if pd.isna(n) else int(n): (int(a), int(f)) for a, n, f in zip(links["arc"], links["next"], links["far"], strict=True)}
    arcs, dists, at, dist = [], [], None, 0
    while at in back:
        at, far = back[at]
        dist += far
        arcs.append(at)
        dists.append(dist)
    if len(arcs) != len(links):
        raise ValueError("the arcs are not one list")
    yield pd.DataFrame({"arc": arcs, "dist": dists})


def end_digests(members: DataFrame) -> DataFrame:
    """(depth, conv, ends_sha256): digest of the ids that end at a node, ascending, comma-joined.

    A digest needs its ids one after another: a node's ids pass one task, as a sorted stream.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest, done = None, None, []
        for batch in batches:
            for key in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if key[:2] != at:
                    if at:
                        done.append((*at, digest.hexdigest()))
                    at, digest = key[:2], hashlib.sha256(str(key[2]).encode())
                else:
                    digest.update(f",{key[2]}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))],
                                             ["depth", "conv", "ends_sha256"])
            done = []
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*at, digest.hexdigest())], ["depth", "conv", "ends_sha256"])

    dealt = members.filter("last").select("depth", "node", "conv").repartition("depth", "node").sortWithinPartitions("depth", "node", "conv")
    return dealt.mapInArrow(run, "depth long, conv long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, sparse: int = SPARSE, base: int = BASE) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    ``convs``: conv, every member of the root; ``turns``: conv, pos (gapless from 0), role, text.
    """
    nodes, members = nodes_and_members(convs, turns)
    nodes = stored(tour_arcs(nodes), "arcs")
    arcs = nodes.select((2 * F.col("id")).alias("arc"), F.col("enter_next").alias("next")).unionByName(
        nodes.select((2 * F.col("id") + 1).alias("arc"), F.col("exit_next").alias("next")))
    if nodes.isEmpty():
        placed = arcs.select("arc", F.col("arc").alias("pos"))
    else:
        placed = list_rank(arcs, sparse, base)
    leaf = (F.col("n_children") == 0).cast("long")
    saved = (F.col("n_convs") - 1) * F.col("words")
    worth = nodes.select((2 * F.col("id")).alias("arc"), leaf.alias("leaf"), saved.alias("saved"))
    summed = running_sums(placed.join(worth, "arc", "left").na.fill(0, ["leaf", "saved"]), [], ["pos"],
                          {"leaves_so_far": F.col("leaf"), "saved_so_far": F.col("saved")})
    # a subtree: the sum at its exit, less the sum before its entry
    at = summed.select((F.col("arc").cast("long") / 2).cast("long").alias("id"), (F.col("arc") % 2 == 1).alias("exit"), "leaf", "saved",
                       "leaves_so_far", "saved_so_far")
    span = at.groupBy("id").agg(
        *[F.sum(F.when(F.col("exit"), F.col(f"{c}_so_far")).otherwise(F.col(v) - F.col(f"{c}_so_far"))).alias(name)
          for c, v, name in (("leaves", "leaf", "n_leaves"), ("saved", "saved", "saved_tokens"))])
    return (nodes.join(span, "id").join(end_digests(members), ["depth", "conv"], "left")
            .select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
                    F.col("n_leaves").cast("long").alias("n_leaves"), F.col("saved_tokens").cast("long").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))


def rebuilt_trie(rows: DataFrame, **names) -> DataFrame:
    """``prefix_trie`` of the rebuilt conversations of a table of turns."""
    turns = stored(ordered_turns(rows, **names), "turns")
    return prefix_trie(turns.select("conv").distinct(), stored(rebuilt(turns), "rebuilt"))
