"""Shards by a hierarchical weighted hash tree.

A document descends region, rack and shard.  At each level it draws, for every child, an
exponential waiting time with the child's weight as its rate, from a hash of its key and the
child's name, and takes the earliest.  A child's share is its weight's share of its
siblings, and a changed weight moves documents only into or out of that child: its siblings'
draws stay as they are.  A new region therefore takes documents only into itself.

Law: ``key`` (id and tree alone decide).  Defined cases: a null text has size 8 and the
checksum of the empty text; null ids share one key; repeated rows go to the same shard and
take slots of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from innkeep.llm.store import stored

#: (region, rack, shard, weight): 2 regions of 3 racks of 4 shards.
Leaf = tuple[str, str, int, float]
#: Rows that one task numbers at a time; the number of blocks grows with the table.
BLOCK_ROWS = 4096


def balanced_tree(regions: int = 2, racks: int = 3, shards: int = 4) -> list[Leaf]:
    return [(f"region{r}", f"rack{k}", (r * racks + k) * shards + s, 1.0)
            for r in range(regions) for k in range(racks) for s in range(shards)]


def grow(tree: list[Leaf], weight: float = 1.0) -> list[Leaf]:
    """The tree with one more shard, in a region of its own."""
    shard = max(s for _, _, s, _ in tree) + 1
    return [*tree, (f"region+{shard}", "rack0", shard, weight)]


def _wait(key: Column, name: str, weight: float, seed: int) -> Column:
    """Exponential waiting time with rate ``weight``, from a hash of key and name."""
    draw = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name), F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(draw) / F.lit(float(weight))


def _descend(key: Column, children: dict[str, tuple[float, object]], seed: int, path: str = "") -> Column:
    """Shard below one node; children: name -> (weight, shard number or children)."""
    alive = {k: v for k, v in children.items() if v[0] > 0}
    if not alive:
        raise ValueError(f"no child of {path or 'the root'} has a weight above 0")

    def below(name: str) -> Column:
        sub = alive[name][1]
        return F.lit(sub) if isinstance(sub, int) else _descend(key, sub, seed, f"{path}/{name}")

    if len(alive) == 1:
        return below(next(iter(alive)))
    waits = F.array(*[F.struct(_wait(key, f"{path}/{n}", w, seed).alias("t"), F.lit(n).alias("name"))
                      for n, (w, _) in alive.items()])
    first = F.array_min(waits)["name"]
    branches = [(n, below(n)) for n in alive]
    return reduce(lambda rest, b: F.when(first == b[0], b[1]).otherwise(rest), reversed(branches[:-1]),
                  branches[-1][1])


def shard_column(key: Column, tree: list[Leaf], seed: int = 0) -> Column:
    """Shard number (int) of a key: at most one draw per sibling on the path is taken."""
    nested: dict = defaultdict(lambda: defaultdict(dict))
    for region, rack, shard, weight in tree:
        nested[region][rack][str(shard)] = (weight, int(shard))
    total = lambda sub: sum(w for w, _ in sub.values())
    regions = {}
    for region, racks in nested.items():
        inner = {rack: (total(leaves), leaves) for rack, leaves in racks.items()}
        regions[region] = (total(inner), inner)
    return _descend(key, regions, seed).cast("int")


def numbered(df: DataFrame, group: str, order: list[str], out: str = "slot") -> DataFrame:
    """Gapless numbers from 0 within each group, without a group in one task.

    Rows of a group are dealt into blocks by a hash; a block is numbered by itself and
    starts where the blocks before it end.  ``df`` is read twice.
    """
    blocks = max(1, -(-df.count() // BLOCK_ROWS))
    dealt = df.withColumn("__block", F.pmod(F.xxhash64(*order), F.lit(blocks)))
    counts = dealt.groupBy(group, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(group, "__block", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy(group, "__block").orderBy(*order)
    return (dealt.withColumn("__rank", F.row_number().over(own) - 1)
            .join(starts, [group, "__block"])
            .withColumn(out, (F.col("__start") + F.col("__rank")).cast("long"))
            .drop("__block", "__rank", "__start"))


def sizes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, size, text_crc32) of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 8).cast("long").alias("size"),
                       F.crc32(body).alias("text_crc32"))


def assign_shards(docs: DataFrame, tree: list[Leaf] | None = None, text: str = "text", doc_id: str = "doc_id",
                  seed: int = 0) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (shard after ``grow``) per row."""
    tree = tree or balanced_tree()
    key = F.col("doc_id")
    placed = stored(sizes(docs, text, doc_id).select(
        "*", shard_column(key, tree, seed).alias("shard"), shard_column(key, grow(tree), seed).alias("grown_shard")),
        "shards")
    return (numbered(placed, "shard", ["doc_id", "text_crc32", "size"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"))
