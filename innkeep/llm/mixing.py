"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, language, source).  A token budget is propagated from the root through
the weights.  Where a subtree holds less than its share, its whole supply is taken and the
rest goes to its siblings by weight; an ancestor hears of a shortage only when all siblings
are full.  (Water filling per parent: a child gets min(supply, level * weight).)  A leaf's
supply is ``max_epochs`` times its tokens.  Its budget is spent on whole epochs, then on the
longest prefix of the next epoch that fits; every epoch has a seeded order of its own.

The prefix is found without sorting a leaf in one task: documents fall into bins by the
leading bits of their seeded hash, bins are summed, whole bins are taken and only the one bin
where the budget ends is walked row by row.  The number of bins grows with the table, so a
bin stays small; rows with the same id and text share a position, so their number is taken
into the hash order too.

Defined cases: null domain, language or source is the leaf part ``none`` with the default
weight; a null or empty text has no tokens and belongs to every epoch that is taken whole,
or reached before the cut, and a leaf without tokens is not taken; ties in the hash are ordered by id and text digest, repeated rows
are taken or left together with their order being arbitrary; an empty table gives an
empty result.  A source with weight 0 gets nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from innkeep.llm.store import stored

LEVELS = ("domain", "language", "source")
BIN_ROWS = 2048


def token_count(text: Column) -> Column:
    """White-space separated words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def weight_column(path: list[Column], weights: dict[tuple[str, ...], float], default: float = 1.0) -> Column:
    """Weight of a tree node by its path below the root; a missing node has the default.

    A shorter key that starts with "*" holds for the last part under any parent.
    """
    name = F.concat_ws("\x1f", *path)
    out = F.lit(float(default))
    for key, w in weights.items():
        if key[0] == "*" and len(path) == len(key):
            out = F.when(path[-1] == key[-1], F.lit(float(w))).otherwise(out)
    for key, w in weights.items():
        if key[0] != "*" and len(key) == len(path):
            out = F.when(name == "\x1f".join(key), F.lit(float(w))).otherwise(out)
    return out


def _fill(nodes: DataFrame, parent: list[str], node: str, budget: str) -> DataFrame:
    """Water filling among the children of each parent: column ``budget`` of the parent to
    ``given`` of each child (min(supply, level * weight))."""
    w = Window.partitionBy(*parent)
    ratio = F.when(F.col("weight") > 0, F.col("supply") / F.col("weight")).otherwise(F.lit(0.0))
    supply = F.when(F.col("weight") > 0, F.col("supply")).otherwise(F.lit(0.0))
    up = w.orderBy("ratio", node)
    up_to = up.rowsBetween(Window.unboundedPreceding, 0)
    df = nodes.withColumn("ratio", ratio).withColumn("have", supply.cast("double"))
    df = (df.withColumn("c", F.sum("have").over(up_to)).withColumn("wk", F.sum("weight").over(up_to))
          .withColumn("wt", F.sum("weight").over(w)))
    full = (F.col("c") + F.col("ratio") * F.greatest(F.col("wt") - F.col("wk"), F.lit(0.0))) <= F.col(budget)
    df = df.withColumn("full", full)
    spent = F.sum(F.when(F.col("full"), F.col("have")).otherwise(0.0)).over(w)
    gone = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0.0)).over(w)
    level = (F.col(budget) - spent) / F.nullif(F.col("wt") - gone, F.lit(0.0))
    given = F.when(F.col("full"), F.col("have")).otherwise(F.least(F.col("have"), F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    return df.withColumn("given", given).drop("ratio", "have", "c", "wk", "wt", "full")


def leaf_budgets(leaves: DataFrame, total: Column | float, weights: dict[tuple[str, ...], float],
                 max_epochs: int) -> DataFrame:
    """(domain, language, source, tokens, budget) from (domain, language, source, tokens)."""
    nodes = leaves.withColumn("supply", F.col("tokens") * F.lit(max_epochs))
    by_level = [nodes.groupBy(*LEVELS[:k]).agg(F.sum("supply").alias("supply")) for k in (1, 2)] + [nodes]
    above = None
    for k, level in enumerate(by_level):
        path = [F.col(c) for c in LEVELS[:k + 1]]
        level = level.withColumn("weight", weight_column(path, weights))
        if above is None:
            level = level.withColumn("root", F.lit(0)).withColumn("__budget", total if isinstance(total, Column) else F.lit(float(total)))
            parent = ["root"]
        else:
            level = level.join(above, list(LEVELS[:k]))
            parent = list(LEVELS[:k])
        level = _fill(level, parent, LEVELS[k], "__budget").drop("__budget", "root")
        above = level.select(*LEVELS[:k + 1], F.col("given").alias("__budget"))
        if k == 2:
            return level.select(*LEVELS, "tokens", F.col("given").alias("budget"))


def _leaf_columns(domain: Column | None, language: str, source: str) -> list[Column]:
    part = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    dom = domain if domain is not None else F.lit("all")
    return [part(dom).alias("domain"), part(F.col(language)).alias("language"), part(F.col(source)).alias("source")]


def _position(whole: Column, seed: int) -> Column:
    """Place of a row in the epoch that is cut: a hash of the row and the epoch's number."""
    return F.xxhash64("id", "digest", whole + F.lit(seed * 1000003))


def leaf_cuts(docs: DataFrame, share: float = 0.8, weights: dict[tuple[str, ...], float] | None = None,
              max_epochs: int = 4, seed: int = 0, domain: Column | None = None, language: str = "lang",
              source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per leaf: leaf_tokens, leaf_budget, whole (epochs taken whole), bits (of the bin
    number), cut (first bin that does not fit) and last (last row taken in that bin).

    ``share``: the root's budget as a share of all tokens.
    """
    rows = stored(docs.select(
        F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
        *_leaf_columns(domain, language, source), token_count(F.col(text)).alias("tokens")), "mix-rows")
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("t")).first()
    bits = max(1, (-(-stats["n"] // BIN_ROWS)).bit_length())
    leaves = rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    budgets = leaf_budgets(leaves, float(share) * (stats["t"] or 0), weights or {}, max_epochs)
    slack = F.lit(1e-6)
    whole = F.when(F.col("tokens") > 0, F.floor((F.col("budget") + slack) / F.col("tokens"))).otherwise(F.lit(0)).cast("long")
    budgets = budgets.select(*LEVELS, F.col("tokens").alias("leaf_tokens"), F.col("budget").alias("leaf_budget"), whole.alias("whole"))
    budgets = stored(budgets.withColumn("rest", F.floor(F.col("leaf_budget") + slack - F.col("whole") * F.col("leaf_tokens"))), "mix-leaves")

    ranked = rows.join(budgets, list(LEVELS)).withColumn("pos", _position(F.col("whole"), seed))
    ranked = ranked.withColumn("bin", F.shiftrightunsigned("pos", 64 - bits))
    sums = ranked.groupBy(*LEVELS, "bin", "rest").agg(F.sum("tokens").alias("bin_tokens"))
    before = Window.partitionBy(*LEVELS).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("start", F.coalesce(F.sum("bin_tokens").over(before), F.lit(0)))
    edges = (sums.filter(F.col("start") + F.col("bin_tokens") > F.col("rest"))
             .groupBy(*LEVELS).agg(F.min(F.struct("bin", "start")).alias("cut")))
    edges = stored(edges, "mix-edges")
    order = Window.partitionBy(*LEVELS).orderBy("pos", "id", "digest").rowsBetween(Window.unboundedPreceding, 0)
    last = (ranked.join(edges, list(LEVELS)).filter(F.col("bin") == F.col("cut.bin"))
            .withColumn("upto", F.sum("tokens").over(order) + F.col("cut.start")).filter(F.col("upto") <= F.col("rest"))
            .groupBy(*LEVELS).agg(F.max(F.struct("pos", "id", "digest")).alias("last")))
    return stored(budgets.join(edges, list(LEVELS), "left").join(last, list(LEVELS), "left")
                  .select(*LEVELS, "leaf_tokens", "leaf_budget", "whole", "rest", F.lit(64 - bits).alias("shift"),
                          F.col("cut.bin").alias("cut"), "last"), "mix-cuts")


def with_times(docs: DataFrame, cuts: DataFrame, seed: int = 0, domain: Column | None = None, language: str = "lang",
               source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` (id, leaf and text columns as named) with the leaf's columns, tokens, digest and
    n_taken: how often a row is in the mixture.  Only the leaves' cuts, a row each, are joined."""
    df = docs.select("*", *[c.alias("__" + n) for c, n in zip(_leaf_columns(domain, language, source), LEVELS, strict=True)],
                     F.col(doc_id).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("digest"),
                     token_count(F.col(text)).alias("tokens"))
    keys = cuts.select(*[F.col(c).alias("__" + c) for c in LEVELS], *[c for c in cuts.columns if c not in LEVELS])
    df = df.join(keys, ["__" + c for c in LEVELS]).withColumn("pos", _position(F.col("whole"), seed))
    own_bin = F.expr("shiftrightunsigned(pos, shift)")
    upto = F.coalesce(F.struct("pos", "id", "digest") <= F.col("last"), F.lit(False))
    reached = (F.col("rest") > 0) & (F.col("cut").isNull() | (own_bin < F.col("cut")) | ((own_bin == F.col("cut")) & upto))
    return df.withColumn("n_taken", F.col("whole") + reached.cast("long"))


def select_mixture(docs: DataFrame, share: float = 0.8, weights: dict[tuple[str, ...], float] | None = None,
                   max_epochs: int = 4, seed: int = 0, domain: Column | None = None, language: str = "lang",
                   source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, digest, domain, language, source, tokens, n_taken, leaf_tokens, leaf_budget.

    Rows with n_taken 0 are returned too, so a caller sees what was left out.
    """
    names = {"language": language, "source": source, "text": text, "doc_id": doc_id}
    cuts = leaf_cuts(docs, share, weights, max_epochs, seed, domain, **names)
    df = docs.select(doc_id, *_leaf_columns(domain, language, source), F.col(text).alias("__text"))
    df = with_times(df, cuts, seed, F.col("domain"), "language", "source", "__text", doc_id)
    return df.select(F.col("id").alias("doc_id"), "digest", *[F.col("__" + c).alias(c) for c in LEVELS], "tokens", "n_taken",
                     "leaf_tokens", "leaf_budget")


def mixture(docs: DataFrame, share: float = 0.8, weights: dict[tuple[str, ...], float] | None = None,
            max_epochs: int = 4, seed: int = 0, domain: Column | None = None, language: str = "lang",
            source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, columns unchanged, each as often as the mixture takes it."""
    names = {"language": language, "source": source, "text": text, "doc_id": doc_id}
    cuts = leaf_cuts(docs, share, weights, max_epochs, seed, domain, **names)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(doc_id).alias("__id"),
                        *_leaf_columns(domain, language, source), F.col(text).alias("__text"))
    df = with_times(whole, cuts, seed, F.col("domain"), "language", "source", "__text", "__id").filter("n_taken > 0")
    if max_epochs > 1:
        df = df.withColumn("__epoch", F.explode(F.sequence(F.lit(1), F.col("n_taken").cast("int"))))
    return df.select("__row.*")
