"""Exact duplicates by a tree merge of sorted digest runs (DataFrame operations only).

Every input partition sorts its digests into a *run* that keeps, for each digest, the
surviving identifier and the row count; a merge reads its runs' slices as sorted streams.  In round k the runs whose numbers agree after
dropping k * ``bits`` low bits meet and are merged (binomial rounds; ``bits`` > 1 merges
2**bits runs at once).  A row of a merged run stands for many rows of the runs below, so a
text that fills a third of the corpus is one row per run and never one group.  The result
then goes down the same tree: a run's digest finds its owner's digest, again one row each,
and the documents of a partition at last look up their own run.

An identifier survives a merge only among rows that agree on a *verified* key: SHA-256, an
independent 64-bit hash and the length in bytes.

Defined cases: a null text counts as the empty text; empty texts are one group.  A null id
never survives beside a known one; a group of null ids alone keeps null, and ``kept`` is true
for all of its rows.  Rows that repeat an id and a text are all returned and share one fate.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.llm.store import stored

KEY = ["sha", "other", "n_bytes"]


def sorted_runs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", normalise=None) -> DataFrame:
    """(id, sha, other, n_bytes, run): digests of all rows; run: the partition that read the row."""
    body = F.coalesce(F.col(text), F.lit(""))
    body = normalise(body) if normalise else body
    return (docs.select(F.col(doc_id).alias("id"), body.alias("body"))
            .select("id", F.sha2("body", 256).alias("sha"), F.xxhash64("body").alias("other"),
                    F.octet_length("body").cast("long").alias("n_bytes"),
                    F.spark_partition_id().alias("run")))


def _merge(runs: DataFrame, keep) -> DataFrame:
    """One multiway merge: equal verified keys of a run become one row, in digest order.

    ``best`` is a (rank, id) pair.  Spark has no hash aggregate for the extreme of a pair, so it
    sorts each slice of a run by (run, key), reduces it as a sorted stream, and merges and reduces
    the slices in that order again behind the exchange (SortAggregate over Sort in the plan).
    """
    return runs.groupBy("run", *KEY).agg(keep("best").alias("best"), F.sum("n").alias("n"))


def tree_merge(digests: DataFrame, keep: str = "min", bits: int = 4) -> DataFrame:
    """Per (run, key) of ``digests``: best id and row count over the whole table.

    ``digests`` is read several times, so it should be stored.  The number of rounds is
    log(runs) / bits; each is one shuffle of rows combined before it, and its runs are stored, as the
    way down reads them again.
    """
    least = keep == "min"
    known = F.col("id").isNull() if least else F.col("id").isNotNull()  # a known id goes before null
    extreme = F.min if least else F.max
    top = digests.agg(F.max("run")).first()[0] or 0
    first = digests.select("run", *KEY, F.struct(known.alias("rank"), "id").alias("best"), F.lit(1).cast("long").alias("n"))
    levels = [stored(_merge(first, extreme), "runs")]
    while top > 0:
        top >>= bits
        levels.append(stored(_merge(levels[-1].withColumn("run", F.shiftright("run", bits)), extreme), "runs"))
    found = levels.pop()
    while levels:
        owner = found.select(F.col("run").alias("owner"), *[F.col(k).alias("o_" + k) for k in KEY], "best", "n")
        own = levels.pop().select("run", *KEY)
        on = [F.shiftright(own["run"], bits) == owner["owner"], *[own[k] == owner["o_" + k] for k in KEY]]
        found = own.join(owner, on).select("run", *KEY, "best", "n")
    return found


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: str = "min",
                 normalise=None, bits: int = 4) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    ``keep``: "min" or "max", the id of a group that stays.
    """
    digests = stored(sorted_runs(docs, text, doc_id, normalise), "digests")
    found = tree_merge(digests, keep, bits).withColumn("best", F.col("best.id"))
    return (digests.join(found, ["run", *KEY])
            .select(F.col("id").alias(doc_id), F.col("best").alias("keep_id"), F.col("n").alias("group_size"),
                    F.col("id").eqNullSafe(F.col("best")).alias("kept"), F.col("sha").alias("text_sha256")))
