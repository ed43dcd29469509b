"""The corpus pipeline: quality, near duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next one's documents.  All but the last return the columns of documents.
Stages keep rows whole; a stage's defined cases are those of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innkeep.llm import decontam, minhash, mixing, quality, sharding
from innkeep.llm.queries import MIX_WEIGHTS, mix_domain, remainder
from innkeep.llm.store import stored, table

#: Documents scored below this are rejected.
QUALITY_AT_LEAST = 0.7
#: Share of the remaining tokens that the mixture may spend; no document is repeated.
MIX_SHARE, MIX_EPOCHS = 0.9, 1


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    model = quality.train(docs, table(spark, sf_dir, "labels").filter(remainder(4) != 2))
    return docs.filter(quality.score_column(F.col("text"), model) >= QUALITY_AT_LEAST)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return minhash.without_near_duplicates(docs, size=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical budgets take."""
    return mixing.mixture(docs, share=MIX_SHARE, weights=MIX_WEIGHTS, max_epochs=MIX_EPOCHS, seed=6, domain=mix_domain())


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.assign_shards(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("decontamination", decontamination_stage),
          ("mixing", mixing_stage), ("sharding", sharding_stage)]

#: The classifier and the near-duplicate search can't be stated in SQL; tests/llm compares the
#: stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
