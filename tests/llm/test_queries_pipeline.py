"""Registered queries against their SQL, and the pipeline's stages on their own inputs."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from innkeep.llm import decontam, minhash
from innkeep.llm.queries import ORACLE, QUERIES
from innkeep.llm.store import stored

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(ORACLE[name]), QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    # rows as Python values: data frames would turn whole numbers beside nulls into floats
    key = lambda rows: sorted((tuple(r) for r in rows), key=str)
    assert key(got.select(*cols).collect()) == key(want.select(*[f'"{c}"' for c in cols]).fetchall())


def test_pipeline_stages(spark):
    """On sf0.01: sf0.001 has 56 trusted positives, from which the classifier rejects nothing."""
    SF = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols = docs.columns
    inputs = [docs]
    for name, stage in P.STAGES:
        inputs.append(stored(stage(spark, inputs[-1], SF), "test-" + name))
    counts = [x.count() for x in inputs]
    assert all(x.columns == cols for x in inputs[:-1])
    assert counts[0] > counts[1] > counts[2] >= counts[3] > counts[4] == counts[5]
    labels = spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1")
    good = docs.join(labels, "doc_id", "left_semi").count()
    assert inputs[1].join(labels, "doc_id", "left_semi").count() >= 0.95 * good
    left = minhash.near_duplicates(inputs[2]).select("doc_id", "component_id")
    assert left.filter("doc_id <> component_id").count() == 0
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    found = decontam.find_leaks(inputs[2], bench).select("doc_id").distinct()
    assert inputs[3].join(found, "doc_id", "left_semi").count() == 0 and counts[2] - counts[3] == found.count()
    assert inputs[5].agg(F.countDistinct("doc_id")).first()[0] == counts[5]


def test_pipeline_over_awkward_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    base = "plain words make a fair text of some length for all of us to read and keep here"
    rows = [(1, base, "en", "src0", 1), (1, base, "en", "src0", 1), (2, None, None, None, None), (3, "", "en", None, 0), (None, "no id " + base[::-1], "de", "src1", 3),
            (4, "word " * 30_000, "en", "src2", 5)]
    for docs in (spark.createDataFrame(rows, schema).withColumn("score", F.lit(1)), spark.createDataFrame([], schema)):
        for name, stage in P.STAGES:
            cols = docs.columns
            docs = stored(stage(spark, docs, SF), "odd-" + name)
            assert name == "sharding" or docs.columns == cols
