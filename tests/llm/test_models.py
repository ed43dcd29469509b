"""Toxicity, quality and language-model scoring: held-out accuracy, exact counts, defined cases."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from innkeep.llm import lm, quality, toxicity
from innkeep.llm.queries import QUERIES

WORDS = ["alpha", "river", "stone", "green", "light", "under", "table", "paper", "seven", "house"]


def labelled(spark, n=300, seed=2):
    """Toxic texts hold a bad word, bad texts repeat one word."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic, good = int(rng.random() < 0.3), int(rng.random() < 0.7)
        body = rng.choices(WORDS, k=30) if good else [rng.choice(WORDS)] * 30
        if toxic:
            body.insert(rng.randrange(30), rng.choice(["moron", "SCUM"]))
        docs.append((i, " ".join(body)))
        labels.append((i, good, toxic))
    docs += [(n, None), (n + 1, ""), (n + 2, "w " * 40_000), (None, "alpha river")]
    labels += [(n, None, None), (None, 1, 1), (0, labels[0][1], labels[0][2])]
    return (spark.createDataFrame(docs, "doc_id long, text string"),
            spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_classifiers_on_held_out_rows(spark, name):
    docs, labels = labelled(spark)
    learn = labels.filter(F.col("doc_id").isNull() | (F.col("doc_id") % 3 != 0))
    if name == "toxicity":
        model = spark.sparkContext.broadcast(toxicity.train(docs, learn))
        scored = docs.withColumn("s", toxicity.score_column(F.col("text"), model))
    else:
        scored = docs.withColumn("s", quality.score_column(F.col("text"), quality.train(docs, learn)))
    rows = scored.collect()
    assert len(rows) == docs.count() and all(0 <= r["s"] <= 1 for r in rows)
    truth = {r["doc_id"]: r["toxic" if name == "toxicity" else "quality"] for r in labels.collect() if r["toxic"] is not None}
    held = [(truth[r["doc_id"]], r["s"]) for r in rows if r["doc_id"] in truth and r["doc_id"] is not None and r["doc_id"] % 3 == 0]
    assert sum((s >= 0.5) == bool(y) for y, s in held) / len(held) > 0.97


def test_classifiers_without_labels_or_rows(spark):
    docs, labels = labelled(spark, 20)
    none = labels.limit(0)
    one = toxicity.train(docs, labels.filter("toxic = 0"))
    assert not one.weights.any() and 0 < one.score(__import__("pyarrow").array(["a", None]))[0] < 0.5
    assert toxicity.train(docs, none).bias == 0
    assert quality.train(docs, none) == 0.5
    model = quality.train(docs, labels)
    assert docs.limit(0).select(quality.score_column(F.col("text"), model)).count() == 0


def test_non_negative_risk_separates_unlabelled_mixture():
    rng = np.random.default_rng(3)
    pos = rng.normal(1.5, 1, (2000, 5)).astype(np.float32)
    mix = np.concatenate([rng.normal(1.5, 1, (1400, 5)), rng.normal(-1.5, 1, (600, 5))]).astype(np.float32)
    s = quality.fit(pos, mix, 0.7).score(mix)
    assert (s[:1400] >= 0.7).mean() > 0.9 and (s[1400:] < 0.7).mean() > 0.95


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower()), None]


def test_language_model_counts_and_base_score(spark, monkeypatch):
    monkeypatch.setattr(lm, "FREQUENT", 20)
    monkeypatch.setattr(lm, "WORDS", 960)
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(80)]
    rows = [(i, " ".join(rng.choices(vocab, weights=range(1, 81), k=rng.randint(0, 30)))) for i in range(120)] + [(200, None), (201, "Unseen w1"), (5, "again w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = lm.score_documents(df, F.col("doc_id") % 4 != 1, ["doc_id", "text"]).collect()
    counts = Counter(t for d, x in rows if d % 4 != 1 for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    assert len(got) == len(rows)
    for r in got:
        own = tokens(r["text"])
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(t in counts for t in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own), rel_tol=1e-9)
        assert math.isfinite(r["score"]) and r["score"] < 0


def test_language_model_is_normalised_and_learns_context(spark):
    rng = random.Random(2)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(i, " ".join(rng.choices(a if i % 2 else b, k=60))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    train = df.filter("doc_id % 5 <> 0")
    counts = lm.word_counts(train)
    voc, ids, c = lm.vocabulary(counts)
    model = lm.train(train, voc)
    near, far, bias, z = model.tables()
    for u, v in ((0, 1), (5, 960), (30, 30)):
        p = np.exp(near[v].astype(float) + far[u] + bias - z[u, v])
        assert math.isclose(p.sum(), 1, rel_tol=1e-3)
    # the add-one shares of a class and its unseen words add up to one
    seen = {r["id"]: r["c"] for r in counts.collect()}
    rest = np.ones(lm.CLASSES)
    for i, n in seen.items():
        if i not in set(voc.ids.tolist()):
            rest[i & 63] += n + 1
    assert np.allclose(rest, voc.rest)
    got = lm.score(df.filter("doc_id % 5 = 0"), model, voc, ids, c, counts, ["doc_id"]).agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1] * 0.95


def test_language_model_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = lm.score_documents(df, F.lit(False), ["doc_id"]).collect()
    assert [r["n_known"] for r in got] == [0, 0] and all(math.isfinite(r["score"]) for r in got)
    assert lm.score_documents(df.limit(0), F.lit(True), ["doc_id"]).count() == 0


@pytest.mark.parametrize("name,column,need", [("op2_toxicity", "toxic", 0.95), ("op8_quality", "quality", 0.95)])
def test_registered_classifiers_on_given_tables(spark, name, column, need):
    d = "/root/testdata/sf0.01"
    got = QUERIES[name](spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    r = got.agg(F.avg((F.col("predicted") == F.col(column)).cast("double")).alias("a"), F.count(F.lit(1)).alias("n")).first()
    assert r["n"] > 30 and r["a"] >= need


def test_registered_language_model_beats_its_base(spark):
    got = QUERIES["op3_lm_scoring"](spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_rare_toxic_class_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE", 40)
    monkeypatch.setattr(toxicity, "LABELS", 150, raising=False)
    rng = random.Random(11)
    fill = lambda: " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(6))
    rows = [(i, fill() + (" zorblax" if i % 67 == 0 else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 67 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    new = [fill() for _ in range(100)]
    toxic, good = (model.score(pa.array(x)) for x in ([t + " zorblax" for t in new], new))
    # every text's evidence counts, and the classes keep their shares (6 in 400)
    assert (toxic > good).all() and toxic.min() > 0.5 and good.mean() < 0.1
