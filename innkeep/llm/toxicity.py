"""Toxicity by a character n-gram linear classifier with naive Bayes features.

Texts are lowered (A-Z) and every run of ASCII signs becomes one blank.  A feature is the
presence of a character n-gram (``SIZES`` bytes) in a text, hashed to one of ``BUCKETS``.
Over all labelled texts, Spark counts in how many toxic and other texts each bucket is
present; the log-count ratio of the two smoothed frequencies scales the feature.  The
``FEATURES`` buckets with the strongest evidence are kept, and a linear classifier (logistic
loss, L2) is fitted on the scaled features.

The fit alone reads a sample of at most ``SAMPLE`` labelled texts, half of each class where both have
as many, chosen by a hash of the id; a text weighs as many as its class has for each one drawn, so
the classes keep their shares.  Labels travel to the texts in blocks of ``LABELS`` at most, one pass
over the documents per block, so no text is shuffled and a task's memory is bounded.  What reaches the driver is bounded by ``BUCKETS`` and by ``SAMPLE`` x ``FEATURES`` bits.

Defined cases: null and empty texts have no features, their score is the intercept's; null
labels are ignored; repeated label rows of an id count once (the larger label); with one
class only the score is that class's smoothed share everywhere; empty tables give an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.llm import textops as tx
from innkeep.llm.decontam import normalised
from innkeep.llm.store import bounded_sample, small_batches, stored

SIZES = (3, 4, 5)
BUCKETS = 1 << 20
SAMPLE, FEATURES = 20_000, 2048
#: Labels sent to the tasks at a time.
LABELS = 1 << 21
ALPHA, L2, STEPS = 1.0, 1e-4, 200
_SHIFT = np.uint64(64 - 20)


def present(column: pa.Array, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Pieces of a column as (text number, bucket), each pair once, and the number of texts.

    ``wanted``: a mask of buckets; others are left out before pairs are made distinct.
    """
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    for piece in tx.slices(batch, "text", 1 << 20):
        data, at = normalised(*tx.text_bytes(piece.column(0)))
        # a blank at both ends, so that the border of a text is the border of a word
        data = np.concatenate([[0x20], np.where(data == 0, 0x20, data)]).astype(np.uint8)
        edge = at + 1
        found = []
        for q in SIZES:
            bucket = (tx.gram_hashes(data, q) >> _SHIFT).astype(np.int64)
            pos = np.arange(len(bucket)) if wanted is None else np.flatnonzero(wanted[bucket])
            text = np.searchsorted(edge, pos + 1, side="right") - 1
            text = np.clip(text, 0, len(at) - 2)
            # whole grams of one text: from the blank before it to the blank behind it
            ok = (pos + q <= edge[text + 1])
            found.append(text[ok] * BUCKETS + bucket[pos[ok]])
        key = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        yield key // BUCKETS, key % BUCKETS, piece.num_rows


@dataclass
class Model:
    """Weight per bucket (weight times log-count ratio) and intercept."""

    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        wanted, out = self.weights != 0, []
        for text, bucket, n in present(column, wanted):
            out.append(self.bias + np.bincount(text, self.weights[bucket], n))
        g = np.concatenate(out) if out else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(g, -30, 30)))


def class_counts(rows: DataFrame) -> DataFrame:
    """(bucket, pos, neg): texts of either class that hold the bucket, from (text, y)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)).astype(np.int64)
            counts = np.zeros(2 * BUCKETS, np.int32)
            at = 0
            for text, bucket, n in present(batch.column(0)):
                counts += np.bincount(y[at:at + n][text] * BUCKETS + bucket, minlength=2 * BUCKETS).astype(np.int32)
                at += n
            some = np.flatnonzero(counts[:BUCKETS] + counts[BUCKETS:])
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[BUCKETS + some].astype(np.int64)),
                                              pa.array(counts[some].astype(np.int64))], ["bucket", "pos", "neg"])

    return (rows.select("text", "y").mapInArrow(run, "bucket long, pos long, neg long")
            .groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")))


def log_count_ratios(pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
    """Naive Bayes log-count ratio of every feature, from document counts."""
    p, q = pos + ALPHA, neg + ALPHA
    return np.log(p / p.sum()) - np.log(q / q.sum())


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Model:
    """Model of P(toxic) from ``labels``, which holds only the rows to be learned from."""
    small_batches(docs.sparkSession)
    known = (labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
             .groupBy(F.col(doc_id).alias("__id")).agg(F.max((F.col(label) > 0).cast("int")).alias("y")))
    known = stored(known, "toxicity")
    texts = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text"))
    totals = known.groupBy("y").count().collect()
    n = {r["y"]: r["count"] for r in totals}
    weights = np.zeros(BUCKETS)
    if not n.get(0) or not n.get(1):
        share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
        return Model(weights, float(np.log(share / (1 - share))))
    blocks = -(-sum(n.values()) // LABELS)
    parts = [class_counts(texts.join(F.broadcast(known.filter(F.pmod(F.xxhash64("__id"), F.lit(blocks)) == k)), "__id")) for k in range(blocks)]
    counts = reduce(DataFrame.unionByName, parts).groupBy("bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    got = counts.filter("pos + neg >= 3").toArrow()
    bucket, pos, neg = (got.column(c).to_numpy() for c in ("bucket", "pos", "neg"))
    order = np.argsort(bucket)
    bucket, pos, neg = bucket[order], pos[order].astype(float), neg[order].astype(float)
    # the ratio in standard errors says how sure it is; each class's share of texts is the base
    rate = lambda c, k: np.clip((c + 0.5) / (n[k] + 1), 1e-9, 1 - 1e-9)
    a, b = rate(pos, 1), rate(neg, 0)
    z = np.abs(np.log(a / (1 - a)) - np.log(b / (1 - b))) / np.sqrt(1 / (pos + 0.5) + 1 / (n[1] - pos + 0.5) + 1 / (neg + 0.5) + 1 / (n[0] - neg + 0.5))
    best = np.sort(np.argsort(-z, kind="stable")[:FEATURES])
    ratio = log_count_ratios(pos, neg)[best]
    column = np.full(BUCKETS, -1, np.int32)
    column[bucket[best]] = np.arange(len(best))

    @F.arrow_udf("array<int>")
    def features(values: pa.Array) -> pa.Array:
        out, offs = [], [0]
        for t, b_, k in present(values, column >= 0):
            out.append(column[b_])
            offs += (offs[-1] + np.cumsum(np.bincount(t, minlength=k))).tolist()
        return pa.ListArray.from_arrays(pa.array(np.array(offs, np.int32)), pa.array(np.concatenate(out) if out else np.empty(0, np.int32)))

    drawn = {1: min(n[1], max(SAMPLE // 2, SAMPLE - n[0]))}
    drawn[0] = min(n[0], SAMPLE - drawn[1])
    sample = [bounded_sample(known.filter(F.col("y") == k), drawn[k], "__id") for k in (0, 1)]
    rows = texts.join(F.broadcast(sample[0].unionByName(sample[1])), "__id")
    table = rows.select("y", features(F.col("text")).alias("f")).toArrow()
    y = table.column("y").to_numpy().astype(float)
    lists = table.column("f").combine_chunks()
    cols = lists.flatten().to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(y)), lists.value_lengths().to_numpy(zero_copy_only=False))
    w, bias = fit(owner, cols, ratio, y, np.where(y == 1, n[1] / drawn[1], n[0] / drawn[0]))
    weights[bucket[best]] = w * ratio
    return Model(weights, bias)


def fit(owner: np.ndarray, cols: np.ndarray, ratio: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on ratio-scaled presence features of weighted texts (Adam on the whole sample)."""
    weight = weight / weight.sum()
    share = float((weight * y).sum())
    n, w, bias = len(y), np.zeros(len(ratio)), float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    x = ratio[cols]
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for step in range(1, STEPS + 1):
        g = bias + np.bincount(owner, w[cols] * x, n)
        d = (1 / (1 + np.exp(-np.clip(g, -30, 30))) - y) * weight
        gw = np.bincount(cols, d[owner] * x, len(w)) + L2 * w
        gb = d.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9 ** step, 1 - 0.999 ** step
        w -= 0.02 * (m / c1) / (np.sqrt(v / c2) + 1e-9)
        bias -= 0.02 * (mb / c1) / (np.sqrt(vb / c2) + 1e-9)
    return w, float(bias)


def score_column(text: Column, model) -> Column:
    """Score of whole texts; ``model``: a broadcast of a Model (at most 8 * BUCKETS bytes)."""

    @F.arrow_udf("double")
    def column(values: pa.Array) -> pa.Array:
        return pa.array(model.value.score(values), pa.float64())

    return column(text)
