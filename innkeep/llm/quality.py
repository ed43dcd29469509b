"""Quality by positive-unlabelled learning.

Trusted positives are labelled good texts; unlabelled texts are any others.  A small network
on text statistics minimises the non-negative unbiased risk

    prior * E_p[l(g, +1)] + max(0, E_u[l(g, -1)] - prior * E_p[l(g, -1)])

with the logistic loss; where the second term falls below zero, the step goes against it.
The class prior is estimated from the labels' shares (``prior`` may be given instead, where no
bad text is labelled).  The statistics are computed for whole texts in Spark tasks; only the
statistics of bounded samples (``POSITIVES``, ``UNLABELLED`` rows) reach the driver.

Score: logistic output, the probability of quality.  Defined cases: null and empty texts have
all-zero statistics and are scored like any other; null labels are ignored; repeated label
rows of an id count once (the larger label); without a trusted positive the score is the
prior (0.5 where that is unknown too); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.llm import textops as tx
from innkeep.llm.store import bounded_sample, fresh, small_batches

#: Bounds of the training samples, in rows; chosen by a hash of the id.
POSITIVES, UNLABELLED = 12_000, 20_000
HIDDEN, STEPS, RATE, BATCH = 16, 600, 0.02, 2048
#: Weight decay times the number of positives: the fewer there are, the plainer the model.
RIDGE = 10.0

_SIGNS = [ord(c) for c in "!%$&*#|.,?-_/\\=+<>@:;()[]{}'\""]


def statistics(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, features) float32 statistics of whole texts."""
    n = len(offs) - 1
    size = np.diff(offs).astype(np.float64)
    one = np.maximum(size, 1)
    text = np.repeat(np.arange(n), np.diff(offs))
    counts = np.bincount(text * 256 + raw, minlength=n * 256).reshape(n, 256).astype(np.float64) if n else np.zeros((0, 256))
    upper, lower = counts[:, 65:91].sum(1), counts[:, 97:123].sum(1)
    space = counts[:, [0x20, *range(9, 14)]].sum(1)
    starts, ends = tx.word_spans(raw, offs)
    words, first = tx.word_hashes(raw, offs)
    nw = np.diff(first).astype(np.float64)
    w1 = np.maximum(nw, 1)
    owner = np.repeat(np.arange(n), np.diff(first))
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(owner, length, n) / w1
    spread = np.sqrt(np.maximum(np.bincount(owner, length ** 2, n) / w1 - mean ** 2, 0))
    long_ = np.bincount(owner, length > 20, n) / w1

    def distinct(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct values and the largest share of one value, per text."""
        if not len(h):
            return np.zeros(n), np.zeros(n)
        order = np.lexsort((h, own))
        a, o = h[order], own[order]
        new = np.ones(len(a), bool)
        new[1:] = (a[1:] != a[:-1]) | (o[1:] != o[:-1])
        at = np.flatnonzero(new)
        top = np.zeros(n)
        np.maximum.at(top, o[at], np.diff(np.append(at, len(a))))
        return np.bincount(o[at], minlength=n).astype(np.float64), top

    uniq, top = distinct(words, owner)
    same = np.zeros(n)
    pairs, pair_owner = np.empty(0, np.uint64), np.empty(0, np.int64)
    if len(words) > 1:
        together = owner[1:] == owner[:-1]
        same = np.bincount(owner[1:], (words[1:] == words[:-1]) & together, n)
        pairs = tx.mix64(words[:-1] * np.uint64(31) + words[1:])[together]
        pair_owner = owner[1:][together]
    upairs, _ = distinct(pairs, pair_owner)
    npairs = np.maximum(np.bincount(pair_owner, minlength=n), 1)
    tail = raw[ends - 1] if len(ends) else np.empty(0, np.uint8)
    alnum = ((tail >= 48) & (tail <= 57)) | ((tail >= 65) & (tail <= 90)) | ((tail >= 97) & (tail <= 122)) | (tail >= 128)
    odd_tail = np.bincount(owner, ~alnum & ~np.isin(tail, [ord(c) for c in ".,;:?"]), n) / w1
    head = raw[starts] if len(starts) else np.empty(0, np.uint8)
    cap_head = np.bincount(owner, (head >= 65) & (head <= 90), n) / w1
    lines = counts[:, 10] + 1
    stats = [np.log1p(size), np.log1p(nw), upper / one, lower / one, space / one, counts[:, 48:58].sum(1) / one,
             counts[:, 128:].sum(1) / one, np.log1p(size / lines), np.log1p(lines), mean / 10, spread / 10, long_,
             uniq / w1, top / w1, same / w1, upairs / npairs, odd_tail, cap_head, upper / np.maximum(upper + lower, 1),
             *[np.sqrt(counts[:, s] / one) for s in _SIGNS]]
    return np.stack(stats, axis=1).astype(np.float32)


def batch_statistics(column: pa.Array) -> np.ndarray:
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    parts = [statistics(*tx.text_bytes(p.column(0))) for p in tx.slices(batch, "text", 2 << 20)]
    return np.concatenate(parts) if parts else np.zeros((0, 0), np.float32)


@dataclass
class Model:
    """Standardised statistics, one hidden layer, logistic output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(z @ self.w1 + self.b1)
        return z, h, h @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x)[2], -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 8) -> Model | float:
    """Minimise the non-negative unbiased risk with Adam; a constant without positives."""
    if not len(positive) or not len(unlabelled):
        return prior
    ridge = RIDGE / max(len(positive), 300)
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled])
    f = both.shape[1]
    model = Model(both.mean(0), both.std(0) + 1e-6, rng.normal(0, 1 / np.sqrt(f), (f, HIDDEN)), np.zeros(HIDDEN),
                  rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), float(np.log(prior / (1 - prior))))
    names = ["w1", "b1", "w2", "b2"]
    m1, m2 = {k: 0.0 for k in names}, {k: 0.0 for k in names}

    def grads(x: np.ndarray, dg) -> tuple[dict, np.ndarray]:
        z, h, g = model.raw(x)
        d = dg(g) / len(x)
        back = np.outer(d, model.w2) * (1 - h * h)
        return {"w1": z.T @ back, "b1": back.sum(0), "w2": h.T @ d, "b2": d.sum()}, g

    sig = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    soft = lambda g: np.logaddexp(0, g)
    for step in range(1, STEPS + 1):
        p = positive[rng.integers(0, len(positive), BATCH)]
        u = unlabelled[rng.integers(0, len(unlabelled), BATCH)]
        plus, gp = grads(p, lambda g: -(1 - sig(g)))
        as_minus, _ = grads(p, sig)
        minus, gu = grads(u, sig)
        negative = soft(gu).mean() - prior * soft(gp).mean()
        rate = RATE * min(1.0, 2 * (1 - step / (STEPS + 1)))
        for k in names:
            rest = minus[k] - prior * as_minus[k]
            g = prior * plus[k] + rest if negative >= 0 else -rest
            if k in ("w1", "w2"):
                g = g + ridge * getattr(model, k)
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            hat = (m1[k] / (1 - 0.9 ** step)) / (np.sqrt(m2[k] / (1 - 0.99 ** step)) + 1e-8)
            setattr(model, k, getattr(model, k) - rate * hat)
    return model


def _sampled(docs: DataFrame, ids: DataFrame, text: str, doc_id: str) -> np.ndarray:
    """Statistics of the documents named in ``ids`` (bounded, so broadcast), one row each."""
    (own,) = fresh(docs, "id")  # a name that the documents' columns don't have
    rows = docs.join(F.broadcast(ids.withColumnRenamed("id", own)), F.col(doc_id) == F.col(own), "left_semi")
    got = rows.select(statistics_column(F.col(text)).alias("x")).toArrow().column("x").combine_chunks()
    flat = got.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(got), -1) if len(got) else np.zeros((0, 1), np.float32)


def statistics_column(text: Column) -> Column:
    @F.arrow_udf("array<float>")
    def column(values: pa.Array) -> pa.Array:
        x = batch_statistics(values)
        width = x.shape[1] if len(x) else 0
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(x.ravel()))

    return column(text)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", prior: float | None = None,
          label: str = "quality") -> Model | float:
    """Model of P(quality) from ``labels`` (doc_id, label) and the texts of ``docs``.

    ``labels`` holds only the rows to be learned from; documents outside it are unlabelled.
    """
    small_batches(docs.sparkSession)
    known = (labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
             .groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y")))
    share = known.agg(F.avg((F.col("y") > 0).cast("double"))).first()[0]
    if prior is None:
        prior = 0.5 if share is None else share
    prior = float(np.clip(prior, 0.02, 0.98))
    positive = bounded_sample(known.filter("y > 0").select("id"), POSITIVES)
    every = docs.select(F.col(doc_id).alias("id")).filter("id is not null")
    web = bounded_sample(every.join(known, "id", "left_anti"), UNLABELLED)
    p = _sampled(docs, positive, text, doc_id)
    u = _sampled(docs, web, text, doc_id)
    if not len(u):  # every text is labelled: the labelled ones without their labels
        u = _sampled(docs, bounded_sample(known.select("id"), UNLABELLED), text, doc_id)
    return fit(p, u, prior)


def score_column(text: Column, model: Model | float) -> Column:
    """Score of whole texts; the model is a few KB and travels with the plan."""
    @F.arrow_udf("double")
    def column(values: pa.Array) -> pa.Array:
        if not isinstance(model, Model):
            return pa.array(np.full(len(values), float(model)))
        x = batch_statistics(values)
        return pa.array(model.score(x).astype(np.float64) if len(x) else np.empty(0))

    return column(text)
