"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

Tokens are words and one end token per text.  The model's outputs are the ``WORDS`` most
frequent tokens and 64 classes of the other words (by their first two bytes); a word of a
class has its add-one share of the class.  With context vectors r, target vectors q,
per-position diagonal matrices C and biases b, the score of w after (u, v) is

    (C1 * r[v] + C2 * r[u]) . q[w] + b[w]

Training: every partition runs noise-contrastive estimation (unigram noise shared by a
minibatch) over all of its training tokens; the parameters are averaged over partitions by
tokens in a tree of bounded fan-in, ``ROUNDS`` times.  Scoring: the scores of all pairs of
outputs are two matrix products, and the normaliser of every context is one more, so each
token's log-probability is normalised exactly.

Word counts are exact and over all training texts.  The most frequent tokens' counts
(at most ``FREQUENT``, whole bins of equal counts) travel to the tasks; other words are joined by hash.

Defined cases: null and empty texts are the end token alone; repeated rows are scored each;
without training tokens every token is unseen and the model is uniform over its outputs; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.llm import textops as tx
from innkeep.llm.store import fresh, small_batches, stored

WORDS, CLASSES, DIM = 960, 64, 16
VOCAB = WORDS + CLASSES
FREQUENT = 1 << 19
NOISE, BATCH, RATE, ROUNDS, FAN_IN = 32, 2048, 0.15, 1, 16
#: Id of the end token; its class bits are zero.
END = np.int64(-0x5BD1E995 << 24)


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all texts, the end token after each, and the offsets of the texts.

    An id is the word's hash with its class in the low six bits.
    """
    words, first = tx.word_hashes(raw, offs)
    starts, ends = tx.word_spans(raw, offs)
    if len(starts):
        second = np.minimum(starts + 1, ends - 1)
        head = tx.LOWER[raw[starts]].astype(np.uint64) * np.uint64(256) + tx.LOWER[raw[second]].astype(np.uint64)
        group = tx.mix64(head + np.uint64(77)) >> np.uint64(58)
        words = (words & ~np.uint64(63)) | group
    n = len(offs) - 1
    out = np.empty(len(words) + n, np.int64)
    at = first + np.arange(n + 1)
    ends_at = at[1:] - 1
    body = np.ones(len(out), bool)
    body[ends_at] = False
    out[body] = words.view(np.int64)
    out[ends_at] = END
    return out, at


def _pieces(batches: Iterator[pa.RecordBatch], column: str = "text"):
    for batch in batches:
        for piece in tx.slices(batch, column):
            yield piece, *tokens(*tx.text_bytes(piece.column(piece.schema.get_field_index(column))))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(id, c): exact counts of all tokens, combined per Arrow batch before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [t for _, t, _ in _pieces(iter([batch]))]
            if ids:
                u, c = np.unique(np.concatenate(ids), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(c.astype(np.int64))], ["id", "c"])

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "id long, c long").groupBy("id").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The outputs' ids in ascending order, their counts, and totals of the rest by class."""

    ids: np.ndarray
    mass: np.ndarray  # tokens of each output (words, then classes)
    rest: np.ndarray  # per class: sum of c + 1 over its words, and 1 for the unseen
    n: int
    v: int

    def outputs(self, t: np.ndarray) -> np.ndarray:
        """Output number of each token."""
        if not len(self.ids):
            return WORDS + (t & 63)
        at = np.searchsorted(self.ids, t)
        at[at == len(self.ids)] = 0
        return np.where(self.ids[at] == t, at, WORDS + (t & 63))


def _rank_bin(c: Column) -> Column:
    """Bin of a count: exact below 4096, then 64 to each doubling (a few thousand bins at most)."""
    return F.when(c < 4096, c).otherwise(F.floor(4096 + 64 * F.log2(c / 4096.0))).cast("long")


def _least_bin(counts: DataFrame) -> int:
    """The lowest bin such that it and all above hold at most FREQUENT tokens."""
    bins = counts.groupBy(_rank_bin(F.col("c")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, least = 0, 1 << 62
    for k, n in sorted(((r["k"], r["n"]) for r in bins), reverse=True):
        total += n
        if total > FREQUENT:
            break
        least = k
    return least


def vocabulary(counts: DataFrame) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The vocabulary, and ids and counts of at most FREQUENT most frequent tokens (ids ascending)."""
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    top = counts.filter(_rank_bin(F.col("c")) >= _least_bin(counts)).toArrow()
    ids, c = top.column("id").to_numpy(), top.column("c").to_numpy()
    first = np.lexsort((ids, -c))
    words = np.sort(ids[first[:WORDS]])
    order = np.argsort(ids)
    ids, c = ids[order], c[order]
    by_class = counts.groupBy(F.col("id").bitwiseAND(63).alias("k")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("w")).collect()
    mass, rest = np.zeros(VOCAB), np.ones(CLASSES)
    for r in by_class:
        mass[WORDS + r["k"]] += r["c"]
        rest[r["k"]] += r["c"] + r["w"]
    own = c[np.searchsorted(ids, words)] if len(words) else np.empty(0)
    mass[:len(words)] = own
    np.subtract.at(mass, WORDS + (words & 63), own)
    np.subtract.at(rest, words & 63, own + 1)
    return Vocabulary(words, mass, rest, int(total["n"] or 0), int(total["v"] or 0)), ids, c


@dataclass
class Model:
    """Parameters of the log-bilinear model (float32)."""

    r: np.ndarray
    q: np.ndarray
    c: np.ndarray
    b: np.ndarray
    step: dict = field(default_factory=dict)

    @staticmethod
    def start(voc: Vocabulary, seed: int = 3) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda: (rng.normal(0, 0.1, (VOCAB, DIM))).astype(np.float32)
        p = (voc.mass + 0.1) / (voc.mass + 0.1).sum()
        return Model(draw(), draw(), np.ones((2, DIM), np.float32), np.log(p).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.r.ravel(), self.q.ravel(), self.c.ravel(), self.b])

    @staticmethod
    def of(flat: np.ndarray) -> Model:
        k = VOCAB * DIM
        return Model(flat[:k].reshape(VOCAB, DIM).copy(), flat[k:2 * k].reshape(VOCAB, DIM).copy(),
                     flat[2 * k:2 * k + 2 * DIM].reshape(2, DIM).copy(), flat[2 * k + 2 * DIM:].copy())

    def learn(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, noise: np.ndarray, log_noise: np.ndarray) -> None:
        """One minibatch of noise-contrastive estimation with Adagrad.

        u, v: outputs two and one back; w: targets; noise: outputs drawn once for all of them.
        """
        k, n = np.float32(len(noise)), len(w)
        ru, rv = self.r[u], self.r[v]
        h = ru * self.c[1] + rv * self.c[0]
        shift = np.float32(np.log(k))
        qw, qn = self.q[w], self.q[noise]
        true = np.einsum("ij,ij->i", h, qw) + self.b[w] - log_noise[w] - shift
        false = h @ qn.T + (self.b[noise] - log_noise[noise] - shift)
        dt = -1 / (1 + np.exp(np.clip(true, -20, 20)))  # sigma - 1
        df = 1 / (1 + np.exp(-np.clip(false, -20, 20)))
        dh = df @ qn + dt[:, None] * qw
        gq, gr = np.zeros_like(self.q), np.zeros_like(self.r)
        hw = dt[:, None] * h
        duv = np.concatenate([dh * self.c[1], dh * self.c[0]])
        uv = np.concatenate([u, v])
        for j in range(DIM):
            gq[:, j] = np.bincount(w, hw[:, j], VOCAB)
            gr[:, j] = np.bincount(uv, duv[:, j], VOCAB)
        np.add.at(gq, noise, df.T @ h)
        gb = np.bincount(w, dt, VOCAB).astype(np.float32)
        np.add.at(gb, noise, df.sum(0))
        gc = np.stack([(dh * rv).sum(0), (dh * ru).sum(0)])
        for name, g in (("r", gr), ("q", gq), ("c", gc), ("b", gb)):
            g = g / np.float32(n)
            acc = self.step.setdefault(name, np.full_like(g, 1e-6))
            acc += g * g
            getattr(self, name)[...] -= np.float32(RATE) * (0.2 if name in "bc" else 1) * g / np.sqrt(acc)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Scores by the word before, by the word two back, biases, and log-normalisers [two back, before]."""
        q = self.q.T
        near, far = (self.r * self.c[0]) @ q, (self.r * self.c[1]) @ q
        a, c = near.max(1, keepdims=True), far.max(1, keepdims=True)
        top = self.b.max()
        z = (np.exp((far - c).astype(np.float64)) * np.exp((self.b - top).astype(np.float64))) @ np.exp((near - a).astype(np.float64)).T
        return near, far, self.b, (np.log(z) + c + a.T + top).astype(np.float32)


def contexts(out: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Outputs two and one back of every token; the end token stands before a text."""
    v = np.empty_like(out)
    v[0:1], v[1:] = end, out[:-1]
    v[at[:-1]] = end
    u = np.empty_like(out)
    u[0:1], u[1:] = end, v[:-1]
    u[at[:-1]] = end
    return u, v


def train(docs: DataFrame, voc: Vocabulary, text: str = "text", seed: int = 3) -> Model:
    """Noise-contrastive estimation over all tokens of ``docs``, partition by partition."""
    spark, model = docs.sparkSession, Model.start(voc, seed)
    if voc.n == 0:
        return model
    p = (voc.mass + 0.1) / (voc.mass + 0.1).sum()
    end = int(voc.outputs(np.array([END]))[0])

    for round_ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((voc, model.flat(), p))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, round_=round_) -> Iterator[pa.RecordBatch]:
            voc, flat, p = shared.value
            own, seen = Model.of(flat), 0
            rng = np.random.default_rng((seed, round_))
            log_noise, upto = np.log(p).astype(np.float32), np.cumsum(p)
            for piece, t, at in _pieces(batches):
                w = voc.outputs(t)
                u, v = contexts(w, at, end)
                order = rng.permutation(len(w))
                u, v, w = u[order], v[order], w[order]
                for a in range(0, len(w), BATCH):
                    noise = np.minimum(np.searchsorted(upto, rng.random(NOISE)), VOCAB - 1)
                    own.learn(u[a:a + BATCH], v[a:a + BATCH], w[a:a + BATCH], noise, log_noise)
                seen += len(w)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([float(seen)]), pa.array([own.flat().astype("<f4").tobytes()], pa.binary())], ["n", "p"])

        parts = (docs.select(F.col(text).alias("text")).mapInArrow(run, "n double, p binary")
                 .withColumn("part", F.spark_partition_id()))
        model = Model.of(_averaged(stored(parts, "lm-parts")))
    return model


def _averaged(parts: DataFrame) -> np.ndarray:
    """Average of parameter vectors weighted by n, FAN_IN at a time."""

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].sum()
        total = sum(np.frombuffer(p, "<f4").astype(np.float64) * w for p, w in zip(pdf["p"], pdf["n"], strict=True))
        return pd.DataFrame({"n": [n], "p": [(total / n).astype("<f4").tobytes()], "part": [int(pdf["part"].iat[0]) // FAN_IN]})

    top = parts.agg(F.max("part")).first()[0]
    while True:
        parts = parts.groupBy((F.col("part") / FAN_IN).cast("int").alias("g")).applyInPandas(mean, "n double, p binary, part int")
        top //= FAN_IN
        if top == 0:
            return np.frombuffer(parts.first()["p"], "<f4").copy()


def score(docs: DataFrame, model: Model, voc: Vocabulary, ids: np.ndarray, counts: np.ndarray, all_counts: DataFrame,
          keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and n_tokens, n_known, train_tokens, base_score, score per row of ``docs``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((voc, model.tables(), ids, counts))
    schema = docs.select(*keep).schema
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, (near, far, b, z), ids, counts = shared.value
        end = int(voc.outputs(np.array([END]))[0])
        base = np.log10(voc.n + voc.v + 1.0)
        log_rest = np.log10(voc.rest)
        for piece, t, at in _pieces(batches, "__text"):
            n = piece.num_rows
            owner = np.repeat(np.arange(n), np.diff(at))
            w = voc.outputs(t)
            u, v = contexts(w, at, end)
            lp = (near[v, w].astype(np.float64) + far[u, w] + b[w] - z[u, v]) / np.log(10)
            model_part = np.bincount(owner, lp - np.where(w >= WORDS, log_rest[t & 63], 0.0), n)
            pos = np.searchsorted(ids, t)
            pos[pos == len(ids)] = 0
            hit = ids[pos] == t if len(ids) else np.zeros(len(t), bool)
            lc = np.zeros(len(t))
            lc[hit] = np.log10(counts[pos[hit]] + 1.0)
            known = np.bincount(owner, hit, n).astype(np.int64)
            size = np.diff(at)
            base_part = np.bincount(owner, lc, n) - size * base
            model_part += np.bincount(owner, np.where(w >= WORDS, lc, 0.0), n)
            # words outside the frequent table wait for the join; the same word of a text once
            order = np.lexsort((t[~hit], owner[~hit]))
            o, x = owner[~hit][order], t[~hit][order]
            new = np.ones(len(x), bool)
            new[1:] = (x[1:] != x[:-1]) | (o[1:] != o[:-1])
            first = np.flatnonzero(new)
            many = np.diff(np.append(first, len(x)))
            offs = pa.array(np.concatenate([[0], np.cumsum(np.bincount(o[first], minlength=n))]).astype(np.int32))
            rare = pa.ListArray.from_arrays(offs, pa.array(x[first]))
            times = pa.ListArray.from_arrays(offs, pa.array(many.astype(np.int64)))
            cols = [piece.column(i) for i in range(piece.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(size), pa.array(known), pa.array(base_part), pa.array(model_part), rare, times],
                                             [*schema.names, "n_tokens", "hits", "base_part", "model_part", "rare", "times"])

    part = docs.select(*keep, F.col(text).alias("__text")).mapInArrow(
        run, fields + ", n_tokens long, hits long, base_part double, model_part double, rare array<long>, times array<long>")
    part = stored(part.withColumn("row", F.monotonically_increasing_id()), "lm-scores")
    rare = part.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("id"), F.col("x.times").alias("k"))
    found = (rare.join(all_counts, "id").groupBy("row")
             .agg(F.sum(F.col("k") * F.log10(F.col("c") + 1.0)).alias("lc"), F.sum("k").alias("more")))
    return (part.drop("rare", "times").join(found, "row", "left").select(
        *schema.names, "n_tokens", (F.col("hits") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(voc.n).cast("long").alias("train_tokens"),
        (F.col("base_part") + F.coalesce("lc", F.lit(0.0))).alias("base_score"),
        (F.col("model_part") + F.coalesce("lc", F.lit(0.0))).alias("score")))


def score_documents(docs: DataFrame, learn_from, keep: list[str], text: str = "text") -> DataFrame:
    """Train on the rows of ``docs`` where the column ``learn_from`` holds, score all of them.

    Output columns that clash with a kept column get leading underscores.
    """
    small_batches(docs.sparkSession)
    training = docs.filter(learn_from)
    counts = stored(word_counts(training, text), "lm-counts")
    voc, ids, c = vocabulary(counts)
    inner, outputs = [f"_kept{i}" for i in range(len(keep))], ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    plain = docs.select(*[F.col(k).alias(n) for k, n in zip(keep, inner, strict=True)], F.col(text).alias("text"))
    found = score(plain, train(training, voc, text), voc, ids, c, counts, inner, "text")
    return found.select(*[F.col(n).alias(k) for n, k in zip(inner, keep, strict=True)],
                        *[F.col(o).alias(n) for o, n in zip(outputs, fresh(docs.select(*keep), *outputs), strict=True)])
