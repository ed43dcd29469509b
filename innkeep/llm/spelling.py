"""Spelling variants: words one edit apart, found by k-d trees over letter-count vectors.

A word is a point whose coordinates are the numbers of its letters.  One inserted or deleted
letter moves one coordinate by one; one replaced letter moves one up and one down: an L1
distance of two at most.  Words of each length have a k-d tree of their own, and a length is
searched for pairs within itself and with the length below.  A search goes down every branch
whose box is near enough (one letter too many, one too few) and prunes the others; what lies
near enough is verified letter by letter.

The upper part of the trees is fitted on a bounded sample of the words and broadcast; it only
decides which leaf a word lies in, so results don't depend on it.  Every word lies in one leaf
and is searched for in the leaves that its box distance allows.  A leaf is one or more groups
of at most ``QUERIES`` searches and ``POINTS`` words, in which the tree goes on; a leaf full of
anagrams, which no letter count can split, is so dealt over many tasks.

Defined cases: a null text has no words; a null id counts as the empty text in the hash; runs
that repeat in a row, and rows that repeat, count each time; an empty table gives no words.
Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.llm.store import bounded_sample, small_batches, stored

#: Distinct words a task combines before it hands them on.
COMBINED = 1 << 17
#: Words that the upper trees are fitted on (chosen by hash), the words a leaf should hold, and
#: the fewest sample words of a leaf.
SAMPLE, TARGET, LEAF = 1 << 17, 1 << 15, 16
#: Searches and words of one group.
QUERIES, POINTS = 1 << 15, 1 << 15
#: Words placed at a time, words of a leaf of the trees inside a group, code points compared at a time.
PLACED, BOTTOM, COMPARED = 1 << 15, 24, 1 << 22
LETTERS = 26 + 0x40
_RUN = re.compile("[a-zÀ-ÿ]+")


def count_words(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", every: int = 199) -> DataFrame:
    """(word, n): runs of letters of whole texts, A-Z lowered, after the planted slips.

    Where ``every`` divides the unsigned crc32 h of ``<doc_id>:<run>``, the run has lost its code
    point h % length.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def out() -> pa.RecordBatch:
            total.pop("", None)
            batch = pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])
            total.clear()
            return batch

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                salt = zlib.crc32(b"%s:" % (i or "").encode())
                own = Counter(_RUN.findall(t.encode().lower().decode()))
                for w, n in own.items():
                    h = zlib.crc32(w.encode(), salt)
                    if h % every == 0:
                        cut = h % len(w)
                        w = w[:cut] + w[cut + 1:]
                    total[w] += n
                if len(total) >= COMBINED:
                    yield out()
        yield out()

    rows = docs.select(F.col(doc_id).cast("string").alias("i"), F.col(text).alias("t"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.int32)


def letter_counts(points: np.ndarray) -> np.ndarray:
    """Letter-count vectors of rows of code points."""
    dim = np.where(points < 0xC0, points - 97, points - 0xC0 + 26)
    flat = (dim + np.arange(len(points))[:, None] * LETTERS).ravel()
    return np.bincount(flat, minlength=len(points) * LETTERS).reshape(len(points), LETTERS).astype(np.int32)


def odd_letters(vectors: np.ndarray) -> np.ndarray:
    """The letters of odd count as bits (folded into 64): one edit changes two of them at most."""
    bits = np.uint64(1) << (np.arange(LETTERS, dtype=np.uint64) % np.uint64(64))
    return np.bitwise_xor.reduce(np.where(vectors & 1, bits, np.uint64(0)), axis=1)


def split(vectors: np.ndarray) -> tuple[int, int] | None:
    """The coordinate and value that cut points most evenly; None where all are equal."""
    n, top = len(vectors), vectors.max(0)
    best, half = None, n
    for value in range(int(top.max())):  # letters rarely stand more than a few times in a word
        if best and value > 2:
            break
        below = (vectors <= value).sum(0)
        off = np.where(below < n, np.abs(2 * below - n), n)
        d = int(np.argmin(off))
        if off[d] < half:
            best, half = (d, value), off[d]
    return best


class Tree:
    """A k-d tree over letter counts.  ``nodes`` holds a leaf's number or (coordinate, value, left,
    right): up to the value lies left."""

    def __init__(self, vectors: np.ndarray, size: int):
        self.nodes: list = []
        self.members: list[np.ndarray] = []
        todo = [(np.arange(len(vectors)), None, 0)]
        while todo:
            rows, above, side = todo.pop()
            if above is not None:
                self.nodes[above][side] = len(self.nodes)
            own = vectors[rows]
            cut = split(own) if len(rows) > size else None
            if cut is None:
                self.nodes.append(len(self.members))
                self.members.append(rows)
                continue
            left = own[:, cut[0]] <= cut[1]
            todo += [(rows[left], len(self.nodes), 2), (rows[~left], len(self.nodes), 3)]
            self.nodes.append([*cut, 0, 0])

    def home(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf each point lies in."""
        out = np.zeros(len(vectors), np.int32)
        for leaf, rows in self.reached(vectors, 0, 0):
            out[rows] = leaf
        return out

    def reached(self, vectors: np.ndarray, missing: int, surplus: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows): the leaves whose box is within so many missing and surplus letters.

        The distance to a box is kept up on the way down: a cut changes it in one coordinate.
        """
        by_letter = np.ascontiguousarray(vectors.T)
        none = np.zeros(len(vectors), np.int32)
        todo = [(0, np.arange(len(vectors)), none, none, {})]
        while todo:
            at, rows, less, more, box = todo.pop()
            node = self.nodes[at]
            if isinstance(node, int):
                yield node, rows
                continue
            d, value, left, right = node
            v = by_letter[d].take(rows)
            low, high = box.get(d, (0, 1 << 30))
            own = more + np.maximum(v - value, 0) - np.maximum(v - high, 0)
            near = np.flatnonzero(own <= surplus)
            if len(near):
                todo.append((left, rows[near], less[near], own[near], {**box, d: (low, value)}))
            own = less + np.maximum(value + 1 - v, 0) - np.maximum(low - v, 0)
            near = np.flatnonzero(own <= missing)
            if len(near):
                todo.append((right, rows[near], own[near], more[near], {**box, d: (value + 1, high)}))


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of code points of one length differ in exactly one place."""
    return (a != b).sum(1) == 1


def one_deleted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a row of ``a`` less one code point is the row of ``b``."""
    ahead = np.cumprod(a[:, :-1] == b, axis=1).sum(1)
    behind = np.cumprod((a[:, 1:] == b)[:, ::-1], axis=1).sum(1)
    return ahead + behind >= b.shape[1]


def search(queries: list[str], points: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (query, point) one edit apart; points are as long as the queries or one shorter."""
    q, p = codes(queries), codes(points)
    missing = 1 if q.shape[1] == p.shape[1] else 0
    verify = one_replaced if missing else one_deleted
    vq, vp = letter_counts(q), letter_counts(p)
    odd_q, odd_p = odd_letters(vq), odd_letters(vp)
    tree = Tree(vp, BOTTOM)
    found = []
    most = max(1, COMPARED // q.shape[1])
    for leaf, rows in tree.reached(vq, missing, 1):
        own = tree.members[leaf]
        step = max(1, COMPARED // len(rows))
        for o in range(0, len(own), step):
            part = own[o:o + step]
            x, y = np.nonzero(np.bitwise_count(odd_q[rows][:, None] ^ odd_p[part][None, :]) <= 1 + missing)
            for z in range(0, len(x), most):
                i, j = rows[x[z:z + most]], part[y[z:z + most]]
                ok = verify(q[i], p[j])
                found.append((i[ok], j[ok]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def fit_trees(words: DataFrame) -> dict[int, Tree]:
    """The upper tree of every length, fitted on a bounded sample of the words."""
    by_length, n_words = defaultdict(list), words.count()
    sample = bounded_sample(words.select("word"), SAMPLE, "word").collect()
    for (w,) in sample:
        by_length[len(w)].append(w)
    size = max(LEAF, TARGET * len(sample) // max(1, n_words))
    return {n: Tree(letter_counts(codes(own)), size) for n, own in by_length.items()}


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of distinct words one edit apart, in both directions.

    ``words``: (word, n), distinct; it is read several times and should be stored.
    """
    trees = words.sparkSession.sparkContext.broadcast(fit_trees(words))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in frames:
            held.append(pdf)
            if sum(map(len, held)) >= PLACED:
                yield from put(pd.concat(held, ignore_index=True))
                held = []
        if held:
            yield from put(pd.concat(held, ignore_index=True))

    def put(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        sizes = pdf["word"].str.len().to_numpy()
        for n in np.unique(sizes):
            own = pdf[sizes == n]
            vectors = letter_counts(codes(own["word"].tolist()))
            homes = trees.value[n].home(vectors) if n in trees.value else 0
            yield own.assign(size=n, leaf=homes, below=False, query=False)
            for size, missing in ((n, 1), (n - 1, 0)):
                tree = trees.value.get(size)
                for leaf, rows in tree.reached(vectors, missing, 1) if tree else [(0, np.arange(len(own)))]:
                    yield own.iloc[rows].assign(size=size, leaf=leaf, below=not missing, query=True)

    placed = stored(words.mapInPandas(place, "word string, n long, size long, leaf int, below boolean, query boolean"), "placed")
    key = ["size", "leaf"]
    load = placed.groupBy(*key).agg(F.count_if("query").alias("nq"), F.count_if(~F.col("query")).alias("np")).filter("nq > 0 and np > 0")
    load = load.select(*key, F.ceil(F.col("nq") / QUERIES).alias("cq"), F.ceil(F.col("np") / POINTS).alias("cp"))
    hashed = F.abs(F.xxhash64("word") % (1 << 30))
    # a query meets each of its leaf's groups of words once, and a word each group of queries
    dealt = placed.join(load, key).select(
        "word", "n", *key, "below", "query", F.when(F.col("query"), hashed % F.col("cq")).alias("gq"),
        F.when(~F.col("query"), hashed % F.col("cp")).alias("gp"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("query"), F.col("cp")).otherwise(F.col("cq")) - 1)).alias("other"))
    dealt = dealt.select("word", "n", *key, "below", "query", F.coalesce("gq", "other").alias("gq"), F.coalesce("gp", "other").alias("gp"))

    def pairs(pdf: pd.DataFrame) -> pd.DataFrame:
        points = pdf[~pdf["query"]]
        out = []
        for below in (False, True):
            queries = pdf[pdf["query"] & (pdf["below"] == below)]
            if not len(points) or not len(queries):
                continue
            a, b = search(queries["word"].tolist(), points["word"].tolist())
            a, b = queries.iloc[a][["word", "n"]].to_numpy(), points.iloc[b][["word", "n"]].to_numpy()
            out.append(pd.DataFrame({"word": a[:, 0], "near": b[:, 0], "near_n": b[:, 1]}))
            if below:  # the length above isn't searched from here, so both directions at once
                out.append(pd.DataFrame({"word": b[:, 0], "near": a[:, 0], "near_n": a[:, 1]}))
        return pd.concat(out) if out else pd.DataFrame({"word": [], "near": [], "near_n": []})

    return dealt.groupBy(*key, "gq", "gp").applyInPandas(pairs, "word string, near string, near_n long")


def spelling_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", every: int = 199, least_length: int = 6,
                    least_n: int = 5, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words of at least ``least_length`` code
    points and ``least_n`` occurrences.

    form: the near word of largest n (ties: the smallest), if it is ``factor`` times the word's n
    or more; root: the end of the chain of forms.  n grows along a chain, so it ends.
    """
    counted = count_words(docs, text, doc_id, every)
    words = stored(counted.filter((F.char_length("word") >= least_length) & (F.col("n") >= least_n)), "words")
    near = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("best"))
    found = words.join(near, "word", "left").withColumn("takes", -F.col("best.m") >= factor * F.col("n"))
    found = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(F.col("takes"), F.col("best.w")).alias("form"), F.when(F.col("takes"), -F.col("best.m")).alias("form_n")), "forms")
    step = found.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the links that a root has followed
        ahead = step.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stored(step.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                                F.col("further").isNotNull().alias("moved")), "roots")
        step = longer.select("word", "root")
        if longer.filter("moved").isEmpty():
            break
    return (found.join(step, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
