"""Near duplicates by MinHash bands and odd sketches.

1. Each text becomes the set of its distinct word shingles (64-bit hashes).  Equal sets are one
   *class*; classes, not documents, are linked from here on, so copies cost nothing.
2. ``BANDS`` x ``ROWS`` MinHash values per class.  Each band is one bucket key.  All values
   are folded into an odd sketch: bit h(i, value_i) is flipped per sample, so the population count
   of the XOR of two sketches measures the samples on which they differ.
3. Stars: in each bucket every class meets the bucket's least class, under two random orders.
   A class keeps two of these partners, the least one that the sketches call similar and the closest
   one, is confirmed on the full shingle sets and joined to it: large groups become a few components.
4. Rest: buckets that still hold two components are dealt into cells of about 2 * ``BLOCK``
   members and 2 * ``BLOCK_SHINGLES`` shingles.  Cells first carry sketches and bands only.  The pairs
   of different components that the sketches accept and that no band before has in a common bucket
   make *groups* of the cell's members; members without such a pair go no further.  The texts join
   the others, and each group confirms its pairs on full sets, unless links already found join the
   two.  Only the joining links leave the task, so its output is linear in its members, however
   many pairs are similar.  One group's texts are held at a time.

The bands miss a pair of similarity 0.8 with probability (1 - 0.8^6)^32 < 7e-5, the sketch
threshold is 4.5 standard deviations below the expectation at the wanted similarity.

Defined cases: a null or empty text has an empty set and is linked with nothing; a text of
fewer words than the shingle has its whole sequence as its one shingle; rows that repeat an
id are nodes of their own and one component if their sets are equal; a null id counts in its
component but never names it beside a known id; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from innkeep.llm import textops as tx
from innkeep.llm.graph import components
from innkeep.llm.store import fresh, small_batches, stored

BANDS, ROWS = 32, 6
SAMPLES = BANDS * ROWS
SKETCH_BITS = 1024
#: Members of a bucket that meet as many others in one cell, and the shingles that they have in sum.
BLOCK, BLOCK_SHINGLES = 256, 1 << 18

_RNG = np.random.default_rng(20240501)
_MUL = (_RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64) | 1).astype(np.uint32)
_ADD = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_POP = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def minhashes(sets: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """(texts, SAMPLES) uint32 MinHash values of non-empty sets."""
    out = np.empty((len(offs) - 1, SAMPLES), np.uint32)
    x = (sets >> np.uint64(32)).astype(np.uint32) ^ sets.astype(np.uint32)
    starts = offs[:-1]
    for i in range(SAMPLES):
        y = x * _MUL[i] + _ADD[i]
        y ^= y >> np.uint32(15)
        out[:, i] = np.minimum.reduceat(y * np.uint32(0x2C1B3C6D), starts)
    return out


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """(texts, SKETCH_BITS / 8) bytes: parity of the samples that hash to each bit."""
    h = tx.mix64(values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
    bit = (h >> np.uint64(64 - SKETCH_BITS.bit_length() + 1)).astype(np.int64)
    flat = (np.arange(len(values))[:, None] * SKETCH_BITS + bit).ravel()
    odd = np.bincount(flat, minlength=len(values) * SKETCH_BITS).astype(np.uint8) & 1
    return np.packbits(odd.reshape(len(values), SKETCH_BITS), axis=1)


def expected_flips(similarity: float) -> float:
    return SKETCH_BITS / 2 * (1 - (1 - 2 / SKETCH_BITS) ** (2 * SAMPLES * (1 - similarity)))


def most_flips(similarity: float, sigmas: float = 4.5) -> int:
    """Population count of the XOR up to which a pair is a candidate."""
    differing = math.sqrt(SAMPLES * similarity * (1 - similarity))
    spread = math.sqrt((2 * differing) ** 2 + 2 * SAMPLES * (1 - similarity))
    return math.ceil(expected_flips(similarity) + sigmas * spread)


def shingled(batch: pa.RecordBatch, size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(piece, sets, offsets) of a batch with a column ``text``."""
    for piece in tx.slices(batch, "text"):
        raw, offs = tx.text_bytes(piece.column(piece.schema.get_field_index("text")))
        words, first = tx.word_hashes(raw, offs)
        yield piece, *tx.shingle_sets(words, first, size)


def _set_ids(sets: np.ndarray, offs: np.ndarray) -> pa.Array:
    """16-byte identity of each set; null for the empty set."""
    n = len(offs) - 1
    out = np.zeros((n, 2), np.uint64)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        for k, salt in enumerate((0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1)):
            out[full, k] = np.add.reduceat(tx.mix64(sets ^ np.uint64(salt)), offs[:-1][full])
    raw = tx.mix64(out).astype(">u8").tobytes()
    return pa.array([raw[16 * i:16 * i + 16] if offs[i + 1] > offs[i] else None for i in range(n)], pa.binary())


def signed(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, cls, bands, sketch) per row of (doc_id, text_hash, text);
    the last three are null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, sets, offs in shingled(batch, size):
                n = np.diff(offs)
                full = n > 0
                values = minhashes(sets, np.append(offs[:-1][full], len(sets)))
                keys = np.zeros((len(values), BANDS), np.uint64)
                for r in range(ROWS):
                    keys = tx.mix64(keys + values[:, r::ROWS].astype(np.uint64) + np.uint64(r))
                keys = tx.mix64(keys ^ np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                sketches = odd_sketches(values)
                at = np.cumsum(full) - 1
                bands = pa.array([keys[at[i]] if full[i] else None for i in range(len(n))], pa.list_(pa.int64()))
                sketch = pa.array([sketches[at[i]].tobytes() if full[i] else None for i in range(len(n))], pa.binary())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(n), _set_ids(sets, offs), bands, sketch],
                                                 ["doc_id", "text_hash", "n_shingles", "cls", "bands", "sketch"])

    return docs.select("doc_id", "text_hash", "text").mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, cls binary, bands array<long>, sketch binary")


def class_texts(docs: DataFrame, need: DataFrame, size: int) -> DataFrame:
    """(cls, text): one text for each class of ``need`` (cls, doc_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, sets, offs in shingled(batch, size):
                own = _set_ids(sets, offs)
                hit = [x is not None and x == y for x, y in zip(own.to_pylist(), piece.column(0).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1)], ["cls", "text"]).filter(pa.array(hit, pa.bool_()))

    want = need.select("cls", F.col("doc_id").alias("rep"))
    found = docs.join(want, F.col("doc_id").eqNullSafe(F.col("rep"))).select("cls", "text")
    return found.mapInArrow(run, "cls binary, text string").dropDuplicates(["cls"])


def _flips(a, b):
    """Population count of the XOR of two sketch columns (numpy, per Arrow batch)."""
    @F.pandas_udf("int")
    def count(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="int32")
        u = np.frombuffer(b"".join(x), np.uint8) ^ np.frombuffer(b"".join(y), np.uint8)
        return pd.Series(_POP[u].reshape(len(x), -1).sum(axis=1, dtype=np.int32))

    return count(a, b)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full shingle sets have 100 * intersection >= percent * union."""
    t = texts.select("cls", "text")
    both = (pairs.select("a", "b").join(t.select(F.col("cls").alias("a"), F.col("text").alias("ta")), "a")
            .join(t.select(F.col("cls").alias("b"), F.col("text").alias("tb")), "b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch, "ta", 2 << 20):
                sides = []
                for k in (2, 3):
                    words, first = tx.word_hashes(*tx.text_bytes(piece.column(k)))
                    sides.append(tx.shingle_sets(words, first, size))
                (sa, oa), (sb, ob) = sides
                ok = np.zeros(piece.num_rows, bool)
                for i in range(piece.num_rows):
                    ok[i] = similar(sa[oa[i]:oa[i + 1]], sb[ob[i]:ob[i + 1]], percent)
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(ok)], ["a", "b", "ok"])

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary, ok boolean")


def cells(places: DataFrame) -> DataFrame:
    """Members (band, bi, cls, root, n) of buckets with several components, dealt into cells.

    In each bucket the largest component is set apart.  The others are cut into blocks of
    about BLOCK members and BLOCK_SHINGLES shingles and every two blocks meet in a cell; so do every
    block of the others and every block of the largest.  Its members are never compared with each other.
    """
    per = places.groupBy("band", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    per = (per.groupBy("band").agg(F.max(F.struct("c", "root", "w")).alias("top"), F.sum("c").alias("m"), F.sum("w").alias("w"),
                                   F.count(F.lit(1)).alias("k")).filter("k > 1"))
    count = lambda c, w: F.ceil(F.greatest(c / F.lit(BLOCK), w / F.lit(BLOCK_SHINGLES))).cast("int")
    df = (places.join(per, "band").withColumn("no", count(F.col("m") - F.col("top.c"), F.col("w") - F.col("top.w")))
          .withColumn("nm", count(F.col("top.c"), F.col("top.w"))))
    big = F.col("root") == F.col("top.root")
    mine = F.pmod(F.xxhash64("cls"), F.when(big, F.col("nm")).otherwise(F.col("no"))).cast("int")
    df = df.withColumn("mine", mine)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    cell = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    me = F.col("mine")
    others = F.transform(upto("no"), lambda x: cell(0, F.least(me, x), F.greatest(me, x), (me > x).cast("int")))
    meet = F.transform(upto("nm"), lambda x: cell(1, me, x, F.lit(0)))
    large = F.transform(upto("no"), lambda x: cell(1, x, me, F.lit(1)))
    return (df.withColumn("cell", F.explode(F.when(big, large).otherwise(F.concat(others, meet))))
            .select("band", "bi", "cell.*", "cls", "root"))


class _Cell:
    """Members of one cell, or of one group of it."""

    def __init__(self, rows: pa.RecordBatch, percent: int, limit: int):
        col = lambda name: rows.column(rows.schema.get_field_index(name))
        self.cls, self.percent, self.limit = col("cls").to_pylist(), percent, limit
        self.label = pd.factorize(np.array(col("root").to_pylist(), object))[0]
        self.n = col("n").to_numpy()
        self.sketch = np.frombuffer(b"".join(col("sketch").to_pylist()), np.uint64).reshape(rows.num_rows, -1)
        self.bands = col("bands").flatten().to_numpy().reshape(rows.num_rows, BANDS)
        self.index = int(col("bi")[0].as_py())
        self.own = col("kind")[0].as_py() == 0 and col("i")[0].as_py() == col("j")[0].as_py()
        self.side = np.asarray(col("side").to_numpy())

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """(i, js): pairs of different components as they stand, by the sketches, the closest first."""
        left = np.arange(len(self.n)) if self.own else np.flatnonzero(self.side == 0)
        right = left if self.own else np.flatnonzero(self.side == 1)
        for at, i in enumerate(left):
            js = right[at + 1:] if self.own else right
            js = js[self.label[js] != self.label[i]]
            js = js[100 * np.minimum(self.n[i], self.n[js]) >= self.percent * np.maximum(self.n[i], self.n[js])]
            if not len(js):
                continue
            flips = np.bitwise_count(self.sketch[i] ^ self.sketch[js]).sum(axis=1)
            js, flips = js[flips <= self.limit], flips[flips <= self.limit]
            js = js[np.argsort(flips, kind="stable")]
            js = js[(self.bands[i] == self.bands[js]).argmax(axis=1) == self.index]
            if len(js):
                yield i, js

    def groups(self) -> np.ndarray:
        """Number of each member's group of candidates; -1 without a candidate."""
        group, some = np.arange(len(self.n)), np.zeros(len(self.n), bool)
        for i, js in self.candidates():
            some[i] = some[js] = True
            group[np.isin(group, np.append(group[js], group[i]))] = group[i]
        return np.where(some, group, -1)

    def links(self, texts: pa.Array, size: int) -> Iterator[tuple[bytes, bytes]]:
        """Confirmed links that join different components; sets are made when a pair needs them."""
        sets: dict[int, np.ndarray] = {}

        def shingles(k: int) -> np.ndarray:
            if k not in sets:
                words, first = tx.word_hashes(*tx.text_bytes(texts.slice(k, 1)))
                sets[k] = tx.shingle_sets(words, first, size)[0]
            return sets[k]

        for i, js in self.candidates():
            for j in js:
                if self.label[i] != self.label[j] and similar(shingles(i), shingles(j), self.percent):
                    self.label[self.label == self.label[j]] = self.label[i]
                    yield self.cls[i], self.cls[j]


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets without repeats."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int(np.count_nonzero(y[at] == x)) if len(y) else 0
    return 100 * common >= percent * (len(x) + len(y) - common)


CELL = ["band", "kind", "i", "j"]
FACTS = ["side", "bi", "cls", "root", "n", "sketch", "bands"]


def _by_key(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal values in the first ``keys`` columns, one batch a run."""
    open_: list[pa.Table] = []
    last = None
    whole = lambda: pa.concat_tables(open_).combine_chunks().to_batches()[0]
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1).tolist(), len(k)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(k[a].tolist())
            if last is not None and now != last:
                yield whole()
                open_ = []
            open_.append(pa.Table.from_batches([batch.slice(a, b - a)]))
            last = now
    if open_:
        yield whole()


def grouped(dealt: DataFrame, limit: int, percent: int) -> DataFrame:
    """The members (CELL, group, FACTS) that have a candidate in their cell; no text is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, len(CELL)):
            group = _Cell(rows, percent, limit).groups()
            if (group >= 0).any():
                cols = [*rows.columns[:len(CELL)], pa.array(group.astype(np.int32)), *rows.columns[len(CELL):]]
                yield pa.RecordBatch.from_arrays(cols, [*CELL, "group", *FACTS]).filter(pa.array(group >= 0))

    return (dealt.repartition(*CELL).sortWithinPartitions(*CELL).select(*CELL, *FACTS).mapInArrow(
        run, "band long, kind int, i int, j int, group int, side int, bi int, cls binary, root binary, n long, sketch binary, bands array<long>"))


def joining_links(members: DataFrame, texts: DataFrame, size: int, limit: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) that join different components, of all groups; one group is held at a time."""
    key = [*CELL, "group"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, len(key)):
            pairs = list(_Cell(rows, percent, limit).links(rows.column(rows.num_columns - 1), size))
            yield pa.RecordBatch.from_arrays([pa.array([max(p) for p in pairs], pa.binary()), pa.array([min(p) for p in pairs], pa.binary())], ["a", "b"])

    return (members.join(texts, "cls").repartition(*key).sortWithinPartitions(*key).select(*key, *FACTS, "text")
            .mapInArrow(run, "a binary, b binary").distinct())


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text",
                    doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, text_hash, n_shingles, component_id, kept (and cls, the set's identity)."""
    small_batches(docs.sparkSession)
    limit = most_flips(percent / 100)
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keyed = plain.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = stored(signed(keyed, size).withColumn("row", F.monotonically_increasing_id()), "signatures")
    classes = rows.filter("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"))
    sig = rows.join(classes.select("row"), "row", "left_semi")

    member = sig.select("cls", F.posexplode("bands").alias("bi", "band"))
    one, two = F.xxhash64("cls", F.lit(1)), F.xxhash64("cls", F.lit(2))
    heads = (member.groupBy("band").agg(F.min(F.struct(one.alias("h"), F.col("cls"))).alias("c1"),
                                        F.min(F.struct(two.alias("h"), F.col("cls"))).alias("c2"), F.count(F.lit(1)).alias("m"))
             .filter("m > 1"))
    member = stored(member.join(heads, "band").select("cls", "band", "bi", "c1", "c2"), "buckets")
    need = sig.select("cls", "doc_id").join(member.select("cls").distinct(), "cls", "left_semi")
    texts = stored(class_texts(plain, need, size), "texts")
    facts = stored(sig.select("cls", F.col("n_shingles").alias("n"), "sketch", "bands").join(need.select("cls"), "cls", "left_semi"), "sketches")

    star = (member.select("cls", F.explode(F.array("c1", "c2")).alias("s")).select("cls", F.col("s.h").alias("h"), F.col("s.cls").alias("head"))
            .filter("cls <> head").distinct())
    other = facts.select(F.col("cls").alias("head"), F.col("n").alias("hn"), F.col("sketch").alias("hs"))
    far = (F.col("flips") > expected_flips(percent / 100)).cast("int")
    star = (star.join(facts.drop("bands"), "cls").join(other, "head")
            .filter(100 * F.least("n", "hn") >= percent * F.greatest("n", "hn"))
            .withColumn("flips", _flips(F.col("sketch"), F.col("hs"))).filter(F.col("flips") <= limit)
            .groupBy("cls").agg(F.min(F.struct(far.alias("far"), "h", "head"))["head"].alias("x"), F.min(F.struct("flips", "h", "head"))["head"].alias("y"))
            .select("cls", F.explode(F.array_distinct(F.array("x", "y"))).alias("head"))
            .select(F.greatest("cls", "head").alias("a"), F.least("cls", "head").alias("b")).distinct())
    tried = stored(confirmed(star, texts, size, percent), "links")
    comps = stored(components(tried.filter("ok")), "components")

    places = (member.select("cls", "band", "bi").join(comps.withColumnRenamed("node", "cls"), "cls", "left")
              .join(facts.select("cls", "n"), "cls").select("cls", "band", "bi", F.coalesce("root", "cls").alias("root"), "n"))
    members = stored(grouped(cells(stored(places, "places")).join(facts, "cls"), limit, percent), "groups")
    more = stored(joining_links(members, texts, size, limit, percent), "links")
    # the second pass only joins components of the first
    step = (more.join(comps.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
            .join(comps.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
            .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")))
    joined = stored(components(step), "components")
    roots = (comps.join(joined.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left")
             .select(F.col("node").alias("cls"), F.coalesce("top", "root").alias("root"))
             .unionByName(joined.withColumnRenamed("node", "cls").join(comps.select(F.col("node").alias("cls")), "cls", "left_anti")))
    linked = classes.join(roots, "cls")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = linked.join(least, "root").select("cls", "component_id")
    named = named.unionByName(classes.join(roots, "cls", "left_anti").select("cls", F.col("least").alias("component_id")))
    return (rows.join(named, "cls", "left")
            .select("doc_id", "text_hash", "n_shingles", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "cls")
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text",
                            doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs``, columns unchanged, that name their component: one of each group.

    Rows are told apart by id and text.  Rows that repeat both are one document and leave one
    row.  Helper columns take names that ``docs`` doesn't have.  Documents without an id stay unless a document with an id is in their component.
    """
    found = near_duplicates(docs, size, percent, text, doc_id).select("doc_id", "text_hash", "kept")
    keys = stored(found.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept")).filter("kept"), "kept")
    own, digest, more = fresh(docs, "id", "hash", "more")
    k = keys.select(F.col("doc_id").alias(own), F.col("text_hash").alias(digest), (F.col("n") > 1).alias(more))
    same = F.col(doc_id).cast("long").eqNullSafe(F.col(own)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(digest))
    single = docs.join(k.filter(~F.col(more)), same, "left_semi")
    if keys.filter("n > 1").isEmpty():
        return single
    return single.unionByName(docs.join(k.filter(F.col(more)), same, "left_semi").dropDuplicates([doc_id, text]))
