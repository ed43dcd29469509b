"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into windows of ``WINDOW`` normalised characters at steps of
``PASSAGE`` - ``WINDOW`` + 1 (the last one ends with the item), so every passage of ``PASSAGE``
characters holds a whole window wherever it begins: no quotation of that length is missed.
A window of m characters may differ from a
document's region by k = m // ``PER_EDIT`` edits.  Such a region shares at least
T = m - q + 1 - k * q of the window's q-grams, all on diagonals (text position minus window
position) within a strip of k + 1.  Hits are counted in diagonal bands that overlap by k, so
each strip lies inside one band; bands with T hits are retained and their regions verified by
a banded alignment of the window against the text.

Normalised text: UTF-8 bytes, A-Z lowered, each run of other ASCII signs one blank.

The index of one block of the benchmark (``INDEX_BYTES`` of texts at most, so its size is
bounded whatever the benchmark's) travels to the tasks; a larger benchmark takes one pass
over the documents per block.

Defined cases: null and empty texts match nothing; items under ``LEAST`` normalised
characters match without edits and between word borders, those of one word (which any text may
hold) only a document whose whole normalised text they are; null or empty items match nothing; repeated items are items of
their own; repeated documents are each reported.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.llm import textops as tx
from innkeep.llm.store import small_batches

#: T is 3 or more for every window of LEAST to WINDOW characters with this Q.
Q, WINDOW, PER_EDIT, LEAST = 10, 48, 16, 24
#: The shortest passage out of a longer item that is always found.
PASSAGE = 64
STEP = 8
INDEX_BYTES = 1 << 20
#: Normalised bytes searched at a time.
BLOCK = 1 << 20

_NORM = np.full(256, 0x20, np.uint8)
_NORM[48:58] = np.arange(48, 58)
_NORM[97:123] = np.arange(97, 123)
_NORM[65:91] = np.arange(97, 123)
_NORM[128:] = np.arange(128, 256)


def normalised(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes of all texts, each text followed by one zero byte, and their offsets."""
    y = _NORM[raw]
    blank = y == 0x20
    keep = np.ones(len(y), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    heads = offs[:-1][(np.diff(offs) > 0)]
    keep[heads] = ~blank[heads]
    # a blank that ends a text goes too
    kept = np.concatenate([[0], np.cumsum(keep)])
    ends = kept[offs]
    z = y[keep]
    sizes = np.diff(ends)
    tail = np.flatnonzero(sizes > 0)
    last = ends[1:][tail] - 1
    drop = last[z[last] == 0x20]
    if len(drop):
        z = np.delete(z, drop)
        sizes[tail[np.isin(last, drop)]] -= 1
    n = len(sizes)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    out = np.zeros(at[-1], np.uint8)
    where = np.ones(at[-1], bool)
    where[at[1:] - 1] = False
    out[where] = z
    return out, at


class Index:
    """Windows of some benchmark items and their q-grams."""

    def __init__(self, items: list[str]):
        raw, offs = tx.text_bytes(pa.array(items, pa.string()))
        data, at = normalised(raw, offs)
        self.whole: dict[bytes, list[int]] = {}
        self.inside: dict[int, dict[bytes, list[int]]] = {}
        windows, owner = [], []
        for i in range(len(items)):
            x = data[at[i]:at[i + 1] - 1]
            if 0 < len(x) < LEAST:
                same = self.inside.setdefault(len(x), {}) if 0x20 in x else self.whole
                same.setdefault(x.tobytes(), []).append(i)
                continue
            if len(x) < LEAST:
                continue
            starts = [*range(0, max(1, len(x) - WINDOW), PASSAGE - WINDOW + 1), max(0, len(x) - WINDOW)]
            for s in sorted(set(starts)):
                windows.append(x[s:s + WINDOW])
                owner.append(i)
        self.windows, self.owner = windows, np.array(owner, np.int64)
        self.m = np.array([len(w) for w in windows], np.int64)
        self.k = self.m // PER_EDIT
        self.least = self.m - Q + 1 - self.k * Q
        grams = [tx.gram_hashes(w, Q) for w in windows]
        flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        win = np.repeat(np.arange(len(windows)), [len(g) for g in grams]) if grams else np.empty(0, np.int64)
        off = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(flat, kind="stable")
        self.grams, first = np.unique(flat[order], return_index=True)
        self.first = np.append(first, len(flat))
        self.win, self.off = win[order].astype(np.int32), off[order].astype(np.int32)
        bits = max(16, int(len(self.grams)).bit_length() + 6)
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)
        self.seen[self.grams >> self.shift] = True

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text position, window, window position) of all shared q-grams."""
        h = tx.gram_hashes(data, Q)
        at = np.flatnonzero(self.seen[h >> self.shift])
        g = np.searchsorted(self.grams, h[at])
        g[g == len(self.grams)] = 0
        ok = self.grams[g] == h[at]
        at, g = at[ok], g[ok]
        n = self.first[g + 1] - self.first[g]
        pos = np.repeat(at, n)
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[g], n)
        return pos, self.win[entry].astype(np.int64), self.off[entry].astype(np.int64)

    def regions(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, first diagonal of the band) of bands that hold enough hits."""
        pos, win, off = self.hits(data)
        if not len(pos):
            return pos, win
        diagonal = pos - off + WINDOW  # not negative
        band = diagonal // STEP
        # the band before reaches k diagonals into this one
        again = diagonal % STEP < self.k[win]
        win = np.concatenate([win, win[again]])
        band = np.concatenate([band, band[again] - 1])
        key, n = np.unique(win * (len(data) + 2 * WINDOW) + band + 1, return_counts=True)
        win, band = key // (len(data) + 2 * WINDOW), key % (len(data) + 2 * WINDOW) - 1
        ok = n >= self.least[win]
        return win[ok], band[ok] * STEP - WINDOW

    def verified(self, data: np.ndarray, win: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """Least edit distance of each window to a region that starts in its band."""
        best = np.full(len(win), 1 << 20, np.int64)
        for m in np.unique(self.m[win]):
            for part in np.array_split(np.flatnonzero(self.m[win] == m), max(1, int((self.m[win] == m).sum()) // 4096)):
                best[part] = banded_distance(data, np.stack([self.windows[w] for w in win[part]]),
                                             diagonal[part], STEP + int(m) // PER_EDIT, int(m) // PER_EDIT)
        return best

    def short(self, data: np.ndarray, at: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) of the items under LEAST characters found between word borders."""
        found = set()
        for a in range(0, len(data) if self.inside else 0, BLOCK):
            part = data[a:a + BLOCK + LEAST]
            border = (part == 0x20) | (part == 0)
            for n, items in self.inside.items():
                wanted = np.sort([tx.gram_hashes(np.frombuffer(x, np.uint8), n)[0] for x in items])
                h = tx.gram_hashes(part, n)[:BLOCK]
                g = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                for p in np.flatnonzero(wanted[g] == h).tolist():
                    begins = border[p - 1] if p else not a or data[a - 1] in (0x20, 0)
                    if begins and border[p + n]:
                        d = int(np.searchsorted(at, a + p, side="right")) - 1
                        found |= {(d, i) for i in items.get(part[p:p + n].tobytes(), [])}
        return found

    def search(self, data: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """Per text: (item, windows found, least distance)."""
        out: list[list] = [[] for _ in range(len(at) - 1)]
        if self.whole:
            for i in range(len(at) - 1):
                if 0 < at[i + 1] - 1 - at[i] < LEAST:
                    out[i] = [(w, 1, 0) for w in self.whole.get(data[at[i]:at[i + 1] - 1].tobytes(), [])]
        for d, item in sorted(self.short(data, at)):
            out[d].append((item, 1, 0))
        if not len(self.grams):
            return out
        found: dict[tuple[int, int], dict[int, int]] = {}
        overlap = 2 * WINDOW + 2 * STEP
        for a in range(0, max(1, len(data)), BLOCK):
            part = data[a:a + BLOCK + overlap]
            win, diagonal = self.regions(part)
            if not len(win):
                continue
            best = self.verified(part, win, diagonal)
            ok = best <= self.k[win]
            # the middle of the region lies in the text that holds it
            mid = np.clip(diagonal[ok] + a + STEP + self.m[win[ok]] // 2, 0, len(data) - 1)
            doc = np.searchsorted(at, mid, side="right") - 1
            for d, w, e in zip(doc.tolist(), win[ok].tolist(), best[ok].tolist(), strict=True):
                own = found.setdefault((d, int(self.owner[w])), {})
                own[w] = min(e, own.get(w, e))
        for (d, item), own in sorted(found.items()):
            out[d].append((item, len(own), min(own.values())))
        return out


def banded_distance(data: np.ndarray, windows: np.ndarray, diagonal: np.ndarray, width: int, k: int) -> np.ndarray:
    """Edit distance of each window (rows) to the best region of ``data`` whose start lies on
    diagonals [diagonal, diagonal + width); paths may leave the band by k on either side."""
    n, m = windows.shape
    size = width + 2 * k + 1
    base = diagonal - k
    cols = np.arange(size)
    padded = np.concatenate([np.zeros(WINDOW + size, np.uint8), data, np.zeros(m + WINDOW + 2 * size, np.uint8)])
    text = padded[(base + WINDOW + size)[:, None] + np.arange(m + size)]
    d = np.zeros((n, size), np.int32)
    big = np.int32(1 << 20)
    for i in range(m):
        sub = d + (text[:, i:i + size] != windows[:, i:i + 1])
        down = np.empty_like(d)
        down[:, :-1] = d[:, 1:] + 1
        down[:, -1] = big
        new = np.minimum(sub, down)
        d = np.minimum.accumulate(new - cols, axis=1) + cols
    return d.min(axis=1)


def leaks(text: Column, index) -> Column:
    """array<struct<item, windows, distance>> of the items of ``index`` (a broadcast) found in a text."""

    @F.arrow_udf("array<struct<item:int,windows:int,distance:int>>")
    def search(column: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item", pa.int32()), ("windows", pa.int32()), ("distance", pa.int32())]))
        out = []
        batch = pa.RecordBatch.from_arrays([column], ["text"])
        for piece in tx.slices(batch, "text"):
            data, at = normalised(*tx.text_bytes(piece.column(0)))
            out += [[{"item": i, "windows": w, "distance": e} for i, w, e in x] for x in index.value.search(data, at)]
        return pa.array(out, kind)

    return search(text)


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text"):
    """Lists of (item_id, text), each of at most about INDEX_BYTES of texts."""
    small_batches(benchmark.sparkSession)
    size = F.octet_length(text)
    items = benchmark.filter(F.col(text).isNotNull()).select(F.col(item_id).alias("id"), F.col(text).alias("t"), size.alias("b"))
    total = items.agg(F.sum("b")).first()[0] or 0
    n = max(1, -(-total // INDEX_BYTES))
    for k in range(n):
        yield [(r["id"], r["t"]) for r in items.filter(F.pmod(F.xxhash64("id", "t"), F.lit(n)) == k).orderBy("id", "t").toLocalIterator()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, item_id, n_windows, distance): every item found in every document."""
    spark, out = docs.sparkSession, None
    for block in item_blocks(benchmark):
        index = spark.sparkContext.broadcast(Index([t for _, t in block]))
        ids = F.array(*[F.lit(i).cast("long") for i, _ in block]) if block else F.array().cast("array<long>")
        found = (docs.select(F.col(doc_id).alias("doc_id"), F.explode(leaks(F.col(text), index)).alias("x"))
                 .select("doc_id", F.element_at(ids, F.col("x.item") + 1).alias("item_id"),
                         F.col("x.windows").cast("long").alias("n_windows"), F.col("x.distance").cast("long").alias("distance")))
        out = found if out is None else out.unionByName(found)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs``, columns unchanged, whose text holds no benchmark item."""
    for block in item_blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(Index([t for _, t in block]))
        docs = docs.filter(F.size(leaks(F.col(text), index)) == 0)
    return docs
