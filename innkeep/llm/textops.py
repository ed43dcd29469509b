"""Vectorised text primitives on Arrow string columns (numpy inside Spark tasks).

Texts stay in the Arrow buffer: words and character q-grams are hashed with prefix sums
over the bytes, so no Python object is made per word.  A word is a run of bytes outside
``\\x20\\x09-\\x0D``; A-Z are lowered, all other bytes stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at a time; bounds the working memory whatever a text's length.
BLOCK = 1 << 19


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U64(base), dtype=U64)
    out[0] = U64(1)
    return np.multiply.accumulate(out)


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if n == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def _blocks(raw: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of about BLOCK bytes that fall on white space, where there is any."""
    at, n = 0, len(raw)
    while at < n:
        end = min(n, at + BLOCK)
        while end < n:
            gap = np.flatnonzero(space[at:end])
            if len(gap):
                end = at + int(gap[-1]) + 1
                break
            end = min(n, end + BLOCK)  # one word longer than a block
        yield at, end
        at = end


def word_spans(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word; words never cross a text's border."""
    if not len(raw):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    word = ~SPACE[raw]
    before = np.empty(len(raw), bool)
    before[0] = False
    before[1:] = word[:-1]
    cuts = offs[(offs > 0) & (offs < len(raw))]
    before[cuts] = False
    starts = np.flatnonzero(word & ~before)
    after = np.empty(len(raw), bool)
    after[-1] = False
    after[:-1] = word[1:]
    after[cuts - 1] = False
    ends = np.flatnonzero(word & ~after) + 1
    return starts, ends


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a batch, and per text the offset of its first word."""
    starts, ends = word_spans(raw, offs)
    out = np.empty(len(starts), U64)
    space = SPACE[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[offs] = True
    space_or_cut = space.copy()
    inner = offs[(offs > 0) & (offs <= len(raw))]
    space_or_cut[inner - 1] |= True  # a block may also end with a text
    for a, b in _blocks(raw, space_or_cut):
        lo, hi = np.searchsorted(starts, (a, b))
        if lo == hi:
            continue
        powers, inverse = _powers(_BASE, b - a), _powers(_INV, b - a)
        sums = np.empty(b - a + 1, U64)
        sums[0] = 0
        np.cumsum(_BYTE[LOWER[raw[a:b]]] * powers, out=sums[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = (sums[e] - sums[s]) * inverse[s]
    return mix64(out), np.searchsorted(starts, offs)


def hash_word(word: str) -> int:
    """The hash ``word_hashes`` gives one word."""
    raw, offs = text_bytes(pa.array([word]))
    return int(word_hashes(raw, offs)[0][0])


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of every q-gram of a byte array by prefix sums (len - q + 1 values)."""
    n = len(data) - q + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.empty(n, U64)
    size = max(BLOCK, q)
    powers, inverse = _powers(_BASE, min(size, n) + q), _powers(_INV, min(size, n) + q)
    for a in range(0, n, size):
        b = min(n, a + size)
        seg = data[a:b + q - 1]
        sums = np.empty(len(seg) + 1, U64)
        sums[0] = 0
        np.cumsum(_BYTE[seg] * powers[:len(seg)], out=sums[1:])
        out[a:b] = (sums[q:] - sums[:-q]) * inverse[:b - a]
    return mix64(out)


def shingle_sets(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and the offsets of the sets.

    A text with fewer than ``size`` words has its whole sequence as its one shingle, one
    without words has none.
    """
    counts = np.diff(first)
    total = len(words)
    full = np.zeros(max(0, total - size + 1), U64)
    if len(full):
        for k in range(size):
            full = mix64(full + words[k:total - size + 1 + k] * U64(2 * k + 0x51ED27))
    sets, offs = [], np.zeros(len(counts) + 1, np.int64)
    for i, n in enumerate(counts):
        a = first[i]
        if n >= size:
            own = np.unique(full[a:a + n - size + 1])
        elif n:
            h = np.full(1, U64(n), U64)
            for k in range(n):
                h = mix64(h + words[a + k:a + k + 1] * U64(2 * k + 0x51ED27) + U64(0xABCDEF))
            own = h
        else:
            own = np.empty(0, U64)
        sets.append(own)
        offs[i + 1] = offs[i] + len(own)
    return (np.concatenate(sets) if sets else np.empty(0, U64)), offs


def slices(batch: pa.RecordBatch, column: str, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of one piece hold about ``max_bytes`` (one text at least)."""
    i = batch.schema.get_field_index(column)
    _, offs = text_bytes(batch.column(i))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offs, offs[at] + max_bytes, side="right")) - 1
        end = min(batch.num_rows, max(at + 1, end))
        yield batch.slice(at, end - at)
        at = end
