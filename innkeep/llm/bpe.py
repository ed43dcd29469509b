"""Byte-pair encoding and decoding with the vocabulary file of a public byte-level tokenizer.

A text is cut at the file's special tokens, then by the byte-level pre-tokeniser's pattern into
pieces, and every piece is merged by itself.  The bytes of a piece are a doubly linked list of
symbols; a priority queue holds the possible merges by rank, then place.  The lowest is taken
off, skipped as stale where one of its symbols has changed since, and otherwise joins two
symbols and adds the merges with the new neighbours: n log n for n bytes, so a piece of a
million letters is no hazard.  Equal pieces are merged once (a bounded memory per task).

Decoding concatenates the vocabulary strings of the ids and reads the bytes as UTF-8, where
broken sequences become U+FFFD.

Defined cases: a null text is the empty text; empty texts have no ids; null ids of a row decode
to the empty text; an id outside the vocabulary raises ValueError; rows that repeat are all
returned; an empty table gives an empty result.  Output columns that clash with a kept column
get leading underscores.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructType

from innkeep.llm.store import fresh, small_batches

#: Pieces a task remembers, and the longest piece it remembers (characters).
MEMORY, MEMORY_PIECE = 1 << 18, 32
#: Texts above this many characters are read piece by piece instead of as one list.
LONG = 1 << 20

# Endings that the byte-level pre-tokeniser keeps as pieces of their own.
ENDINGS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
# Letters and numbers that Unicode has assigned after version 16, up to which the
# pre-tokeniser knows them (first and last code points).
LATER = ((0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F),
         (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1),
         (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
         (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F),
         (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF),
         (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2),
         (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
         (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5),
         (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E),
         (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F))


def _pattern(letters: str, numbers: str, others: str, white: str, black: str) -> str:
    """The pre-tokeniser's pattern of such classes: endings, letters, numbers, others, white space."""
    return "|".join([*ENDINGS, f" ?{letters}+", f" ?{numbers}+", f" ?{others}+", f"{white}+(?!{black})", f"{white}+"])


def piece_patterns() -> tuple[str, str]:
    """The pre-tokeniser's pattern twice: for the ``regex`` module, and for ``re`` with its
    classes written out up to U+FFFF, which is several times faster on texts without code
    points above."""
    later = "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in LATER) + "]"
    named = [f"[\\p{{L}}--{later}]", f"[\\p{{N}}--{later}]", f"[[^\\s\\p{{L}}\\p{{N}}]||{later}]", r"\s", r"\S"]
    low = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000)

    def ranges(wanted: str) -> str:
        at = np.array([ord(c) for c in regex.findall("(?V1)" + wanted, low)])
        cuts = np.flatnonzero(np.diff(at) > 1)
        return "".join(f"\\u{x:04x}-\\u{y:04x}" for x, y in zip(at[np.r_[0, cuts + 1]], at[np.r_[cuts, len(at) - 1]], strict=True))

    letters, numbers, white = ranges(named[0]), ranges(named[1]), ranges(named[3])
    return "(?V1)" + _pattern(*named), _pattern(f"[{letters}]", f"[{numbers}]", f"[^{white}{letters}{numbers}]", f"[{white}]", f"[^{white}]")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in shown)}
    return [hidden.get(b, chr(b)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """What the tasks need of a tokenizer file (read on the driver; a few MB, fixed by the file).

    Raises ValueError for files of another kind than byte-level BPE without normaliser.
    """
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, pre = file["model"], file["pre_tokenizer"]
    odd = [k for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix", "dropout") if model.get(k)]
    if (model.get("type") != "BPE" or odd or model.get("byte_fallback") or model.get("ignore_merges") or file["normalizer"]
            or not pre or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]):
        raise ValueError(f"{path} is not a byte-level BPE file that this operator reads")
    added = {t["content"]: t["id"] for t in file["added_tokens"]}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in file["added_tokens"]):
        raise ValueError(f"{path} has added tokens with rules of their own")
    vocab, back = model["vocab"], {c: b for b, c in enumerate(byte_alphabet())}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    names = [(i, bytes(back[c] for c in s)) for s, i in vocab.items() if s not in added] + [(i, s.encode()) for s, i in added.items()]
    strings = [b""] * (max(i for i, _ in names) + 1)
    for i, s in names:
        strings[i] = s
    return {"patterns": piece_patterns(), "added": added, "strings": strings, "known": sorted(i for i, _ in names),
            "bytes": [vocab[c] for c in byte_alphabet()],
            "merges": {vocab[a] << 20 | vocab[b]: rank << 20 | vocab[a + b] for rank, (a, b) in enumerate(pairs)}}


def merge_symbols(ids: list[int], merges: dict) -> list[int]:
    """The ids of one piece after all merges, lowest rank first, leftmost first among equals.

    ``merges``: (left << 20 | right) to (rank << 20 | id of both).
    """
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get, push, pop = merges.get, heapq.heappush, heapq.heappop
    queue, left = [], ids[0]
    for i in range(1, n):
        right = ids[i]
        found = get(left << 20 | right)
        if found is not None:
            queue.append((found, i - 1))  # rank, then place
        left = right
    heapq.heapify(queue)
    while queue:
        found, i = pop(queue)
        j = after[i]
        left = ids[i]
        if left < 0 or j >= n or get(left << 20 | ids[j]) != found:
            continue  # stale: one of the two symbols has changed since
        ids[i] = new = found & 0xFFFFF
        ids[j] = -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = get(new << 20 | ids[k])
            if found is not None:
                push(queue, (found, i))
        h = before[i]
        if h >= 0:
            found = get(ids[h] << 20 | new)
            if found is not None:
                push(queue, (found, h))
    return [x for x in ids if x >= 0]


class Encoder:
    """Encodes texts inside one task."""

    def __init__(self, vocabulary: dict):
        self.merges, self.bytes, self.added = vocabulary["merges"], vocabulary["bytes"], vocabulary["added"]
        self.piece, self.low_piece = regex.compile(vocabulary["patterns"][0]), re.compile(vocabulary["patterns"][1])
        self.high = re.compile("[\U00010000-\U0010ffff]")
        specials = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        self.memory: dict[str, list[int]] = {}

    def _merged(self, piece: str) -> list[int]:
        ids = [self.bytes[b] for b in piece.encode()]
        ids = merge_symbols(ids, self.merges) if len(ids) > 1 else ids
        if len(piece) <= MEMORY_PIECE:
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[piece] = ids
        return ids

    def encode(self, text: str) -> array:
        out, memory = array("i"), self.memory
        cut = self.piece if not text.isascii() and self.high.search(text) else self.low_piece
        for part in self.special.split(text) if self.special else (text,):
            if part in self.added:
                out.append(self.added[part])
                continue
            pieces = cut.findall(part) if len(part) <= LONG else (m[0] for m in cut.finditer(part))
            for piece in pieces:
                out.extend(memory.get(piece) or self._merged(piece))
        return out


def encode(docs: DataFrame, keep: list[str], vocabulary_path: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` of every row, n_tokens and ids (array of int), of whole texts."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary_path))
    kept = docs.select(*keep)
    body, n_tokens, ids = fresh(kept, "text", "n_tokens", "ids")
    rows = kept if text in keep else docs.select(*keep, F.col(text).alias(body))
    body = text if text in keep else body

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            found = [encoder.encode(t or "") for t in batch.column(body).to_pylist()]
            sizes = [len(x) for x in found]
            flat = np.concatenate([np.frombuffer(x, np.int32) for x in found] or [np.empty(0, np.int32)])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(sizes, pa.int64()), lists], [*keep, n_tokens, ids])

    return rows.mapInArrow(run, StructType(list(kept.schema.fields)).add(n_tokens, "long").add(ids, ArrayType(IntegerType())))


def decode_column(spark: SparkSession, ids, vocabulary_path: str) -> Column:
    """The text of a column of ids."""
    shared = spark.sparkContext.broadcast({k: v for k, v in load_vocabulary(vocabulary_path).items() if k in ("strings", "known")})

    @F.pandas_udf(StringType())
    def text_of(column: pd.Series) -> pd.Series:
        strings, known = shared.value["strings"], np.zeros(len(shared.value["strings"]) + 1, bool)
        known[shared.value["known"]] = True

        def one(row) -> str:
            row = np.asarray(row if row is not None else [], np.int64)
            if not known[np.clip(row, -1, len(strings))].all():
                raise ValueError("an id is not in the vocabulary")
            read = codecs.getincrementaldecoder("utf-8")("replace")
            parts = [read.decode(b"".join([strings[i] for i in row[a:a + LONG].tolist()])) for a in range(0, len(row), LONG)]
            return "".join(parts) + read.decode(b"", True)

        return column.map(one, na_action=None)

    return text_of(F.col(ids) if isinstance(ids, str) else ids)


@F.pandas_udf(BinaryType())
def packed(column: pd.Series) -> pd.Series:
    """Ids as little-endian unsigned 32-bit integers."""
    return column.map(lambda row: np.asarray(row if row is not None else [], "<u4").tobytes(), na_action=None)
