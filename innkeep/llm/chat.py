"""Chat formatting over typed content parts.

A turn is a list of parts (text, image, audio, document).  A visitor walks the parts in order
and flattens them: texts are escaped, attachments become numbered placeholders, their
references are recorded, and the tokens that each placeholder expands to are counted.

Template, one block per turn::

    <|turn|>ROLE<|body|>BODY<|end|>\\n

Control strings inside roles and texts are escaped reversibly: a backslash is doubled and a
control string gets a backslash behind its first character, so no control string of the
template, nor of the listed foreign templates, is left in a text; text parts in a row are one
text.  ``parse`` reads a
formatted conversation back; the loss mask is the list of spans of assistant texts.

Defined cases: null text is the empty text, null role is the empty role, null turn numbers
come first; equal turn numbers are ordered by role and text; rows that repeat are turns of
their own; null conversation ids are one conversation; an empty table gives no rows.
An unknown part type raises ValueError.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Control strings, of this template first, then of widely used ones.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
SLOT = re.compile(r"<\|(image|audio|document):(\d+):(\d+)\|>")
FOREIGN = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>", "<s>", "</s>", "[INST]", "[/INST]",
           "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(x) for x in (TURN, BODY, END, *FOREIGN)) + "|" + SLOT.pattern)
_BACK = re.compile(r"\\(.)", re.S)
#: Parameters: tokens of one image tile of 28 x 28 pixels, of a second of audio, of a document page.
TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def escape(text: str) -> str:
    """Text without control strings; ``unescape`` undoes it."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


class Flatten:
    """Visitor over the parts of a conversation: ordered placeholders, references, token counts."""

    def __init__(self):
        self.out: list[str] = []
        self.refs: list[dict] = []
        self.mask: list[tuple[int, int]] = []
        self.at = 0

    def _put(self, piece: str) -> None:
        self.out.append(piece)
        self.at += len(piece)

    def turn(self, role: str | None, parts: list[dict]) -> None:
        role = role or ""
        self._put(f"{TURN}{escape(role)}{BODY}")
        for kind, run in itertools.groupby(parts, key=lambda part: str(part["type"])):
            visit = getattr(self, "visit_" + kind, None)
            if visit is None:
                raise ValueError(f"unknown part type {kind!r}")
            if kind == "text":  # one text: a control string may lie over a border of parts
                visit({"text": "".join(part.get("text") or "" for part in run)}, role)
                continue
            for part in run:
                visit(part, role)
        self._put(END + "\n")

    def visit_text(self, part: dict, role: str) -> None:
        begin = self.at
        self._put(escape(part.get("text") or ""))
        if role == "assistant" and self.at > begin:
            self.mask.append((begin, self.at))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self._put(f"<|{kind}:{len(self.refs)}:{tokens}|>")
        self.refs.append({"kind": kind, "ref": part.get("ref"), "tokens": tokens})

    def visit_image(self, part: dict, role: str) -> None:
        tiles = [-(-max(1, int(part.get(k) or TILE)) // TILE) for k in ("width", "height")]
        self._attach("image", part, tiles[0] * tiles[1])

    def visit_audio(self, part: dict, role: str) -> None:
        self._attach("audio", part, int(-(-float(part.get("seconds") or 0) * AUDIO_RATE // 1)))

    def visit_document(self, part: dict, role: str) -> None:
        self._attach("document", part, max(1, int(part.get("pages") or 1)) * PAGE_TOKENS)


def parse(formatted: str, mask: list[tuple[int, int]]) -> tuple[list[tuple[str, str]], str]:
    """(role, body) of every turn and all text under the mask, unescaped, from the output."""
    turns = []
    for block in formatted.split(END + "\n")[:-1]:
        head, body = block.split(BODY, 1)
        turns.append((unescape(head[len(TURN):]), unescape(body)))
    return turns, "".join(unescape(formatted[a:b]) for a, b in mask)


def with_parts(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose column ``parts`` holds the text as their only part."""
    kinds = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    part = F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text), F.lit("")).alias("text"),
                    *[F.lit(None).cast(k).alias(n) for n, k in kinds.items()])
    return rows.withColumn("parts", F.array(part))


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         parts: str = "parts") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, mask_begin, mask_end, refs,
    expanded_tokens.  A conversation is one output row, so its turns meet in one task."""
    grouped = (turns.select(F.col(conv_id).cast("long").alias("conv_id"),
                            F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                                     F.col(parts).alias("parts")).alias("t"))
               .groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cid, turns_ in zip(pdf["conv_id"], pdf["turns"], strict=True):
                v = Flatten()
                for t in turns_:
                    v.turn(t["role"], list(t["parts"]) if t["parts"] is not None else [])
                out.append((cid, len(turns_), "".join(v.out), [a for a, _ in v.mask], [b for _, b in v.mask],
                            [(r["kind"], r["ref"], r["tokens"]) for r in v.refs], sum(r["tokens"] for r in v.refs)))
            df = pd.DataFrame(out, columns=["conv_id", "n_turns", "formatted", "mask_begin", "mask_end", "refs", "expanded_tokens"])
            df["conv_id"] = df["conv_id"].astype("Int64")
            df["refs"] = [[{"kind": k, "ref": r, "tokens": t} for k, r, t in x] for x in df["refs"]]
            yield df

    return grouped.mapInPandas(run, "conv_id long, n_turns long, formatted string, mask_begin array<long>, "
                               "mask_end array<long>, refs array<struct<kind:string,ref:string,tokens:long>>, expanded_tokens long")


def digests(formatted: DataFrame) -> DataFrame:
    """Digest columns read back from formatted conversations."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for cid, text, begin, end in zip(pdf["conv_id"], pdf["formatted"], pdf["mask_begin"], pdf["mask_end"], strict=True):
                turns, loss = parse(text, list(zip(begin, end, strict=True)))
                whole = hashlib.sha256("".join(f"{r}\n{b}\n" for r, b in turns).encode()).hexdigest()
                out.append((cid, len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            df = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
            df["conv_id"] = df["conv_id"].astype("Int64")
            yield df

    return formatted.select("conv_id", "formatted", "mask_begin", "mask_end").mapInPandas(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
