"""Personal data, and terms that reveal it, by information-theoretic sanitisation.

1. Entities: e-mail addresses, IP addresses, card and phone numbers, by fixed patterns, as
   spans in code points.  An occurrence also counts for the classes that its entity belongs to, as
   single values seldom recur: the mail domain, the network of an address (its first two parts), the
   first digit of a card, the zone of a phone number, and the kind.  A class that more than one in
   ``CLASS_SHARE`` texts holds says little and is left out.
2. Terms: all words outside entities.  Over the whole corpus, c(e, t) is the number of different
   texts with entity e that hold term t anywhere, c(e) the number of different texts with e, d(t)
   the number of different texts with t, N the number of different texts.  All four count a text
   and its copies once.
3. With information content IC(e) = log(N / c(e)) and pointwise mutual information
   PMI(e, t) = log(N c(e, t) / (c(e) d(t))), a term discloses PMI / IC of its entity.  A term
   seen in ``SUPPORT`` different texts or more that discloses ``GENERALISE`` or more becomes a span of its own
   (kind ``term``) wherever it stands, with its entity or without it, as it tells of the entity in
   either; from ``REMOVE`` on it is removed, below it is generalised to its shape.  A term that
   tells of several entities counts by the one it discloses most.

Copies are found by hash buckets: a text whose bucket holds no repeated hash is certainly single and
is counted where it is read; only the others are shuffled and made distinct by their whole text.
Counts are combined per Arrow batch before each shuffle, so an address that stands in a third of
all texts is not one group.  Pairs are made only for entities and terms that can reach
``SUPPORT`` and ``GENERALISE`` (both need max(c, d) <= N^(1 - g) c^g, g = ``GENERALISE``), found by a
mask of hash buckets; what a mask lets through in error is dropped by the exact joins after it.

Telling terms travel to the tasks up to ``TELLING`` of them; beyond that the words in their
buckets are joined with them.

Defined cases: null and empty texts have no spans; repeated rows are reported each; a text
of any length is read whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from innkeep.llm import textops as tx
from innkeep.llm.store import fresh, small_batches, stored

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 3
GENERALISE, REMOVE = 0.8, 0.95
#: A class of entities protects nothing when more than one in this many texts holds it.
CLASS_SHARE = 20
#: Most telling terms that travel to the tasks (16 bytes each).
TELLING = 1 << 20
#: Hash buckets (2^BITS) of the sets that travel to the tasks, whatever the corpus's size.
BITS = 22
#: Pairs made at a time.
PAIRS = 1 << 18

# The patterns of the four kinds.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: each @ with the longest local part before it that is still free."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _DOMAIN.match(text, at + 1) if begin < at else None
        if m:
            yield begin, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the four kinds, by start, then kind."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and _luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def _terms(text: str, spans: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end (code points) of all words that overlap no span."""
    raw, offs = tx.text_bytes(pa.array([text], pa.string()))
    starts, ends = tx.word_spans(raw, offs)
    words, _ = tx.word_hashes(raw, offs)
    point = np.cumsum((raw & 0xC0) != 0x80)
    starts, ends = point[starts] - 1, point[ends - 1]
    inside = np.zeros(len(text) + 1, np.int64)
    for a, _, z in spans:
        inside[a] += 1
        inside[z] -= 1
    before = np.concatenate([[0], np.cumsum(np.cumsum(inside) > 0)])
    free = before[starts] == before[ends]
    return words.view(np.int64)[free], starts[free], ends[free]


def _entity(kind: int, value: str) -> str:
    return f"{kind}:" + (value.lower() if kind < 2 else re.sub(r"[^0-9]", "", value))


def _classes(kind: int, value: str) -> tuple[str, str]:
    """The entity's class (mail domain, network, first digit or zone) and its kind."""
    if kind == 0:
        part = value.lower().rpartition("@")[2]
    elif kind == 1:
        part = ".".join(value.split(".")[:2])
    else:
        part = value.lstrip("+")[0]
    return f"{kind}/{part}", f"{kind}/"


def _hash64(values: list[str]) -> np.ndarray:
    words, _ = tx.word_hashes(*tx.text_bytes(pa.array(values, pa.string())))
    return words.view(np.int64)


def _entity_hashes(body: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Hashes of the entities (even) and of their classes (odd)."""
    single = _hash64([_entity(kind, body[s:e]) for s, kind, e in spans])
    classes = _hash64([c for s, kind, e in spans for c in _classes(kind, body[s:e])])
    return np.concatenate([single & np.int64(-2), classes | np.int64(1)])


def _bucket(column: Column) -> Column:
    return F.shiftrightunsigned(column, 64 - BITS)


def _marked(buckets: DataFrame) -> np.ndarray:
    """Mask of the buckets in the one column of ``buckets``."""
    out = np.zeros(1 << BITS, bool)
    out[buckets.distinct().toArrow().column(0).to_numpy()] = True
    return out


def _hits(mask: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mask[hashes.view(np.uint64) >> np.uint64(64 - BITS)]


class Texts:
    """Every different text of ``docs`` once (null counts as empty), and their number ``n``."""

    def __init__(self, docs: DataFrame, text: str = "text"):
        self.rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
        buckets = stored(self.rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).groupBy(_bucket(F.col("h")).alias("bucket"))
                         .agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("each")), "copies")
        marked = self.marked = docs.sparkSession.sparkContext.broadcast(_marked(buckets.filter("most > 1").select("bucket")))

        def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(_hits(marked.value, batch.column(1).to_numpy()))).select(["text"])

        self.once = stored(self.rows.mapInArrow(repeated, "text string").distinct(), "once")
        self.n = self.once.count() + (buckets.filter("most = 1").agg(F.sum("each")).first()[0] or 0)

    def over(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """``run`` as in mapInArrow over batches of the one column text."""
        marked = self.marked

        def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return run(b.filter(pa.array(~_hits(marked.value, b.column(1).to_numpy()))).select(["text"]) for b in batches)

        return self.rows.mapInArrow(single, schema).unionByName(self.once.mapInArrow(run, schema))


def _counted(keys: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """Distinct rows of the columns of ``keys`` and how often each stands there (column n)."""
    order = np.lexsort(keys)
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    first = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([*[pa.array(k[first]) for k in keys], pa.array(np.diff(np.append(first, len(order))).astype(np.int64))], [*names, "n"])


def detected(docs: DataFrame, keep: list[str], mask: np.ndarray, known: tuple[np.ndarray, np.ndarray] | None, text: str = "text") -> DataFrame:
    """Columns ``keep``, spans (start, kind, end) and near (term, start, end, disclosure) per row.

    With ``known`` (telling terms ascending, their disclosure) near holds the telling terms; without,
    the words in buckets of ``mask``, whose disclosure is null.
    """
    schema = docs.select(*keep).schema
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schema)
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
    near = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("disclosure", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast((mask, known))

    def telling(body: str, found: list[tuple[int, int, int]]) -> list[dict]:
        mask, known = shared.value
        term, start, end = _terms(body, found)
        hit = np.flatnonzero(_hits(mask, term))
        much = [None] * len(hit)
        if known is not None:
            at = np.minimum(np.searchsorted(known[0], term[hit]), len(known[0]) - 1)
            same = known[0][at] == term[hit]
            hit, much = hit[same], known[1][at[same]].tolist()
        return [{"term": t, "start": s, "end": e, "disclosure": m}
                for t, s, e, m in zip(term[hit].tolist(), start[hit].tolist(), end[hit].tolist(), much, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in tx.slices(batch, "__text"):
                words, first = tx.word_hashes(*tx.text_bytes(piece.column(piece.num_columns - 1)))
                some = np.concatenate([[0], np.cumsum(_hits(shared.value[0], words))])[first]
                spans, near_ = [], []
                for i, body in enumerate(piece.column(piece.num_columns - 1).to_pylist()):
                    found = base_spans(body or "")
                    spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
                    near_.append(telling(body, found) if some[i + 1] > some[i] else [])
                yield pa.RecordBatch.from_arrays([*[piece.column(i) for i in range(piece.num_columns - 1)], pa.array(spans, span), pa.array(near_, near)],
                                                 [*schema.names, "spans", "near"])

    return docs.select(*keep, F.col(text).alias("__text")).mapInArrow(
        run, fields + "spans array<struct<start:long,kind:int,end:long>>, near array<struct<term:long,start:long,end:long,disclosure:double>>")


def text_frequencies(texts: Texts) -> DataFrame:
    """(term, d): number of different texts that hold each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = []
            for piece in tx.slices(batch, "text"):
                words, first = tx.word_hashes(*tx.text_bytes(piece.column(0)))
                for i in range(piece.num_rows):
                    each.append(np.unique(words[first[i]:first[i + 1]]))
            if each:
                yield _counted([np.concatenate(each).view(np.int64)], ["term"])

    return texts.over(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("d"))


def entity_frequencies(texts: Texts) -> DataFrame:
    """(entity, c): number of different texts that hold each entity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = []
            for piece in tx.slices(batch, "text"):
                for body in piece.column(0).to_pylist():
                    if found := base_spans(body):
                        each.append(np.unique(_entity_hashes(body, found)))
            if each:
                yield _counted([np.concatenate(each)], ["entity"])

    return texts.over(run, "entity long, n long").groupBy("entity").agg(F.sum("n").alias("c"))


def pair_frequencies(texts: Texts, entities: np.ndarray, terms: np.ndarray) -> DataFrame:
    """(entity, term, both): number of different texts that hold both, for the buckets of ``entities`` and ``terms``."""
    masks = texts.rows.sparkSession.sparkContext.broadcast((entities, terms))

    def pairs(body: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        if not (found := base_spans(body)):
            return
        own = np.unique(_entity_hashes(body, found))
        own = own[_hits(masks.value[0], own)]
        if len(own):
            words = np.unique(_terms(body, found)[0])
            words = words[_hits(masks.value[1], words)]
            for a in range(0, len(words), PAIRS):
                part = words[a:a + PAIRS]
                step = max(1, PAIRS // len(part))
                for b in range(0, len(own), step):
                    e = own[b:b + step]
                    yield np.repeat(e, len(part)), np.tile(part, len(e))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each, size = [], 0
            for piece in tx.slices(batch, "text"):
                for body in piece.column(0).to_pylist():
                    for pair in pairs(body):
                        each.append(pair)
                        size += len(pair[0])
                        if size >= PAIRS:
                            yield _counted([np.concatenate(x) for x in zip(*each, strict=True)], ["entity", "term"])
                            each, size = [], 0
            if each:
                yield _counted([np.concatenate(x) for x in zip(*each, strict=True)], ["entity", "term"])

    return texts.over(run, "entity long, term long, n long").groupBy("entity", "term").agg(F.sum("n").alias("both"))


def disclosing_terms(texts: Texts) -> DataFrame:
    """(term, disclosure) of terms at or above GENERALISE, by the entity that a term discloses most."""
    n = F.lit(float(texts.n))
    # a term in most texts of an entity, or an entity in most texts of a term, tells at most log(N / max(c, d))
    most = lambda c: F.pow(n, 1 - GENERALISE) * F.pow(c, GENERALISE) * (1 + 1e-9)
    single = F.col("entity").bitwiseAND(1) == 0
    whole = stored(entity_frequencies(texts).filter((F.col("c") >= SUPPORT) & (single | (F.col("c") * CLASS_SHARE <= texts.n))), "entities")
    largest = whole.agg(F.max("c")).first()[0] or 0
    words = stored(text_frequencies(texts).filter((F.col("d") >= SUPPORT) & (F.col("d") <= most(F.lit(float(largest))))), "words")
    pairs = pair_frequencies(texts, *[_marked(x.select(_bucket(F.col(c)))) for x, c in ((whole, "entity"), (words, "term"))])
    pairs = pairs.filter(F.col("both") >= SUPPORT).join(whole, "entity").join(words, "term")
    content = F.log(n / F.col("c"))
    pmi = F.log(n * F.col("both") / (F.col("c") * F.col("d")))
    return (pairs.withColumn("disclosure", F.when(content > 0, pmi / content))
            .filter(F.col("disclosure") >= GENERALISE).groupBy("term").agg(F.max("disclosure").alias("disclosure")))


def find_private(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep``, base (start, kind, end) and terms (start, end, disclosure) per row of ``docs``.

    Output columns that clash with a kept column get leading underscores.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*keep)
    names, asked = fresh(kept, "base", "terms"), keep
    keep = [f"_kept{i}" for i in range(len(asked))]
    docs = docs.select(*[F.col(k).alias(n) for k, n in zip(asked, keep, strict=True)], F.col(text).alias("text"))
    text = "text"
    telling = stored(disclosing_terms(Texts(docs, text)), "telling")
    mask = _marked(telling.select(_bucket(F.col("term"))))
    renamed = [F.col(n).alias(k) for n, k in zip(keep, asked, strict=True)]
    if telling.count() <= TELLING:
        rows = telling.orderBy("term").toArrow()
        known = tuple(rows.column(c).to_numpy() for c in ("term", "disclosure"))
        terms = F.transform("near", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["disclosure"].alias("disclosure")))
        return detected(docs, keep, mask, known, text).select(*renamed, F.col("spans").alias(names[0]), terms.alias(names[1]))
    rows = stored(detected(docs, keep, mask, None, text).withColumn("row", F.monotonically_increasing_id()), "private")
    near = rows.select("row", F.explode("near").alias("x")).select("row", "x.term", "x.start", "x.end")
    terms = (near.join(telling, "term").groupBy("row")
             .agg(F.sort_array(F.collect_list(F.struct("start", "end", "disclosure"))).alias("terms")))
    none = F.array().cast("array<struct<start:long,end:long,disclosure:double>>")
    return (rows.drop("near").join(terms, "row", "left")
            .select(*renamed, F.col("spans").alias(names[0]), F.coalesce("terms", none).alias(names[1])))


def sanitise(text: str, base: list, terms: list) -> str:
    """Text with entities replaced by their kind and telling terms removed or generalised to their shape."""
    marks = [(s, e, f"[{KINDS[k].upper()}]") for s, k, e in base]
    for s, e, much in terms:
        shape = re.sub(r"[a-zß-ÿ]+", "x", re.sub(r"[A-ZÀ-Þ]+", "X", text[s:e]))
        marks.append((s, e, "[REMOVED]" if much >= REMOVE else f"[{shape}]"))
    out, at = [], 0
    for s, e, mark in sorted(marks):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def sanitised_column(text: Column, base: Column, terms: Column) -> Column:
    """``sanitise`` over columns, in Arrow batches."""

    @F.pandas_udf("string")
    def column(t: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series([None if body is None else sanitise(body, [(r["start"], r["kind"], r["end"]) for r in p], [(r["start"], r["end"], r["disclosure"]) for r in q])
                          for body, p, q in zip(t, b, x, strict=True)], dtype=object)

    return column(text, base, terms)


def digest_columns(found: DataFrame, keep: list[str]) -> DataFrame:
    """n_email, n_ip, n_card, n_phone, base_sha256 and spans from ``find_private``'s result."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    mark = lambda k, s, e: F.concat_ws(":", F.element_at(kinds, k + 1), s.cast("string"), e.cast("string"))
    base = F.transform("base", lambda x: mark(x["kind"], x["start"], x["end"]))
    every = F.array_sort(F.concat(
        F.col("base"), F.transform("terms", lambda x: F.struct(x["start"].alias("start"), F.lit(4).alias("kind"), x["end"].alias("end")))))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return found.select(*keep, *[count(i).alias("n_" + KINDS[i]) for i in range(4)],
                        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
                        F.array_join(F.transform(every, lambda x: mark(x["kind"], x["start"], x["end"])), ",").alias("spans"))
