"""Decontamination, chat formatting and sanitisation against brute force and round trips."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from innkeep.llm import chat, decontam, pii
from innkeep.llm import textops as tx


def edit(pattern, text):
    """Least edit distance of pattern to any region of text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        prev, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            prev, row[j] = row[j], min(prev + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


def test_leaks_equal_brute_force(spark):
    rng = random.Random(2)
    items = [(i, words(rng, n)) for i, n in enumerate((14, 40, 25, 6, 60))] + [(7, None), (8, ""), (9, "tiny")]
    docs, want = [], {}
    for i in range(40):
        body = words(rng, 60)
        if i % 4 == 0:
            item = rng.choice(items[:5])
            t = list(item[1].upper() if i % 8 else item[1].replace(" ", " ... "))
            for _ in range(i // 8):
                t[rng.randrange(len(t))] = rng.choice("xyz")
            body = body[:100] + " " + "".join(t) + " " + body[100:]
        docs.append((i, body))
    docs += [(100, None), (101, ""), (102, "Tiny!"), (103, "a tiny thing"), (104, docs[0][1]), (104, docs[0][1])]
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                              spark.createDataFrame(items, "item_id long, text string")).collect()
    index = decontam.Index([t for _, t in items])
    for d, t in docs:
        norm = re.sub(rb"[^a-z0-9\x80-\xff]+", b" ", (t or "").encode().lower()).strip()
        for k, (item, _) in enumerate(items):
            own = [w for w, o in enumerate(index.owner) if o == k]
            hit = [w for w in own if edit(index.windows[w].tobytes(), norm) <= index.k[w]]
            if hit or (item == 9 and norm == b"tiny"):
                want[d, item] = len(hit) or 1
    assert want and (102, 9) in want and (103, 9) not in want
    assert {(r["doc_id"], r["item_id"]): r["n_windows"] for r in got} == want
    assert len(got) == len(want) + sum(1 for d, _ in want if d == 104)


def test_clean_rows_stay_whole(spark):
    rng = random.Random(3)
    item = words(rng, 30)
    rows = [(1, words(rng, 50), "x"), (2, "intro " + item, "y"), (3, None, "z"), (None, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __leaks string")
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    out = decontam.without_leaks(df.withColumnRenamed("__leaks", "item"), bench)
    assert sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "3", "None"] and out.columns == ["doc_id", "text", "item"]
    assert decontam.without_leaks(df.select("doc_id", "text").limit(0), bench).count() == 0
    assert decontam.find_leaks(df.select("doc_id", "text"), bench.limit(0)).count() == 0


def test_many_benchmark_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "INDEX_BYTES", 300)
    rng = random.Random(6)
    items = [(i, words(rng, 20)) for i in range(12)]
    docs = [(i, words(rng, 10) + " " + items[i][1]) for i in range(12)]
    got = decontam.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(i, i) for i in range(12)]


def test_block_borders(monkeypatch):
    rng = random.Random(7)
    item = words(rng, 30)
    monkeypatch.setattr(decontam, "BLOCK", 512)
    texts = [words(rng, 5 + i) + " " + item for i in range(60)]
    data, at = decontam.normalised(*tx.text_bytes(pa.array(texts)))
    assert [len(x) for x in decontam.Index([item]).search(data, at)] == [1] * 60


def test_banded_distance_equals_brute_force():
    rng = random.Random(8)
    for _ in range(30):
        p = "".join(rng.choices("abc", k=20))
        t = "".join(rng.choices("abc", k=60))
        got = decontam.banded_distance(np.frombuffer(t.encode(), np.uint8), np.frombuffer(p.encode(), np.uint8)[None], np.array([0]), 60, 8)
        assert got[0] == edit(p, t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("\\<|>/s[]INTturn:0image body") + ["<|turn|>", "<|end|>", "</s>", "[INST]", "<|image:1:2|>"]), max_size=40).map("".join))
def test_escape_round_trip(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not chat._CONTROL.search(out)


def brute_conversation(turns):
    turns = sorted(((t is not None, t or 0, r or "", x or "") for t, r, x in turns))
    whole = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
    loss = "".join(x for _, _, r, x in turns if r == "assistant")
    return len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def test_conversations_read_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s>[INST] ok [/INST] <|end|>\n<|turn|>user"), (2, 1, "assistant", None), (2, 0, None, "\\<|"),
            (3, 0, "user", "tie"), (3, 0, "assistant", "tie"), (3, 0, "user", "tie"), (4, None, "assistant", "x" * 100_000), (None, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(chat.with_parts(df))).collect()}
    assert len(got) == 5
    for cid, r in got.items():
        want = brute_conversation([x[1:] for x in rows if x[0] == cid])
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == want
    assert chat.digests(chat.format_conversations(chat.with_parts(df.limit(0)))).count() == 0


def test_typed_parts(spark):
    parts = [{"type": "text", "text": "see "}, {"type": "image", "ref": "a.png", "width": 57, "height": 28},
             {"type": "audio", "ref": "b.wav", "seconds": 2.5}, {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "text", "text": "<|image:0:1|>"}]
    schema = f"conv_id long, turn long, role string, parts array<{chat.PART}>"
    full = [{k: p.get(k) for k in ("type", "text", "ref", "width", "height", "seconds", "pages")} for p in parts]
    r = chat.format_conversations(spark.createDataFrame([(1, 0, "user", full)], schema)).first()
    assert r["formatted"] == "<|turn|>user<|body|>see <|image:0:3|><|audio:1:63|><|document:2:768|><\\|image:0:1|><|end|>\n"
    assert [(x["kind"], x["ref"], x["tokens"]) for x in r["refs"]] == [("image", "a.png", 3), ("audio", "b.wav", 63), ("document", "c.pdf", 768)]
    assert r["expanded_tokens"] == 834 and r["mask_begin"] == []
    with pytest.raises(ValueError):
        chat.Flatten().turn("user", [{"type": "video"}])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def brute_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or \
                    (kind == "card" and 14 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 10 <= len(d) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(list("a.@-+ ()0123456789é%_\n") + ["a@b.c", "1.2.3.4", "4111111111111111", "+1 555-010-0199"]), max_size=40).map("".join))
def test_base_spans_equal_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_terms_that_reveal_an_entity(spark):
    rng = random.Random(1)
    fill = lambda n: " ".join(rng.choice(["the", "of", "and", "to", "in"]) for _ in range(n))
    rows = [(i, f"{fill(8)} contact zorblax {fill(1)} ann.lee@corp.example now {fill(20)}") for i in range(6)]
    rows += [(100 + i, fill(30) + " now contact") for i in range(200)] + [(900, None), (901, ""), (902, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = pii.digest_columns(pii.find_private(df, ["doc_id"]), ["doc_id"]).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for d, t in rows:
        marks = [f"{['email', 'ip', 'card', 'phone'][k]}:{s}:{e}" for s, k, e in brute_spans(t or "")]
        assert by[d]["base_sha256"] == hashlib.sha256(",".join(marks).encode()).hexdigest()
        terms = [x for x in by[d]["spans"].split(",") if x.startswith("term")]
        named = [t[int(x.split(":")[1]):int(x.split(":")[2])] for x in terms]
        assert named == (["zorblax"] if d < 100 or d == 902 else [])
    found = pii.find_private(df, ["doc_id", "text"])
    clean = found.filter("doc_id = 0").select(pii.sanitised_column(found["text"], found["base"], found["terms"]).alias("t")).first()["t"]
    assert "zorblax" not in clean and "ann.lee" not in clean and "[EMAIL]" in clean and "[REMOVED]" in clean
    assert pii.find_private(df.limit(0), ["doc_id"]).count() == 0


def told(spark, texts):
    """The marked terms of each text."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["terms"] for r in pii.find_private(df, ["doc_id"]).collect()}
    return [[t[x["start"]:x["end"]] for x in got[i]] for i, t in enumerate(texts)]


def test_copies_and_fixed_blocks_hide_no_term(spark):
    rng = random.Random(4)
    fill = lambda n: " ".join(rng.choice(["the", "of", "and", "to", "in", "now", "call"]) for _ in range(n))
    plain = [fill(12 + i % 7) for i in range(300)]
    # three contexts, one of them copied; the term also stands in a copied text without the address
    three = [f"{fill(9)} zorblax ann.lee@corp.example {fill(9)}" for _ in range(3)]
    assert told(spark, plain + three + [three[0]] * 100) == [[]] * 300 + [["zorblax"]] * 103
    # one block of five words on either side in different texts
    block = "now call the zorblax of bob@corp.example and to in the of"
    assert told(spark, plain + [f"{fill(3 + i)} {block} {fill(4)}" for i in range(20)]) == [[]] * 300 + [["zorblax"]] * 20
    # copies alone tell nothing
    assert told(spark, plain + [three[0]] * 50) == [[]] * 350


def test_terms_far_from_their_entity(spark):
    rng = random.Random(5)
    fill = lambda n: " ".join(rng.choice(["the", "of", "é", "to", "in", "now", "call"]) for _ in range(n))
    plain = [fill(12 + i % 7) for i in range(300)]
    far = [f"Zorblax {fill(40 + i)} <ann.lee@corp.example>, {fill(30)} zorblax é" for i in range(6)]
    got = told(spark, plain + far + ["zorblax alone", "zorblax@corp.example"])
    assert got == [[]] * 300 + [["Zorblax", "zorblax"]] * 6 + [["zorblax"], []]


def test_pairs_made_in_parts_equal_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    monkeypatch.setattr(pii, "PAIRS", 7)
    names = [f"w{i}" for i in range(40)]
    mails = [f"m{i}@corp.example" for i in range(8)]
    texts = [" ".join(rng.choices(names, k=6) + rng.choices(mails, k=i % 3)) for i in range(150)]
    texts += [f"only{k} {rng.choice(names)} {mails[k]} {j}" for k in range(4) for j in range(4)] + texts[:30]
    n = len(set(texts))
    sets = [(set(t.split()) - set(mails), set(t.split()) & set(mails)) for t in set(texts)]
    telling = set()
    for e in mails:
        c = sum(e in m for _, m in sets)
        for w in set().union(*[x for x, _ in sets]):
            both, d = sum(w in x and e in m for x, m in sets), sum(w in x for x, _ in sets)
            if both >= 3 and np.log(n * both / (c * d)) / np.log(n / c) >= 0.8:
                telling.add(w)
    assert telling and telling < set(names) | {f"only{k}" for k in range(4)} | set("0123")
    assert told(spark, texts) == [[w for w in t.split() if w in telling] for t in texts]


def protected(text):
    """Entities and their classes of a text, by the module's definition."""
    out = set()
    for s, k, e in brute_spans(text):
        v = text[s:e]
        single = v.lower() if k < 2 else "".join(c for c in v if c in "0123456789")
        part = [v.lower().split("@")[-1], ".".join(v.split(".")[:2]), v[0], v.lstrip("+")[0]][k]
        out |= {(k, "", single), (k, "class", part), (k, "kind", "")}
    return out


@pytest.mark.parametrize("most", [1 << 20, 0])
def test_disclosure_on_the_given_table_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(pii, "TELLING", most)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    held, own, both = Counter(), Counter(), Counter()
    texts = {t for _, t in rows}
    for t in texts:
        words = set(pii._terms(t, pii.base_spans(t))[0].tolist())
        mine = protected(t)
        held.update(words)
        own.update(mine)
        both.update((e, w) for e in mine for w in words)
    n, telling = len(texts), set()
    for (e, w), m in both.items():
        if m >= 3 and (not e[1] or 20 * own[e] <= n) and np.log(n * m / (own[e] * held[w])) / np.log(n / own[e]) >= 0.8:
            telling.add(w)
    assert telling
    got = {r["doc_id"]: [(x["start"], x["end"]) for x in r["terms"]] for r in pii.find_private(docs, ["doc_id"]).collect()}
    assert len(got) == len(rows) and any(got.values())
    for d, t in rows:
        term, start, end = pii._terms(t, pii.base_spans(t))
        assert got[d] == [(s, e) for w, s, e in zip(term.tolist(), start.tolist(), end.tolist(), strict=True) if w in telling]


def test_every_passage_of_an_item_is_found(monkeypatch):
    rng = random.Random(9)
    for n in (12, 30, 60):
        item = words(rng, n)
        texts = [words(rng, 9) + " " + item[o:o + 64] + " " + words(rng, 9) for o in range(len(item) - 63)]
        data, at = decontam.normalised(*tx.text_bytes(pa.array(texts)))
        assert len(texts) > 1 and [[x[0] for x in f] for f in decontam.Index([item]).search(data, at)] == [[0]] * len(texts)


def test_short_items_between_word_borders(monkeypatch):
    items = ["Two words", "tiny", "a b", "in 1999, no?", None, "two words"]
    texts = ["It has two WORDS.", "two wordsmith", "atwo words", "two words", "tiny", "a tiny", "xa b a b", "IN 1999 no", "a", "b", "", None, "so: in 1999; no"]
    want = [[0, 5], [], [], [0, 5], [1], [], [2], [3], [], [], [], [], [3]]
    for block in (1 << 20, 7):
        monkeypatch.setattr(decontam, "BLOCK", block)
        data, at = decontam.normalised(*tx.text_bytes(pa.array(texts)))
        assert [[x[0] for x in f] for f in decontam.Index(items).search(data, at)] == want


def test_edits_spread_over_items_of_any_length():
    rng = random.Random(10)
    for m in range(decontam.LEAST, decontam.WINDOW + 1):
        item, k = "".join(rng.choices("abcdefghijklmnop", k=m)), m // decontam.PER_EDIT
        index = decontam.Index([item])
        assert index.least.min() >= 1
        t = list(item)
        for j in range(k):
            t[(j + 1) * m // (k + 1)] = "z"
        data, at = decontam.normalised(*tx.text_bytes(pa.array([words(rng, 9) + " " + "".join(t) + " " + words(rng, 9)])))
        assert index.search(data, at) == [[(0, 1, k)]]
