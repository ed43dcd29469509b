"""Prefix trie and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from innkeep.llm import spelling, trie

TURN = "conv_id long, turn long, role string, text string"


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in convs.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(seqs):
        for d in range(len(seqs[c]) + 1):
            members[tuple(seqs[c][:d])].append(c)
        ends[tuple(seqs[c])].append(c)
    kids = Counter(k[:-1] for k in members if k)
    out = []
    for k, own_ in members.items():
        below = [x for x in members if x[:len(k)] == k]
        saved = sum((len(members[x]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", x[-1][1])) for x in below if x)
        out.append((min(own_), len(k), min(members[k[:-1]]) if k else None, len(own_), kids[k], sum(not kids[x] for x in below), saved,
                    hashlib.sha256(",".join(map(str, ends.get(k, []))).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_trie_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(60), rng.choice([None, *range(7)]), rng.choice(["user", "assistant", None, ""]),
             rng.choice([None, "", "a b", "a  b\tc", "same turn here", "x" * 50])) for _ in range(260)]
    rows += [(100 + i, t, "user", "a copied conversation") for i in range(40) for t in range(5)] + [(None, 1, "user", "no one's"), rows[0], rows[0]]
    df = spark.createDataFrame(rows, TURN).withColumn("conv", F.lit("clash")).withColumn("pos", F.lit(0)).withColumn("key", F.lit(1))
    turns = trie.ordered_turns(df).checkpoint()
    got = trie.prefix_trie(turns.select("conv").distinct(), trie.rebuilt(turns).checkpoint(), sparse=3, base=40)
    assert sorted(map(tuple, got.collect()), key=str) == brute_trie(rows)


def test_trie_of_nothing_and_of_one_long_conversation(spark):
    assert trie.rebuilt_trie(spark.createDataFrame([], TURN)).count() == 0
    rows = [(3, t, "user", "word " * 2000 if t == 5 else None) for t in range(300)]
    got = sorted(map(tuple, trie.rebuilt_trie(spark.createDataFrame(rows, TURN)).collect()), key=str)
    assert got == brute_trie(rows) and len(got) == 301 - zlib.crc32(b"3") % 4


def test_list_rank(spark):
    order = list(range(3000))
    random.Random(4).shuffle(order)
    links = [(a, b) for a, b in zip(order, order[1:] + [None], strict=True)]
    arcs = spark.createDataFrame(links, "arc long, next long")
    for sparse, base in ((8, 50), (2, 500), (8, 10_000)):
        got = {r["arc"]: r["pos"] for r in trie.list_rank(arcs, sparse, base).collect()}
        assert got == {a: i + 1 for i, a in enumerate(order)}
    with pytest.raises(Exception, match="not one list"):
        trie.list_rank(spark.createDataFrame([(0, None), (1, None)], "arc long, next long"))


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_words(rows, every):
    n = Counter()
    for i, text in rows:
        for w in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[:h % len(w)] + w[h % len(w) + 1:] if h % every == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def brute_groups(rows, every):
    n = brute_words(rows, every)
    beside = {w: [x for x in n if near(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(beside[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, form[w], root(w), n[w], len(beside[w]), n[form[w]] if form[w] else None) for w in n)


@pytest.mark.parametrize("sizes", [(1 << 15, 1 << 15, 1 << 15, 24), (40, 30, 20, 1)])
def test_spelling_equals_brute_force(spark, monkeypatch, sizes):
    rng = random.Random(9)
    letters = "abcdeàÉÿ×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(40)] + ["abcdef", "fedcba", "bacdef", "x" * 400]
    words = [w for k, w in enumerate(base) for _ in range(300 if k % 9 == 0 else 6 + 3 * (k % 7))]
    for _ in range(3000):
        w = list(rng.choice(base))
        at = rng.randrange(len(w))
        rng.choice([lambda: w.pop(at), lambda: w.insert(at, rng.choice(letters)), lambda: w.__setitem__(at, rng.choice(letters))])()
        words += ["".join(w)] * rng.choice([1, 5, 6])
    rng.shuffle(words)
    rows = [(rng.choice([i, i, None]), " ".join(words[i:i + 90]).replace("b", "B")) for i in range(0, len(words), 90)]
    rows += [(5, None), (6, ""), (None, None), rows[0], rows[0]]
    for name, value in zip(("QUERIES", "POINTS", "TARGET", "BOTTOM"), sizes, strict=True):
        monkeypatch.setattr(spelling, name, value)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash")).withColumn("n", F.lit(1))
    got = sorted(tuple(r) for r in spelling.spelling_groups(docs, every=7).select("word", "form", "root", "n", "n_near", "form_n").collect())
    want = brute_groups(rows, 7)
    assert got == want and any(f for _, f, *_ in want) and any(r not in (f, w) for w, f, r, *_ in want)
    assert spelling.spelling_groups(docs.limit(0)).count() == 0


def test_search_prunes_without_loss():
    rng = np.random.default_rng(1)
    def make(n, length):
        return sorted({"".join(w) for w in rng.choice(list("abcé"), (n, length))})
    six, seven = make(600, 6), make(600, 7)
    for queries, points in ((six, six), (seven, six)):
        a, b = spelling.search(queries, points)
        assert sorted(zip(a.tolist(), b.tolist(), strict=True)) == [(i, j) for i, q in enumerate(queries) for j, p in enumerate(points) if near(q, p)]
