"""MinHash near duplicates against exact all-pairs similarity on a small fixture."""

import random

import numpy as np
import pyarrow as pa
import pytest

from innkeep.llm import minhash
from innkeep.llm import textops as tx
from innkeep.llm.graph import components


def shingles(text, k):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        c = min(ids) if ids else None
        out.append((d, len(sets[i]), c, d == c))
    return out


def corpus(seed=4):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    base = [rng.choices(vocab, k=150) for _ in range(6)]
    for b, text in enumerate(base):
        for _ in range(60 if b == 0 else 12):  # a large group of copies with 0 to 14 changed words
            own = list(text)
            for _ in range(rng.randint(0, 14)):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            rows.append(" ".join(own))
    rows += [" ".join(rng.choices(vocab, k=rng.randint(1, 40))) for _ in range(30)]
    rows += [None, "", "  \t", "one two", "One  TWO", "one two three", "É a b c d", "é a b c d", "x " * 3000]
    rng.shuffle(rows)
    out = [(i, t) for i, t in enumerate(rows)]
    return out + [out[5], (None, "null id alone here"), (None, out[9][1])]


def check(got, want):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_components_equal_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for size in (4, 5):
        got = minhash.near_duplicates(df, size=size).select("doc_id", "n_shingles", "component_id", "kept").collect()
        check(got, brute(rows, size))


@pytest.mark.parametrize("bound", [("BLOCK", 4), ("BLOCK_SHINGLES", 500)])
def test_cells_find_what_the_stars_miss(spark, monkeypatch, bound):
    monkeypatch.setattr(minhash, *bound)
    rows = corpus(8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = minhash.near_duplicates(df, size=4).select("doc_id", "n_shingles", "component_id", "kept").collect()
    check(got, brute(rows, 4))


def test_stage_keeps_one_row_of_each_group(spark):
    from pyspark.sql import functions as F
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("band", F.lit(1)).withColumn("cls", F.lit("x"))
    out = minhash.without_near_duplicates(df)
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    want = {d for d, _, _, k in brute(rows, 5) if k and d is not None}
    assert sorted(x for x in kept if x is not None) == sorted(want)
    assert minhash.without_near_duplicates(df.limit(0)).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    for same in (950, 800, 300):
        b = np.concatenate([a[:same], rng.integers(0, 1 << 63, 1000 - same, dtype=np.uint64)])
        j = same / (2000 - same)
        values = minhash.minhashes(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, 1000, 2000]))
        sketch = minhash.odd_sketches(values).view(np.uint64)
        flips = int(np.bitwise_count(sketch[0] ^ sketch[1]).sum())
        assert abs(flips - minhash.expected_flips(j)) < 80
        if j >= 0.8:
            assert flips <= minhash.most_flips(0.8)


def test_words_are_split_and_hashed_as_defined():
    texts = ["", None, "A b\tC\x0bd\n", "É é", "a\u00a0b", " lead", "x" * 3_000_000, "same same"]
    words, first = tx.word_hashes(*tx.text_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        own = (t or "").encode().lower().split()
        assert first[i + 1] - first[i] == len(own)
        for k, w in enumerate(own):
            assert int(words[first[i] + k]) == tx.hash_word(w.decode())
    assert tx.hash_word("a") != tx.hash_word("b") and tx.hash_word("ab") != tx.hash_word("ba")


def test_components_of_chains_and_stars(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (300, 300), (None, 4)]
    rng.shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}
