"""Byte-pair encoding against the tokenizers library, and its round trip."""

import hashlib
import random

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from innkeep.llm import bpe
from innkeep.llm.queries import QUERIES

PATH = "/opt/tokenizers/byte_bpe_50k.json"
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.load_vocabulary(PATH)


def test_pieces_of_all_code_points(library, vocabulary):
    whole, low = (regex.compile(p) for p in vocabulary["patterns"])
    for a in range(0, 0x110000, 64):
        if 0xD800 <= a < 0xE000:
            continue
        s = "".join(f"a{c}1{c}!{c} {c}{c} x" for c in map(chr, range(a, a + 64)))
        want = [s[i:j] for _, (i, j) in library.pre_tokenizer.pre_tokenize_str(s)]
        assert whole.findall(s) == want
        assert a >= 0x10000 or low.findall(s) == want


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("ab '\n<|endoftext>")), max_size=60))
def test_random_texts(library, vocabulary, text):
    assert list(bpe.Encoder(vocabulary).encode(text)) == library.encode(text, add_special_tokens=False).ids


def test_long_pieces(library, vocabulary):
    rng = random.Random(3)
    for text in ("a" * 20_000, "".join(rng.choice("abcdeé") for _ in range(20_000)), " " * 5000 + "x", "<|endoftext|>" * 3 + " <|endoftext|"):
        assert list(bpe.Encoder(vocabulary).encode(text)) == library.encode(text, add_special_tokens=False).ids


def _digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_query_equals_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r[1:]) for r in QUERIES["op13_bpe_round_trip"](spark, SF).collect()}
    assert got == {r["doc_id"]: _digests(library, r["text"]) for r in docs}


def test_defined_cases(spark, library):
    rows = [(1, None, 7), (2, "", None), (None, "a b", 1), (3, "a b", 1), (3, "a b", 1), (4, "naïve 😀 " * 9000, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    out = bpe.encode(docs, docs.columns, PATH)
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "_ids"]
    out = out.withColumn("back", bpe.decode_column(spark, "_ids", PATH)).collect()
    assert sorted((str(r["doc_id"]), r["ids"], r["back"]) for r in out) == sorted((str(i), n, t or "") for i, t, n in rows)
    assert all(list(r["_ids"]) == library.encode(r["text"] or "", add_special_tokens=False).ids for r in out)
    assert bpe.encode(docs.limit(0), ["doc_id"], PATH).count() == 0
    bad = spark.createDataFrame([([50257],), (None,)], "ids array<int>").select(bpe.decode_column(spark, "ids", PATH))
    with pytest.raises(Exception, match="not in the vocabulary"):
        bad.collect()
    broken = spark.createDataFrame([([int(library.token_to_id("Ã"))],), (None,)], "ids array<int>")
    assert [r[0] for r in broken.select(bpe.decode_column(spark, "ids", PATH)).collect()] == ["�", ""]
