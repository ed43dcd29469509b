"""Columns of the documents that are named like helpers or outputs; control strings over parts."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline as P
from innkeep.llm import chat, decontam, lm, minhash, pii, quality
from innkeep.llm.store import stored

SF = "/root/testdata/sf0.001"
NAMES = ["__leaks", "__score", "__id", "__hash", "__more", "__text", "row", "spans", "near", "base", "terms", "id", "hash", "more",
         "n_tokens", "rare", "times", "base_score", "kept"]


def test_columns_named_like_helpers_stay_as_they_are(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    wide = stored(docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES]), "wide")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    def whole(out):
        assert out.columns[:len(wide.columns)] == wide.columns
        rows = out.collect()
        assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in NAMES)
        return {r["doc_id"] for r in rows}

    assert whole(decontam.without_leaks(wide, bench)) == {r["doc_id"] for r in decontam.without_leaks(docs, bench).collect()}
    assert whole(minhash.without_near_duplicates(wide)) == {r["doc_id"] for r in minhash.without_near_duplicates(docs).collect()}
    quality.train(wide, labels)
    assert whole(P.quality_stage(spark, wide, SF)) == {r["doc_id"] for r in P.quality_stage(spark, docs, SF).collect()}
    scored = lm.score_documents(wide, F.col("doc_id") % 2 == 0, wide.columns)
    assert {"_n_tokens", "_base_score", "score"} <= set(scored.columns) and len(whole(scored)) == 60
    found = pii.find_private(wide, wide.columns)
    assert found.columns[-2:] == ["_base", "_terms"] and len(whole(found)) == 60


PIECES = ["<|en", "d|>", "<|", "image:0:9|>", "<|image:0", ":9|>", "[INS", "T]", "</", "s>", "\\", "<", "|turn|>", "<|body|>", "a", "\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|bo"]), st.lists(st.one_of(
    st.sampled_from(PIECES).map(lambda t: {"type": "text", "text": t}), st.just({"type": "image", "ref": "r"})), max_size=6)), max_size=4))
def test_control_strings_split_over_parts(turns):
    v = chat.Flatten()
    for role, parts in turns:
        v.turn(role, parts)
    out = "".join(v.out)
    slots = [(m[1], int(m[2])) for m in chat.SLOT.finditer(out)]
    assert slots == [("image", i) for i in range(len(v.refs))]
    bare = chat.SLOT.sub("", out)
    assert not [f for f in chat.FOREIGN if f in bare] or v.refs
    assert len(re.findall(re.escape(chat.END), out)) == len(turns)
    read, loss = chat.parse(out, v.mask)
    assert [r for r, _ in read] == [r for r, _ in turns]
    plain = ["".join(p["text"] for p in parts if p["type"] == "text") for _, parts in turns]
    assert [chat.SLOT.sub("", b) for _, b in read if "image" not in str(turns)] == [p for p in plain if "image" not in str(turns)]
    assert loss == "".join(p for (r, _), p in zip(turns, plain, strict=True) if r == "assistant")
