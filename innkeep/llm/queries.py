"""Registered queries of the training-data operators: opN_<name>(spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from innkeep.llm import bpe, chat, decontam, exact_dedup, lm, minhash, mixing, pii, quality, sharding, spelling, toxicity, trie
from innkeep.llm.store import table


def remainder(n: int):
    """crc32 of the id as text, modulo ``n``: what the contracts split learning rows by."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder(5) == 0
    model = spark.sparkContext.broadcast(toxicity.train(docs, labels.filter(~held)))
    scored = docs.select("doc_id", held.alias("held_out"), toxicity.score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (remainder(7) == 2).alias("held_out"), "text")
    return lm.score_documents(docs, ~F.col("held_out"), ["doc_id", "held_out"])


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"),
                                                        F.col("turn").cast("long").alias("turn"), "role", "text")
    hard = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], rows.schema)
    out = chat.format_conversations(chat.with_parts(rows.unionByName(extra)))
    return chat.digests(out)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.select_mixture(docs, share=0.8, weights=MIX_WEIGHTS, max_epochs=4, seed=6, domain=mix_domain())


def mix_domain():
    """Domain of a document: the hub source by itself, the others by the parity of their last digit."""
    return (F.when(F.col("source") == "src0", "hub")
            .when(F.substring(F.col("source"), -1, 1).isin("0", "2", "4", "6", "8"), "even").otherwise("odd"))


#: Target weights: domains, then languages in any domain; sources share alike.
MIX_WEIGHTS = {("hub",): 1.0, ("even",): 2.0, ("odd",): 2.0,
               ("*", "en"): 5.0, ("*", "de"): 2.0, ("*", "fr"): 2.0, ("*", "es"): 2.0}


def op7_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = remainder(4) == 2
    model = quality.train(docs, labels.filter(~held))
    scored = docs.select("doc_id", held.alias("held_out"), quality.score_column(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


def op10_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_private(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    clean = found.withColumn("sanitised_sha256", F.sha2(F.coalesce(pii.sanitised_column(F.col("text"), F.col("base"), F.col("terms")), F.lit("")), 256))
    return pii.digest_columns(clean, ["doc_id", "sanitised_sha256"])


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def op13_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.encode(table(spark, sf_dir, "documents"), ["doc_id"], path)
    return found.select("doc_id", "n_tokens", F.sha2(bpe.packed("ids"), 256).alias("ids_sha256"),
                        F.sha2(bpe.decode_column(spark, "ids", path), 256).alias("decoded_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_benchmark_decontamination, op2_toxicity, op3_lm_scoring, op4_chat_format, op5_minhash_near_dedup, op6_source_mixing,
    op7_shard_tree, op8_quality, op9_exact_dedup, op10_pii_sanitisation, op11_prefix_trie, op12_spelling_variants, op13_bpe_round_trip)}

OP9_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents"""

OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
esc AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), CONTROL, '\1\\\2', 'g') AS etext,
            regexp_replace(replace(role, '\', '\\'), CONTROL, '\1\\\2', 'g') AS erole FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(erole) + length(etext) + 24)::BIGINT AS formatted_chars
FROM esc GROUP BY conv_id"""

OP5_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM words WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (s)
                    WHERE x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)"""

#: Table of the cyclic redundancy check crc32, and the check of a string's bytes by it.
_CRC_TABLE = """
SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS v
  FROM range(256) r(i))"""
_CRC = """xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(encode(s)), '..'), lambda h: ('0x' || h)::BIGINT),
    lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT))"""

OP11_SQL = r"""
WITH tab AS (TABLE),
t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos
      FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT s::BIGINT AS conv_id, s::BIGINT - s::BIGINT % 20 AS lender, CRC % 4 AS h FROM (SELECT DISTINCT conv_id::VARCHAR AS s FROM t), tab),
lent AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = lender AND pos < h),
k AS (SELECT c.conv_id, h, count(lent.pos) AS k FROM c LEFT JOIN lent USING (conv_id) GROUP BY ALL),
turns AS (SELECT * FROM lent UNION ALL SELECT conv_id, k + pos - h, role, text FROM t JOIN k USING (conv_id) WHERE pos >= h),
keyed AS (
  SELECT conv_id, pos + 1 AS depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
         list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY pos) AS key FROM turns
  UNION ALL SELECT conv_id, 0, 0, [] FROM c),
m AS (SELECT conv_id, depth, words, min(conv_id) OVER (PARTITION BY depth, key) AS node,
             depth = max(depth) OVER (PARTITION BY conv_id) AS final FROM keyed),
nodes AS (
  SELECT depth, node, count(*) AS n_convs, (count(*) - 1) * max(words) AS saved,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (final), '')) AS ends_sha256 FROM m GROUP BY ALL),
parents AS (SELECT n.*, m.node AS parent FROM nodes n LEFT JOIN m ON m.conv_id = n.node AND m.depth = n.depth - 1),
kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM parents WHERE parent IS NOT NULL GROUP BY ALL),
full_nodes AS (SELECT p.*, coalesce(n_children, 0) AS n_children FROM parents p LEFT JOIN kids USING (depth, node)),
subtree AS (
  SELECT m.depth, m.node, count(*) FILTER (f.n_children = 0) AS n_leaves, sum(f.saved)::BIGINT AS saved_tokens
  FROM full_nodes f JOIN m ON m.conv_id = f.node AND m.depth <= f.depth GROUP BY ALL)
SELECT node AS conv_id, depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM full_nodes JOIN subtree USING (depth, node)"""

OP12_SQL = r"""
WITH RECURSIVE tab AS (TABLE),
runs AS (
  SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS s, w, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                 '[a-z\x{00C0}-\x{00FF}]+')) AS w FROM documents) GROUP BY ALL),
hashed AS (SELECT w, n, CRC AS h FROM runs, tab),
words AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (
  SELECT word, n, i, left(word, i) AS a, substr(word, i + 2) AS b
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS near, y.n AS m FROM cuts x JOIN cuts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON x.a || x.b = y.word
  UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON x.a || x.b = y.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS top, min(near) FILTER (m = most) AS first
         FROM (SELECT *, max(m) OVER (PARTITION BY word) AS most FROM near) GROUP BY word),
found AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 5 * n THEN first END AS form,
                 CASE WHEN top >= 5 * n THEN top END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS root, form AS further FROM found
          UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN found f ON f.word = c.further)
SELECT f.word, form, root, n, n_near, form_n FROM found f JOIN chain c ON c.word = f.word AND c.further IS NULL"""

#: Control strings as one pattern whose first character is a group of its own.
_CONTROL_SQL = "'(<|\\[)(\\|turn\\|>|\\|body\\|>|\\|end\\|>|\\|im_start\\|>|\\|im_end\\|>|\\|endoftext\\|>|\\|startoftext\\|>|s>|/s>|INST\\]|/INST\\]|<SYS>>|</SYS>>|\\|(?:image|audio|document):\\d+:\\d+\\|>)'"

ORACLE = {"op4_chat_format": OP4_SQL.replace("CONTROL", _CONTROL_SQL), "op5_minhash_near_dedup": OP5_SQL,
          "op9_exact_dedup": OP9_SQL, **{n: q.replace("(TABLE)", f"({_CRC_TABLE})").replace("CRC", _CRC)
                               for n, q in (("op11_prefix_trie", OP11_SQL), ("op12_spelling_variants", OP12_SQL))}}
