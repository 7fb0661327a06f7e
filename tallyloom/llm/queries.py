"""The numbered operators as queries, and their SQL where SQL can express them."""

from __future__ import annotations

from tallyloom.llm import decontaminate, langid, linededup, lm, mixing, neardup, neighbours, phrases, pii, repeats, sharding, toxicity, turntrie
from tallyloom.llm.common import table


def op1_pii(spark, sf_dir):
    return pii.report(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark, sf_dir):
    return linededup.report(table(spark, sf_dir, "documents"))


def op3_nearest_neighbours(spark, sf_dir):
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op4_source_mix(spark, sf_dir):
    return mixing.balance(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_language_id(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents"))


def op6_minhash_neardup(spark, sf_dir):
    return neardup.cluster(table(spark, sf_dir, "documents"), shingle=2)


def op7_virtual_slots(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents"))


def op8_context_mixing(spark, sf_dir):
    return lm.score(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark, sf_dir):
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_suffix_dedup(spark, sf_dir):
    return repeats.report(table(spark, sf_dir, "documents"))


def op11_phrase_mining(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op12_conversation_trie(spark, sf_dir):
    return turntrie.report(table(spark, sf_dir, "conversations"))


def op13_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_pii, op2_line_dedup, op3_nearest_neighbours, op4_source_mix, op5_language_id, op6_minhash_neardup, op7_virtual_slots, op8_context_mixing, op9_decontaminate, op10_suffix_dedup, op11_phrase_mining, op12_conversation_trie, op13_toxicity)}

ORACLES = {
    "op2_line_dedup": linededup.oracle_sql(),
    "op4_source_mix": mixing.oracle_sql(),
    "op9_decontaminate": """
WITH norm AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
bn AS (
  SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(ws), 13) AS n, array_to_string(ws[i:i + least(len(ws), 13) - 1], ' ') AS win
  FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM bn WHERE len(ws) > 0)),
ls AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM norm, ls WHERE len(ws) >= n)),
h AS (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
c AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT norm.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws)) AS contaminated
FROM norm LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op11_phrase_mining": phrases.oracle_sql(),
    "op12_conversation_trie": turntrie.oracle_sql(),
}
