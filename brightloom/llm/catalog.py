"""Queries opN_<name> over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import functions as F

from brightloom.functions.runtime import shared_folder
from brightloom.llm import bpe, chat_format, decontaminate, embedding_dedup, fixity, hard_negatives, ngram_join, prefix_trie, quality_zstd, repeats, shards, token_files, toxicity

QUERIES, ORACLES = {}, {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_token_files(spark, folder):
    path = shared_folder(spark, "token-ids")
    token_files.write(table(spark, folder, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read(spark, path).drop("file", "ordinal")


@query
def op2_compression_quality(spark, folder):
    return quality_zstd.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op3_run_length_dedup(spark, folder):
    return repeats.report(table(spark, folder, "documents"))


@query
def op4_token_group_join(spark, folder):
    return ngram_join.join(table(spark, folder, "documents"))


@query
def op5_ring_shards(spark, folder):
    return shards.assign(table(spark, folder, "documents"))


@query
def op6_bpe_round_trip(spark, folder):
    return bpe.digests(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op7_lexicon_toxicity(spark, folder):
    return toxicity.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op8_prefix_decontamination(spark, folder):
    return decontaminate.report(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op8_prefix_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), iw AS (
  SELECT DISTINCT item, least(len(w), 10) AS size,
    unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i : i + least(len(w), 10) - 1], ' '))) AS t
  FROM b WHERE len(w) > 0
), dw AS (
  SELECT r, size, unnest(range(1, len(w) - size + 2)) AS s,
    unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS t
  FROM d, (SELECT DISTINCT size FROM iw) WHERE len(w) >= size
), m AS (
  SELECT r, s, size, item FROM dw JOIN iw USING (size, t)
), p AS (
  SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(s, s + size)) AS x FROM m) GROUP BY r
), n AS (
  SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN n USING (r)
"""


def damaged(records):
    """A replica that lost some records, has a byte of others changed, others cut short, and some a second time one byte on."""
    page, record = F.col("page_id"), F.col("record")
    bytes_now = F.when(page % 101 == 7, F.concat(F.encode(F.lit("WARC/1.1"), "UTF-8"), F.substring(record, 9, 1 << 30))).when(
        page % 103 == 11, F.substring(record, F.lit(1), F.octet_length(record) - 4)).otherwise(record)
    kept = records.where(F.coalesce(page % 211 != 3, F.lit(True))).withColumn("record", bytes_now)
    added = records.where(page % 307 == 5).withColumn("offset", F.col("offset") + 1)
    return kept.unionByName(added)


@query
def op9_fixity_audit(spark, folder):
    """The pages as two replicas of stored records, each read and hashed in its own pass; the second is damaged by rule."""
    replica = fixity.stored(table(spark, folder, "pages"))
    return fixity.audit(fixity.catalogue(replica), fixity.catalogue(damaged(replica)))


ORACLES["op9_fixity_audit"] = r"""
WITH body AS (
  SELECT page_id, 'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: '
    || coalesce(url, '') || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '') || '>'
    || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, ''))::VARCHAR || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
), laid AS (
  SELECT page_id, record, coalesce((page_id // 1000)::VARCHAR, 'none') AS file,
    coalesce(sum(strlen(record)) OVER (PARTITION BY page_id // 1000 ORDER BY page_id, sha256(record)
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM body
), second AS (
  SELECT file, "offset", CASE WHEN page_id % 101 = 7 THEN 'WARC/1.1' || substr(record, 9)
    WHEN page_id % 103 = 11 THEN left(record, length(record) - 4) ELSE record END AS record
  FROM laid WHERE coalesce(page_id % 211 <> 3, true)
  UNION ALL SELECT file, "offset" + 1, record FROM laid WHERE page_id % 307 = 5
), a AS (SELECT file, "offset", strlen(record) AS left_length, sha256(record) AS left_digest FROM laid
), b AS (SELECT file, "offset", strlen(record) AS right_length, sha256(record) AS right_digest FROM second
)
SELECT file, "offset", CASE WHEN right_digest IS NULL THEN 'missing' WHEN left_digest IS NULL THEN 'extra' ELSE 'corrupt' END AS status,
  left_length, right_length, left_digest, right_digest
FROM a FULL JOIN b USING (file, "offset") WHERE left_digest IS DISTINCT FROM right_digest OR left_length IS DISTINCT FROM right_length
"""


@query
def op10_small_world_dedup(spark, folder):
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


@query
def op11_bitmap_trie(spark, folder):
    turns, convs = prefix_trie.swapped_openings(prefix_trie.keyed_turns(table(spark, folder, "conversations")))
    return prefix_trie.with_end_digests(*prefix_trie.trie(turns, convs)).drop("p", "q")


ORACLES["op11_bitmap_trie"] = r"""
WITH crc_table AS (
  SELECT i, (WITH RECURSIVE s(k, v) AS (SELECT 0, i::BIGINT UNION ALL
    SELECT k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM s WHERE k < 8) SELECT v FROM s WHERE k = 8) AS v
  FROM range(256) t(i)
), crc_list AS (SELECT list(v ORDER BY i) AS l FROM crc_table
), t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda a, b: xor(a // 256, l[xor(a % 256, b) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM t), crc_list
), parts AS (
  SELECT c.conv_id, 0 AS part, t.pos, role, text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= h
  UNION ALL SELECT c.conv_id, 1, t.pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h
), r AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth FROM parts
), m AS (
  SELECT conv_id, depth, strlen(text) AS bytes, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM r
  UNION ALL SELECT conv_id, 0, 0, [] FROM c
), len AS (SELECT conv_id, max(depth) AS n FROM m GROUP BY ALL
), nodes AS (
  SELECT depth, prefix, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    string_agg(CASE WHEN n = depth THEN conv_id::VARCHAR END, ',' ORDER BY conv_id) AS ends
  FROM m JOIN len USING (conv_id) GROUP BY depth, prefix
), member AS (
  SELECT m.conv_id AS member, m.depth, nodes.conv_id FROM m JOIN nodes USING (depth, prefix)
), linked AS (
  SELECT nodes.*, up.conv_id AS parent_conv_id FROM nodes LEFT JOIN member up ON up.member = nodes.conv_id AND up.depth = nodes.depth - 1
), kids AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL
), full_nodes AS (
  SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN kids USING (conv_id, depth)
), sums AS (
  SELECT a.conv_id, a.depth, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved_tokens
  FROM full_nodes u JOIN member a ON a.member = u.conv_id AND a.depth <= u.depth GROUP BY ALL
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM full_nodes JOIN sums USING (conv_id, depth)
"""


@query
def op12_budgeted_windows(spark, folder):
    """With a conversation whose texts consist of control strings."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    ranks = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    return chat_format.digests(given, ranks, public_tokenizers.PATTERN)


@query
def op13_one_bit_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


ORACLES["op13_one_bit_negatives"] = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, o.vec_id, o.label, list_inner_product(a.v, o.v)::BIGINT AS score
  FROM e a, e o WHERE a.vec_id % 100 = 0 AND a.vec_id <> o.vec_id
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INT AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE label <> anchor_label AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) <= 10
"""
