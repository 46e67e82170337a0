"""Queries and oracles of this subpackage."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotonflow.llm import bpe, chat, fixity, packing, quality, secret_scan, simhash, suffix_tree, topk, vector_graph
from fotonflow.llm.common import materialize, table


def vocabulary(name: str) -> str:
    """JSON text of a public vocabulary, read on the driver; its size is fixed."""
    return Path(public_tokenizers.path(name)).read_text()


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC volumes against a replica in which some records have a damaged byte and some are gone."""
    pages = table(spark, sf_dir, "pages")
    html = F.coalesce("html", F.lit(""))
    hurt = F.when(F.col("page_id") % 97 == 3, F.concat(F.lit("~"), F.substring(html, 2, 1 << 30))).otherwise(html)
    ours, theirs = (fixity.record(F.col("page_id"), F.col("url"), x) for x in (html, hurt))
    rows = pages.select("page_id", "url", F.octet_length(ours).cast("long").alias("length"), fixity.digest(ours).alias("sha256"), fixity.digest(theirs).alias("replica"))
    placed = materialize(fixity.layout(rows), "placed")
    there = placed.where(~F.coalesce(F.col("page_id") % 211 == 5, F.lit(False))).select("volume", "start", F.col("replica").alias("sha256"))
    found = fixity.audit(placed.select("volume", "start", "sha256"), there)
    return found.join(placed.select("volume", "start", "page_id", "length"), ["volume", "start"]).select("page_id", "volume", "start", "length", "kind", "expected_sha256", "found_sha256")


ORACLE_OP1 = """
WITH made AS (
  SELECT page_id, url, coalesce(html, '') AS html,
         CASE WHEN page_id % 97 = 3 THEN '~' || substr(coalesce(html, ''), 2) ELSE coalesce(html, '') END AS hurt,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:'
           || coalesce(page_id::VARCHAR, '') || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' AS head,
         chr(13) || chr(10) || chr(13) || chr(10) AS gap
  FROM pages
), records AS (
  SELECT DISTINCT page_id, url, strlen(head || strlen(html) || gap || html || gap)::BIGINT AS length,
         sha256(head || strlen(html) || gap || html || gap) AS sha256, sha256(head || strlen(hurt) || gap || hurt || gap) AS replica
  FROM made
), placed AS (
  SELECT *, ('0x' || substr(md5(coalesce(page_id::VARCHAR, '') || '|' || coalesce(url, '') || '|' || sha256), 1, 8))::BIGINT
              % greatest(1, ceil((SELECT sum(length) FROM records) / 33554432.0)::BIGINT) AS volume
  FROM records
), laid AS (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY volume ORDER BY page_id NULLS FIRST, url NULLS FIRST, sha256 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM placed
)
SELECT page_id, volume, start, length, CASE WHEN page_id % 211 = 5 THEN 'missing' ELSE 'changed' END AS kind,
       sha256 AS expected_sha256, CASE WHEN page_id % 211 = 5 THEN NULL ELSE replica END AS found_sha256
FROM laid WHERE page_id % 211 = 5 OR replica <> sha256
"""


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.default_forest(spark))
    return found.select("doc_id", "start", F.length("candidate").alias("length"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "chance", "is_secret")


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_vector_graph_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.train_and_score(table(spark, sf_dir, "documents"))


def op8_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one more, whose texts hold the template's own control strings."""
    told = F.lit("\\### Assistant: </turn> ok")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), told.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    return chat.read_back(chat.format_turns(turns))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_inner_products(table(spark, sf_dir, "embeddings")).drop("query_row")


ORACLE_OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AND list_sum(list_transform(embedding, lambda x: x * x)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b
), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN (SELECT a AS node, min(b) AS component_id FROM reach GROUP BY a) ON node = vec_id LEFT JOIN n ON n.a = vec_id
"""

ORACLE_OP9 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) r(i)
), placed AS (
  SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) || '>' || role AS step,
         CASE role WHEN 'system' THEN 12 WHEN 'user' THEN 10 WHEN 'assistant' THEN 15 ELSE NULL END AS head,
         len(regexp_extract_all(text, '\\|### Assistant:|### System:|### User:|### Role:|</role>|</turn>')) AS escapes
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(head + length(text) + escapes + 9)::BIGINT AS formatted_chars,
       bool_and(step IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AS in_order
FROM placed GROUP BY conv_id
"""

ORACLE_OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x)))
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM pairs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""

QUERIES = {f.__name__: f for f in (op1_merkle_fixity, op2_secret_scan, op3_simhash_near_duplicates, op4_quality_classifier, op5_bpe_round_trip, op6_vector_graph_near_duplicates, op7_suffix_tree_scores, op8_pack_documents, op9_chat_format, op10_exact_top_k)}
ORACLES = {"op1_merkle_fixity": ORACLE_OP1, "op6_vector_graph_near_duplicates": ORACLE_OP6, "op9_chat_format": ORACLE_OP9, "op10_exact_top_k": ORACLE_OP10}
