"""Queries of near-duplicate detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribeframe.llm.embedding_dedup import near_duplicate_vectors
from scribeframe.llm.registry import query, table
from scribeframe.llm.simhash import near_duplicates


@query("op2_simhash")
def simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


EMBEDDING_SQL = """
WITH RECURSIVE usable AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
    ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least ON least.a = e.vec_id LEFT JOIN counts ON counts.a = e.vec_id"""


@query("op5_embedding_dedup", EMBEDDING_SQL)
def embedding_dedup(spark, sf_dir):
    found = near_duplicate_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    return found.withColumn("kept", kept)
