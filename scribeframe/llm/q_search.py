"""Queries of exact search and of hard-negative mining."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribeframe.llm.hard_negatives import mine_negatives
from scribeframe.llm.registry import query, table
from scribeframe.llm.topk_search import top_scores

EVERY = 50

#: All pairs of queries and rows, by integer inner products.
_WHOLE = """
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"""
TOP_SQL = f"""
WITH rows AS ({_WHOLE}),
pairs AS (
  SELECT q.vec_id AS query_id, r.vec_id, list_inner_product(q.x, r.x)::BIGINT AS score
  FROM rows q JOIN rows r ON q.vec_id <> r.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
WHERE rank <= 5"""

MINED_SQL = f"""
WITH rows AS (
  SELECT vec_id, x, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label
  FROM ({_WHOLE}) WHERE label IS NOT NULL),
pairs AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, list_inner_product(a.x, r.x)::BIGINT AS score
  FROM rows a JOIN rows r ON a.vec_id <> r.vec_id WHERE a.vec_id % {EVERY} = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
    SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place FROM pairs WHERE same)
  WHERE place <= 5),
negatives AS (
  SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS rank
  FROM positives p JOIN pairs n ON n.anchor_id = p.anchor_id AND NOT n.same
    AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score
FROM negatives WHERE rank <= 3"""


@query("op12_topk_search", TOP_SQL)
def topk_search(spark, sf_dir):
    return top_scores(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), EVERY)


@query("op13_hard_negatives", MINED_SQL)
def hard_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.withColumn("label", moved), EVERY)
