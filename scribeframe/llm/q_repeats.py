"""Query of suffix-array dedup."""

from __future__ import annotations

from scribeframe.llm.registry import query, table
from scribeframe.llm.suffix_dedup import NONE, removal_digests

#: Two hexadecimal digits per byte; strings of 200 bytes are 400 digits.
SQL = """
WITH docs AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
blocks AS (
  SELECT doc_id, b, substr(x, 2 * b + 1, 910) AS y
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 199, 256)) AS b FROM docs WHERE length(x) >= 400)),
starts AS (
  SELECT doc_id, b, y, unnest(range(0, least(256, length(y) // 2 - 199))) AS k FROM blocks),
strings AS (
  SELECT doc_id, b + k AS pos, md5_number(substr(y, 2 * k + 1, 400)) AS s FROM starts),
repeated AS (
  SELECT doc_id, pos FROM strings
  WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)),
steps AS (
  SELECT doc_id, pos, pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS gap FROM repeated),
numbered AS (
  SELECT doc_id, pos,
    sum(CASE WHEN gap <= 200 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM steps),
runs AS (
  SELECT doc_id, run, min(pos) AS a, max(pos) + 200 AS b FROM numbered GROUP BY doc_id, run),
pieces AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
kept AS (
  SELECT p.doc_id, count(*)::BIGINT AS n_spans, sum(b - a)::BIGINT AS n_removed,
    string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a)
      || substr(any_value(x), 2 * max(b) + 1) AS left_over
  FROM pieces p JOIN docs ON docs.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed,
  coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_over, x))) AS kept_sha256
FROM docs d LEFT JOIN kept ON kept.doc_id = d.doc_id"""


@query("op3_suffix_dedup", SQL)
def suffix_dedup(spark, sf_dir):
    return removal_digests(table(spark, sf_dir, "documents", "doc_id", "text"), keep=NONE)
