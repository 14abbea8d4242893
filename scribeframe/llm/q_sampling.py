"""Query of importance resampling."""

from __future__ import annotations

from scribeframe.llm.importance import resample
from scribeframe.llm.registry import query, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _features(name: str, key: str) -> str:
    """Every text's words and the list of its features."""
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
  SELECT *, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS f
  FROM (SELECT {key}, {words} AS w FROM {name})"""


#: The CRC goes bit by bit over the bytes of each distinct feature: a byte enters at
#: every eighth step.
SQL = f"""
WITH docs AS MATERIALIZED (
  SELECT *, row_number() OVER () AS place FROM ({_features("documents", "doc_id")})),
aims AS MATERIALIZED ({_features("benchmark", "item_id")}),
spelled AS (
  SELECT f, hex(encode(f)) AS x
  FROM (SELECT DISTINCT f FROM (SELECT unnest(f) AS f FROM docs UNION ALL SELECT unnest(f) FROM aims))),
buckets AS MATERIALIZED (
  SELECT f, (xor(4294967295, list_reduce(
    list_transform(range(0, 4 * len(x)),
      lambda i: CASE WHEN i % 8 = 0 THEN ('0x' || substr(x, i // 4 + 1, 2))::BIGINT ELSE 0 END),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1)), 4294967295::BIGINT)) % 10000)::BIGINT AS bucket
  FROM spelled),
own AS MATERIALIZED (SELECT place, bucket FROM (SELECT place, unnest(f) AS f FROM docs) JOIN buckets USING (f)),
sources AS (SELECT bucket, count(*) AS s FROM own GROUP BY bucket),
targets AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(f) AS f FROM aims) JOIN buckets USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0) + 1) * ((SELECT sum(s) FROM sources) + 10000))::DOUBLE
    / ((s + 1) * ((SELECT coalesce(sum(t), 0) FROM targets) + 10000))::DOUBLE))::BIGINT AS gain
  FROM sources LEFT JOIN targets USING (bucket)),
means AS (SELECT place, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM own JOIN gains USING (bucket) GROUP BY place),
scored AS (
  SELECT doc_id, len(w) AS n_words, len(f)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN means USING (place)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place,
    25 * (count(*) FILTER (n_words >= 20) OVER ()) // 100 AS most FROM scored)
SELECT doc_id, n_features, weight, score::BIGINT AS score,
  CASE WHEN n_words >= 20 AND place <= most THEN place END AS rank
FROM ranked"""


@query("op11_importance", SQL)
def importance(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return resample(docs, table(spark, sf_dir, "benchmark", "text"))
