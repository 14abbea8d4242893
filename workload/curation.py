"""Curation, sampling and splits over ``documents``.

A document stands for a sample: its text is the transcript and its length the
recording, a tenth of a second per character.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from scribeframe.functions.text import not_blank
from scribeframe.operators import curate, sampling
from scribeframe.session import release, stage
from workload.registry import micro, micro_sql, query, strict_sql, strip_sql, table

RATE = 16_000
FRAMES_PER_CHAR = RATE // 10
QUOTA = 5
SHARES = {"src0": 0.4, "src1": 0.4, "src2": 0.2}


def samples(spark, sf_dir):
    """``id, source, text, frames, duration`` of every document; every ninth has a decode error."""
    frames = F.col("n_chars") * FRAMES_PER_CHAR
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("doc_"), F.col("doc_id")).alias("id"),
        "source",
        "text",
        frames.alias("frames"),
        (frames / RATE).alias("duration"),
        F.when(F.col("doc_id") % 9 == 0, "decode error").alias("audio_error"),
    )


def labelled(spark, sf_dir):
    return curate.label_rejects(samples(spark, sf_dir), audio_error="audio_error")


_DURATION = "(n_chars::DOUBLE * 1600.0::DOUBLE / 16000.0::DOUBLE)"
_LABELLED = f"""
  SELECT doc_id, 'doc_' || doc_id AS id, source, text, n_chars, {strict_sql('text')} AS normalized,
         {_DURATION} AS duration,
         CASE WHEN length({strip_sql('text')}) = 0 THEN 'empty text'
              WHEN {strict_sql('text')} = '' THEN 'empty after normalisation'
              WHEN doc_id % 9 = 0 THEN 'audio error'
              WHEN {_DURATION} < 10 THEN 'too short'
              WHEN {_DURATION} > 600 THEN 'too long' END AS reason
  FROM documents"""
_METADATA = f"""
  SELECT id, source, 'benchmark/education/audio/' || id || '.wav' AS audio_path,
         'benchmark/education/refs/' || id || '.txt' AS ref_path,
         (floor((n_chars * 1600 * 200 + 16000) // 32000)::DOUBLE / 100.0::DOUBLE) AS duration,
         16000::INTEGER AS sampling_rate
  FROM ({_LABELLED}) WHERE reason IS NULL"""


@query("clean_corpus", f"SELECT id, source, normalized, {micro_sql('duration')} AS duration FROM ({_LABELLED}) WHERE reason IS NULL")
def clean_corpus(spark, sf_dir):
    kept = curate.kept_rows(labelled(spark, sf_dir))
    return kept.select("id", "source", "normalized", micro(F.col("duration")).alias("duration"))


@query("rejects", f"SELECT id, source, reason FROM ({_LABELLED}) WHERE reason IS NOT NULL")
def rejects(spark, sf_dir):
    return curate.rejected_rows(labelled(spark, sf_dir)).select("id", "source", "reason")


@query(
    "corpus_filters",
    f"""SELECT doc_id, normalized FROM ({_LABELLED})
        WHERE length({strip_sql('text')}) >= 10 AND normalized <> '' AND doc_id % 9 <> 0
          AND duration BETWEEN 10 AND 600""",
)
def corpus_filters(spark, sf_dir):
    """The row filters one after another, without reasons."""
    rows = samples(spark, sf_dir).withColumn("audio", F.when(F.col("audio_error").isNull(), F.lit("x")))
    rows = curate.with_audio_and_text(curate.drop_empty_text(rows))
    rows = curate.duration_in_range(curate.minimum_length(rows))
    return curate.drop_empty_normalized(rows).select("doc_id", "normalized")


def metadata(spark, sf_dir):
    return curate.metadata_rows(curate.kept_rows(labelled(spark, sf_dir)))


@query(
    "metadata_rows",
    f"SELECT id, source, audio_path, ref_path, {micro_sql('duration')} AS duration, sampling_rate FROM ({_METADATA})",
)
def metadata_rows(spark, sf_dir):
    return metadata(spark, sf_dir).withColumn("duration", micro(F.col("duration")))


@query(
    "corpus_summary",
    f"""SELECT CASE WHEN grouping(source) = 1 THEN 'TOTAL' ELSE source END AS source,
               grouping(source) = 1 AS is_total, count(*) AS files,
               {micro_sql('sum(duration) / 60.0::DOUBLE')} AS minutes
        FROM ({_METADATA}) GROUP BY ROLLUP (source)""",
)
def corpus_summary(spark, sf_dir):
    return curate.corpus_summary(metadata(spark, sf_dir)).withColumn("minutes", micro(F.col("minutes")))


_GOALS = ", ".join(f"('{name}', {share}::DOUBLE)" for name, share in SHARES.items())


@query(
    "mixture_report",
    f"""SELECT source, coalesce(files, 0) AS files, {micro_sql('share')} AS share,
               {micro_sql('target')} AS target, {micro_sql('share - target')} AS gap
        FROM (SELECT source, files, coalesce(files, 0)::DOUBLE / (SELECT count(*) FROM ({_METADATA}))::DOUBLE AS share,
                     target
              FROM (SELECT source, count(*) AS files FROM ({_METADATA}) GROUP BY source)
              FULL OUTER JOIN (VALUES {_GOALS}) goals(source, target) USING (source))""",
)
def mixture_report(spark, sf_dir):
    report = curate.mixture_report(metadata(spark, sf_dir), SHARES)
    return report.withColumns({c: micro(F.col(c)) for c in ("share", "target", "gap")})


@query(
    "validate",
    f"""SELECT id, 'Missing audio: ' || audio_path AS error FROM ({_METADATA}) WHERE id LIKE '%7'
        UNION ALL
        SELECT id, 'Missing reference: ' || ref_path FROM ({_METADATA}) WHERE id LIKE '%33'
        UNION ALL
        SELECT id, 'Invalid duration for ' || id || ': 0.0s' FROM ({_METADATA}) WHERE id LIKE '%55'""",
)
def validate(spark, sf_dir):
    """Listings by URI that lack some files, and metadata with some durations missing."""
    rows = metadata(spark, sf_dir)
    there = F.concat(F.lit("file:/srv//corpus/"), F.col("audio_path"))
    audio = rows.filter(~F.col("id").endswith("7")).select(there.alias("path"))
    there = F.concat(F.lit("file:///srv/corpus/"), F.col("ref_path"))
    refs = rows.filter(~F.col("id").endswith("33")).select(there.alias("path"))
    damaged = rows.withColumn("duration", F.when(~F.col("id").endswith("55"), F.col("duration")))
    return curate.validate(damaged, audio, refs, root="/srv/corpus")


def _quota_sql(inner: str, outer: str) -> str:
    return f"""SELECT doc_id, source FROM (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM ({_LABELLED}) {inner})
        WHERE place <= {QUOTA} {outer}"""


def _quota(when: str, sql: str):
    @query(f"source_quota_{when}", sql)
    def run(spark, sf_dir):
        rows = labelled(spark, sf_dir).select("doc_id", "source", "reason")
        chosen = sampling.quota(rows, "source", "doc_id", QUOTA, F.col("reason").isNull(), when)
        return chosen.select("doc_id", "source")


_quota("before", _quota_sql("", "AND reason IS NULL"))
_quota("after", _quota_sql("WHERE reason IS NULL", ""))


@query("first_rows", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 25")
def first_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.first_n(rows, "doc_id", 25)


@query(
    "positional_slice",
    """SELECT doc_id, source, place - total // 3 AS position
       FROM (SELECT doc_id, source, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS total
             FROM documents)
       WHERE place >= total // 3 AND place < total // 3 + 8""",
)
def positional_slice(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return sampling.positional_slice(rows, "doc_id")


_IDS = """SELECT doc_id, source, format('{}_{:02d}', source,
            row_number() OVER (PARTITION BY source ORDER BY doc_id)) AS id"""


def _ids(rows):
    placed = sampling.sample_ids(rows.select("doc_id", "source"), "x", "doc_id", within="source")
    return placed.withColumn("id", F.concat("source", F.substring("id", 2, 100)))


@query("sample_ids_gapped", f"SELECT doc_id, id FROM ({_IDS}, reason FROM ({_LABELLED})) WHERE reason IS NULL")
def sample_ids_gapped(spark, sf_dir):
    rows = labelled(spark, sf_dir).select("doc_id", "source", "reason")
    return _ids(rows).join(curate.kept_rows(rows).select("doc_id"), "doc_id").select("doc_id", "id")


@query("sample_ids_dense", f"SELECT doc_id, id FROM ({_IDS} FROM ({_LABELLED}) WHERE reason IS NULL)")
def sample_ids_dense(spark, sf_dir):
    return _ids(curate.kept_rows(labelled(spark, sf_dir))).select("doc_id", "id")


_HASH = f"md5(doc_id::VARCHAR || '-{sampling.SEED}')"


@query(
    "seeded_shuffle",
    f"SELECT doc_id, row_number() OVER (ORDER BY {_HASH}, doc_id) - 1 AS position FROM documents",
)
def seeded_shuffle(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id")
    rows = rows.withColumn("place", sampling.shuffle_hash("doc_id"))
    return sampling.with_position(rows, ["place", "doc_id"]).select("doc_id", "position")


@query(
    "split_hash",
    f"""SELECT doc_id, CASE WHEN ('0x' || substr({_HASH}, 1, 8))::BIGINT < {int((1 - 0.95) * 2**32)}
               THEN 'test' ELSE 'train' END AS split FROM documents""",
)
def split_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.train_test_split(rows, "doc_id")


@query(
    "split_exact",
    f"""SELECT doc_id, CASE WHEN place <= ceil((1 - 0.95::DOUBLE) * total) THEN 'test' ELSE 'train' END AS split
        FROM (SELECT doc_id, row_number() OVER (ORDER BY {_HASH}, doc_id) AS place, count(*) OVER () AS total
              FROM documents)""",
)
def split_exact(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id")
    return sampling.train_test_split(rows, "doc_id", exact=True)


@query(
    "size_report",
    f"""SELECT split, count(*) AS loaded, count(*) FILTER (length({strip_sql('text')}) > 0) AS kept
        FROM (SELECT text, CASE WHEN ('0x' || substr({_HASH}, 1, 8))::BIGINT < {int((1 - 0.95) * 2**32)}
                     THEN 'test' ELSE 'train' END AS split FROM documents) GROUP BY split""",
)
def size_report(spark, sf_dir):
    """Rows loaded and kept, per side of the split."""
    rows = sampling.train_test_split(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return rows.groupBy("split").agg(
        F.count(F.lit(1)).alias("loaded"), F.count_if(not_blank(F.col("text"))).alias("kept")
    )


@query(
    "observed_size",
    f"""SELECT count(*) AS loaded, count(*) FILTER (kept) AS kept, count(*) FILTER (kept AND split = 'train') AS train,
               count(*) FILTER (kept AND split = 'test') AS test
        FROM (SELECT length({strip_sql('text')}) > 0 AS kept,
                     CASE WHEN ('0x' || substr({_HASH}, 1, 8))::BIGINT < {int((1 - 0.95) * 2**32)}
                     THEN 'test' ELSE 'train' END AS split FROM documents)""",
)
def observed_size(spark, sf_dir):
    """What writing the split table counted on its way; the table isn't read again for it."""
    rows = sampling.train_test_split(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    counted, seen = curate.size_report(rows, split="split")
    release(stage(counted, "split-documents"))
    names = ("loaded", "kept", "train", "test")
    return spark.createDataFrame([[seen.get[n] for n in names]], ", ".join(f"{n} bigint" for n in names))
