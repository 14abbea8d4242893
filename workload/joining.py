"""Matching, columns, unions, batches and transcript formats over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribeframe.functions.text import words
from scribeframe.functions.transcripts import stm_transcript, subtitle_transcript
from scribeframe.operators import batches, curate, match
from workload.registry import micro, micro_sql, query, squeeze_sql, strip_sql, table

EXTENSIONS = ("ogg", "m4a", "flac", "mp3", "wav")


def recordings(spark, sf_dir):
    """Audio listed beside documents: the extensions and folders follow from the id.

    Every eleventh document's recordings have a stem that no transcript has.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("subset"))
    copies = docs.withColumn("n", F.explode(F.sequence(F.lit(0), F.col("doc_id") % 4)))
    extension = F.get(F.array(*map(F.lit, EXTENSIONS)), ((F.col("doc_id") * 3 + F.col("n") * 2) % 5).cast("int"))
    stem = F.concat(F.when(F.col("doc_id") % 11 == 0, "spare").otherwise("s"), F.col("doc_id"))
    rows = copies.select(
        "subset", stem.alias("stem"), extension.alias("extension"), ((F.col("doc_id") + F.col("n")) % 3).cast("int").alias("folder_rank")
    )
    name = F.concat_ws("/", F.lit("/data"), "subset", F.col("folder_rank").cast("string"), F.concat("stem", F.lit("."), "extension"))
    return rows.withColumn("path", name).withColumn("audio_file", F.concat("stem", F.lit("."), "extension"))


def transcripts(spark, sf_dir):
    """A transcript per document; every seventh has a stem that no recording has."""
    stem = F.concat(F.when(F.col("doc_id") % 7 == 0, "silent").otherwise("s"), F.col("doc_id"))
    return table(spark, sf_dir, "documents").select(
        F.col("lang").alias("subset"), stem.alias("stem"), F.col("text").alias("reference")
    )


_RECORDINGS = """
  SELECT *, '/data/' || subset || '/' || folder_rank || '/' || stem || '.' || extension AS path,
         stem || '.' || extension AS audio_file
  FROM (SELECT lang AS subset, if(doc_id % 11 = 0, 'spare', 's') || doc_id AS stem, (doc_id + n) % 3 AS folder_rank,
               ['ogg', 'm4a', 'flac', 'mp3', 'wav'][(doc_id * 3 + n * 2) % 5 + 1] AS extension
        FROM (SELECT doc_id, lang, unnest(range(doc_id % 4 + 1)) AS n FROM documents))"""
_TRANSCRIPTS = """
  SELECT lang AS subset, if(doc_id % 7 = 0, 'silent', 's') || doc_id AS stem, text AS reference FROM documents"""


@query(
    "match_references",
    f"""SELECT a.path, a.subset, a.stem, r.reference,
               CASE WHEN r.stem IS NULL THEN 'no reference' END AS reason
        FROM ({_RECORDINGS}) a LEFT JOIN ({_TRANSCRIPTS}) r ON r.subset = a.subset AND r.stem = a.stem""",
)
def match_references(spark, sf_dir):
    found = match.match_audio_references(recordings(spark, sf_dir), transcripts(spark, sf_dir))
    return found.select("path", "subset", "stem", "reference", "reason")


def _preferred_sql(order: tuple[str, ...], folder: str) -> str:
    rank = "CASE extension " + " ".join(f"WHEN '{e}' THEN {k + 1}" for k, e in enumerate(order)) + " END"
    return f"""
      SELECT t.subset, t.stem, best.path AS audio_path,
             CASE WHEN best.path IS NULL THEN 'no audio' END AS reason
      FROM ({_TRANSCRIPTS}) t LEFT JOIN (
        SELECT subset, stem, path FROM (
          SELECT *, row_number() OVER (PARTITION BY subset, stem ORDER BY {folder}{rank}, path) AS place
          FROM ({_RECORDINGS}) WHERE {rank} IS NOT NULL) WHERE place = 1) best
      ON best.subset = t.subset AND best.stem = t.stem"""


@query("extension_preference", _preferred_sql(match.TRANSCRIPT_AUDIO, ""))
def extension_preference(spark, sf_dir):
    found = match.attach_preferred_audio(
        transcripts(spark, sf_dir), recordings(spark, sf_dir), keys=("subset", "stem")
    )
    return found.select("subset", "stem", "audio_path", "reason")


@query("candidate_dirs", _preferred_sql(match.COURSE_AUDIO, "folder_rank, "))
def candidate_dirs(spark, sf_dir):
    found = match.attach_preferred_audio(
        transcripts(spark, sf_dir),
        recordings(spark, sf_dir),
        keys=("subset", "stem"),
        order=match.COURSE_AUDIO,
        folder_rank="folder_rank",
    )
    return found.select("subset", "stem", "audio_path", "reason")


def _semi_sql(sign: str) -> str:
    return f"""SELECT stem, reference FROM ({_TRANSCRIPTS}) t WHERE {sign} EXISTS (
        SELECT 1 FROM ({_RECORDINGS}) a WHERE a.stem = t.stem AND extension <> 'ogg')"""


@query("text_semi_join", _semi_sql(""))
def text_semi_join(spark, sf_dir):
    found = match.texts_with_audio(transcripts(spark, sf_dir), recordings(spark, sf_dir))
    return found.select("stem", "reference")


@query("text_anti_join", _semi_sql("NOT"))
def text_anti_join(spark, sf_dir):
    found = match.texts_without_audio(transcripts(spark, sf_dir), recordings(spark, sf_dir))
    return found.select("stem", "reference")


@query(
    "resolve_columns",
    """SELECT doc_id, source AS audio, coalesce(nullif(CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN lang END, ''),
              nullif(text, '')) AS text FROM documents""",
)
def resolve_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        F.col("source").alias("speech"),
        F.when(F.col("doc_id") % 3 == 0, "").when(F.col("doc_id") % 3 == 1, F.col("lang")).alias("transcription"),
        "text",
    )
    return curate.resolve_columns(docs, keep=["doc_id"])


@query(
    "select_corpus",
    "SELECT source AS audio, text FROM documents",
)
def select_corpus(spark, sf_dir):
    return curate.select_corpus(table(spark, sf_dir, "documents"), "source", "text")


@query(
    "union_sources",
    """SELECT source, count(*) AS samples, count(url) AS with_url FROM (
         SELECT 'documents' AS source, doc_id AS id, NULL AS url FROM documents
         UNION ALL SELECT 'pages', page_id, url FROM pages
         UNION ALL SELECT 'pages', page_id, url FROM pages) GROUP BY source""",
)
def union_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("documents").alias("source"), F.col("doc_id").alias("id"))
    pages = table(spark, sf_dir, "pages").select("url", F.lit("pages").alias("source"), F.col("page_id").alias("id"))
    everything = curate.union_sources(docs, pages, pages)
    return everything.groupBy("source").agg(
        F.count(F.lit(1)).alias("samples"), F.count("url").alias("with_url")
    )


BATCH = 8


def labels(spark, sf_dir):
    """Every turn as a row of labels: a start token, then the length of each word.

    In every fourth conversation the turns lack the start token.
    """
    turns = table(spark, sf_dir, "conversations").select(
        F.format_string("%d-%d", "conv_id", "turn").alias("id"), "conv_id", words(F.col("text")).alias("w")
    )
    sizes = F.transform("w", lambda w: F.length(w))
    start = F.when(F.col("conv_id") % 40 == 0, F.array().cast("array<int>")).otherwise(F.array(F.lit(1)))
    return turns.select("id", F.concat(start, sizes).alias("labels")).withColumn("input_length", F.size("labels"))


def grouped(spark, sf_dir):
    return batches.length_groups(labels(spark, sf_dir), "id", batch_size=BATCH)


_LABELS = """
  SELECT id, labels, len(labels) AS input_length FROM (
    SELECT conv_id || '-' || turn AS id,
           CASE WHEN conv_id % 40 = 0 THEN [] ELSE [1] END
             || list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x: length(x)::INTEGER) AS labels
    FROM conversations)"""
_GROUPED = f"""
  SELECT *, (row_number() OVER (PARTITION BY chunk ORDER BY input_length DESC, id) - 1) // {BATCH} AS batch FROM (
    SELECT *, ('0x' || substr(md5(id || '-42'), 1, 8))::BIGINT
                % greatest(1, (SELECT count(*) FROM conversations) // {BATCH * 50}) AS chunk
    FROM ({_LABELS}))"""
_PADDED = f"""
  SELECT *, labels || list_transform(range(longest - len(labels)), lambda x: -100) AS padded FROM (
    SELECT *, max(len(labels)) OVER (PARTITION BY chunk, batch) AS longest,
           bool_and(coalesce(labels[1] = 1, false)) OVER (PARTITION BY chunk, batch) AS every_start
    FROM ({_GROUPED}))"""


def _joined(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), " ")


@query("length_groups", f"SELECT id, input_length::INTEGER AS input_length, chunk, batch FROM ({_GROUPED})")
def length_groups(spark, sf_dir):
    return grouped(spark, sf_dir).select("id", "input_length", "chunk", "batch")


@query("pad_labels", f"SELECT id, array_to_string(padded, ' ') AS labels FROM ({_PADDED})")
def pad_labels(spark, sf_dir):
    padded = batches.pad_labels(grouped(spark, sf_dir))
    return padded.select("id", _joined("labels").alias("labels"))


@query(
    "drop_start",
    f"""SELECT id, array_to_string(CASE WHEN every_start THEN padded[2:] ELSE padded END, ' ') AS labels
        FROM ({_PADDED})""",
)
def drop_start(spark, sf_dir):
    padded = batches.drop_start_token(batches.pad_labels(grouped(spark, sf_dir)), 1)
    return padded.select("id", _joined("labels").alias("labels"))


@query(
    "unmask",
    f"""SELECT id, array_to_string(list_transform(padded, lambda x: CASE WHEN x = -100 THEN 0 ELSE x END), ' ') AS labels
        FROM ({_PADDED})""",
)
def unmask(spark, sf_dir):
    padded = batches.pad_labels(grouped(spark, sf_dir))
    plain = padded.withColumn("labels", batches.unmask_labels(F.col("labels"), 0))
    return plain.select("id", _joined("labels").alias("labels"))


@query(
    "padding_waste",
    f"""SELECT count(*) AS batches, sum(n)::BIGINT AS rows, sum(units)::BIGINT AS real_units,
               sum(n * longest)::BIGINT AS padded_units,
               {micro_sql('1 - sum(units)::DOUBLE / sum(n * longest)::DOUBLE')} AS waste
        FROM (SELECT count(*) AS n, sum(input_length) AS units, max(input_length) AS longest
              FROM ({_GROUPED}) GROUP BY chunk, batch)""",
)
def padding_waste(spark, sf_dir):
    waste = batches.padding_waste(grouped(spark, sf_dir))
    return waste.withColumn("waste", micro(F.col("waste")))


def _rendered(spark, sf_dir, line):
    """One file's content per conversation, a line or cue per turn in order."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", line.alias("line")).alias("t"))
    ordered = F.array_sort(F.collect_list("t"))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: t["line"]).alias("lines"))


@query(
    "stm_roundtrip",
    f"""SELECT conv_id, string_agg(said, ' ' ORDER BY turn) AS text FROM (
          SELECT conv_id, turn, {strip_sql("regexp_replace(text, '[^a-zA-Z ]', '', 'g')")} AS said FROM conversations)
        GROUP BY conv_id""",
)
def stm_roundtrip(spark, sf_dir):
    """Conversations written as timed lines with comments and short lines, read back."""
    said = F.regexp_replace("text", "[^a-zA-Z ]", "")
    line = F.concat(
        F.format_string("f%d 1 %s %d.5 %d  ", "conv_id", "role", "turn", F.col("turn") + 1), said, F.lit(" ")
    )
    files = _rendered(spark, sf_dir, line)
    noise = F.array(F.lit(";; a comment"), F.lit(""), F.lit("f 1 spk 2.5 3"))
    content = F.array_join(F.concat(noise, "lines", noise), "\r\n")
    return files.select("conv_id", stm_transcript(content).alias("text"))


def _subtitles_sql() -> str:
    said = squeeze_sql("regexp_replace(text, '[<>\n]', ' ', 'g')")
    return f"""SELECT conv_id, string_agg(said, ' ' ORDER BY turn) AS text FROM (
          SELECT conv_id, turn, {said} AS said FROM conversations) GROUP BY conv_id"""


@query("subtitle_roundtrip", _subtitles_sql())
def subtitle_roundtrip(spark, sf_dir):
    """Conversations written as numbered cues with mark-up, read back."""
    said = F.regexp_replace("text", "[<>\n]", " ")
    cue = F.concat(
        F.format_string("%d\n00:00:%02d,000 --> 00:00:%02d,500\n<i>", F.col("turn") + 1, "turn", "turn"),
        said,
        F.lit("</i>\n"),
    )
    files = _rendered(spark, sf_dir, cue)
    return files.select("conv_id", subtitle_transcript(F.array_join("lines", "\n")).alias("text"))
