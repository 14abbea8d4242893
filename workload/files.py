"""Files written from the test tables by the executors and read back through the scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from scribeframe import sinks
from scribeframe.functions.text import strip
from scribeframe.functions.transcripts import unix_newlines
from scribeframe.operators.places import PATH, SPLIT, numbered, order_breaks, with_places
from scribeframe.session import fresh_path, spread, stage
from scribeframe.sources import corpus, files
from scribeframe.sources.listing import unlisted_names
from workload.registry import documents, query, strip_sql, table

_SAID = r"regexp_replace(coalesce(text, ''), '[^a-zA-Z ]', '', 'g')"


def _said():
    return F.regexp_replace(F.coalesce("text", F.lit("")), "[^a-zA-Z ]", "")


def _uri(path: str) -> str:
    return path if ":" in path.partition("/")[0] else f"file://{path}"


@query(
    "cue_rows",
    f"""SELECT conv_id, turn, start, "end", place,
               start - lag("end") OVER (PARTITION BY conv_id ORDER BY turn) AS gap, text
        FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (
          SELECT conv_id, turn, turn * 2.0::DOUBLE AS start,
                 turn * 2.0::DOUBLE + (length(coalesce(text, '')) % 7) / 2.0::DOUBLE AS "end", {strip_sql(_SAID)} AS text
          FROM conversations) WHERE text <> '')""",
)
def cue_rows(spark, sf_dir):
    """Conversations as timed lines, a range of them per file, read back cue by cue.

    ``place`` and ``gap`` follow from the order of the lines in the file alone.
    """
    turns = table(spark, sf_dir, "conversations").withColumn("said", _said())
    start = F.col("turn") * F.lit(2.0)
    end = start + F.length(F.coalesce("text", F.lit(""))) % 7 / F.lit(2.0)
    line = F.concat_ws(" ", "conv_id", "turn", F.lit("speaker"), start.cast("string"), end.cast("string"), "said")
    folder = fresh_path(spark, "cues")
    ordered = turns.repartitionByRange("conv_id").sortWithinPartitions("conv_id", "turn")
    ordered.select(line.alias("value")).write.text(folder)
    cues = stage(files.scan_stm_cues(spark, folder, pattern="*.txt"), "cue-rows")
    first = cues.groupBy("filename").agg(F.min("cue").alias("first"))
    return cues.join(first, "filename").select(
        F.col("filename").cast("bigint").alias("conv_id"),
        F.col("channel").cast("bigint").alias("turn"),
        "start",
        "end",
        (F.col("cue") - F.col("first") + 1).alias("place"),
        F.when(F.col("cue") > F.col("first"), F.col("gap")).alias("gap"),
        "text",
    )


@query(
    "exported_texts",
    f"""SELECT source || '/' || doc_id AS id, CASE WHEN length(coalesce(text, '')) > 0 THEN
               md5({strip_sql("regexp_replace(text, '\r\n?', '\n', 'g')")}) END AS text_md5,
               CASE WHEN length(coalesce(text, '')) = 0 THEN 'not listed' END AS reason FROM documents""",
)
def exported_texts(spark, sf_dir):
    """Every document as a text file of its own, found again by the id in the file's name."""
    docs = documents(spark, sf_dir, "source", "text").select(
        F.concat_ws("/", "source", "doc_id").alias("id"), "text"
    )
    folder = fresh_path(spark, "texts")
    sinks.export_reference_files(docs, _uri(folder))
    found = files.scan_references(spark, folder).select(
        sinks.id_of_stem(F.col("stem")).alias("id"), F.md5(F.encode("reference", "UTF-8")).alias("text_md5")
    )
    missed = unlisted_names(spark, folder).select(
        sinks.id_of_stem(F.regexp_replace("name", r"\.txt\z", "")).alias("id"),
        F.lit(None).cast("string").alias("text_md5"),
        F.lit("not listed").alias("reason"),
    )
    return found.withColumn("reason", F.lit(None).cast("string")).unionByName(missed)


_TIMED = "substr(md5(source), 1, 1) < '8'"


@query(
    "course_transcripts",
    f"""SELECT source AS course, doc_id::VARCHAR AS stem, CASE WHEN {_TIMED} THEN 'stm' ELSE 'trs' END AS kind,
               CASE WHEN length({strip_sql(_SAID)}) < 6 THEN 'too short' END AS reason FROM documents""",
)
def course_transcripts(spark, sf_dir):
    """A course per source. All have TRS files, half have STM files besides, and only those are read there.

    ``kind`` is told by the first word of the text, which names the file it came from.
    """
    docs = documents(spark, sf_dir, "source", "text").withColumn("said", strip(_said()))
    root = fresh_path(spark, "courses")
    timed = F.substring(F.md5(F.encode("source", "UTF-8")), 1, 1) < "8"
    forms = {
        ".trs": (docs, F.format_string("<Trans><Turn><Sync/>trs %s</Turn></Trans>", "said")),
        ".stm": (docs.filter(timed), F.format_string("f 1 s 0 1 stm %s", "said")),
    }
    for suffix, (rows, content) in forms.items():
        named = rows.select(F.col("doc_id").alias("id"), "source", content.alias("text"))
        sinks.export_reference_files(named, _uri(root) + "/data", suffix, folders=("source", F.lit(files.MANUAL_FOLDER)))
    found = files.discover_courses(spark, root)
    return found.select("course", "stem", F.substring("text", 1, 3).alias("kind"), "reason")


@query(
    "saved_once",
    """SELECT lang, count(*) AS documents, sum(length(coalesce(text, '')))::BIGINT AS chars,
              2::BIGINT AS builds, 1::BIGINT AS tables FROM documents GROUP BY lang""",
)
def saved_once(spark, sf_dir):
    """Sizes per language from a saved table that two callers build at the same time and a third one finds."""
    folder, data, built = fresh_path(spark, "saved"), [f"{sf_dir}/documents.parquet"], []

    def build():
        built.append(True)
        if len(built) == 1:  # another caller starts and ends while this one is at work
            save()
        return table(spark, sf_dir, "documents").groupBy("lang").agg(
            F.count(F.lit(1)).alias("documents"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars")
        )

    def save():
        return sinks.materialize_once(spark, folder, {"by": "lang"}, build, data)

    save()
    kept = save()
    tables = {name.rpartition("/")[0] for name in kept.inputFiles()}
    return kept.withColumns(
        {"builds": F.lit(len(built)).cast("bigint"), "tables": F.lit(len(tables)).cast("bigint")}
    )


@query("first_whole_source", "SELECT doc_id, lang, 'whole' AS actual_source FROM documents")
def first_whole_source(spark, sf_dir):
    """Three sources of the documents: one isn't there, one breaks off among its rows, the last is whole."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    torn = F.when(F.col("doc_id") % 5 == 4, F.raise_error(F.lit("damaged row")).cast("string")).otherwise(F.col("lang"))
    return corpus.read_first_whole(
        spark,
        [
            corpus.Source("absent", lambda s: table(s, sf_dir, "no_such_table")),
            corpus.Source("torn", lambda s: docs.withColumn("lang", torn)),
            corpus.Source("whole", lambda s: docs),
        ],
    )


@query(
    "report_order",
    """SELECT doc_id, row_number() OVER (ORDER BY lang NULLS FIRST, doc_id) AS number, 0::BIGINT AS breaks FROM documents""",
)
def report_order(spark, sf_dir):
    """A report sorted and written by many tasks: the place of each row, and how many rows stand out of order."""
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id")
    report = stage(spread(docs, "doc_id").orderBy("lang", "doc_id"), "report")
    written = stage(with_places(report), "report-places")
    breaks = order_breaks(written, "lang", "doc_id").count()
    placed = numbered(written, groups=(), splits=(PATH, SPLIT))
    return placed.select("doc_id", "number", F.lit(breaks).cast("bigint").alias("breaks"))
