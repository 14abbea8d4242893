"""File-tree scans.

Spark lists the folders and gives each task its share of the files; text, STM,
TRS and subtitle files, which may be many, are listed by tasks as well
(``sources/listing.py``). Names that start with ``.`` or ``_`` and empty files
are never listed; ``unlisted_files`` names them, and ``scan_benchmark`` puts them among its warnings. Keys come from the path: ``stem`` is
the file name without its suffix, ``subset`` the folder two levels up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from scribeframe.functions.audio import duration_rounded, duration_seconds, wav_full_facts, wav_head_facts
from scribeframe.functions.text import file_name, file_stem, path_segment, strip
from scribeframe.functions.transcripts import (
    stm_field,
    stm_text,
    stm_transcript,
    subtitle_transcript,
    trs_transcript,
    unix_newlines,
)
from scribeframe.operators.curate import MIN_TEXT_LENGTH, SAMPLING_RATE
from scribeframe.operators.match import COURSE_AUDIO, TRANSCRIPT_AUDIO, attach_preferred_audio, texts_with_audio
from scribeframe.operators.places import PATH, RANK, SPLIT, numbered, with_places
from scribeframe.session import stage
from scribeframe.sources.listing import folders_with, scan_files
from scribeframe.storage import literally, matches, matching_folders, path_exists, unlisted_files

# Audio extensions (lower or all upper case), the course folder
# left out, and the folder names of the trees.
AUDIO_EXTENSIONS = ("wav", "mp3", "flac", "m4a", "ogg")
INCOMPLETE_COURSES = "cours_incomplets"
AUDIO_FOLDER, REFERENCE_FOLDER, MANUAL_FOLDER = "audio", "refs", "trs_manu"


def with_content(files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``content``, the bytes of each named file, read by the tasks.

    For lists of files that a join has narrowed down: the bytes are read after
    it and never shuffled.
    """
    schema = StructType([*files.schema.fields, StructField("content", BinaryType())])

    def read(batches):
        from urllib.parse import quote

        from pyarrow import fs

        for batch in batches:
            contents = []
            for name in batch[path]:
                address = quote(name, safe="/:@+=,")
                address = address if ":" in address.partition("/")[0] else f"file://{address}"
                system, place = fs.FileSystem.from_uri(address)
                with system.open_input_stream(place) as stream:
                    contents.append(stream.read())
            yield batch.assign(content=contents)

    return files.mapInPandas(read, schema)


def _decoded(path: Column) -> Column:
    """``_metadata.file_path`` is a URI; give back the plain characters."""
    plus_kept = F.regexp_replace(path, r"\+", "%2B")
    return F.coalesce(F.try_url_decode(plus_kept), path)


def _keys(path: Column, subset_level: int = 3) -> dict[str, Column]:
    return {"subset": path_segment(path, subset_level), "stem": file_stem(path)}


def _audio_glob(extensions: Sequence[str]) -> str:
    return "*.{" + ",".join(e for name in extensions for e in (name, name.upper())) + "}"


def scan_audio(
    spark: SparkSession,
    *folders: str,
    extensions: Sequence[str] = AUDIO_EXTENSIONS,
    content: bool = False,
) -> DataFrame:
    """``path, subset, stem, audio_file, extension`` of audio files, not recursive.

    ``content`` adds the bytes; without it the files are listed and not read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", _audio_glob(extensions))
        .load(list(folders))
    )
    path = F.col("path")
    columns = {**_keys(path), "audio_file": file_name(path), "extension": F.substring_index(path, ".", -1)}
    return files.select(
        path,
        *[value.alias(name) for name, value in columns.items()],
        *([F.col("content")] if content else []),
    )


def _scan_text(spark: SparkSession, folders: Sequence[str], suffix: str) -> DataFrame:
    """``path, subset, stem, content``: one row per file, read as UTF-8."""
    read = scan_files(spark, folders, suffix).select(
        F.regexp_replace("path", "^file:/+", "file:///").alias("path"),
        unix_newlines(F.col("content").cast("string")).alias("content"),
    )
    keys = [value.alias(name) for name, value in _keys(F.col("path")).items()]
    return read.select("path", *keys, "content")


def scan_references(spark: SparkSession, *folders: str) -> DataFrame:
    """``path, subset, stem, reference``: each ``.txt`` file, stripped."""
    files = _scan_text(spark, folders, ".txt")
    return files.select("path", "subset", "stem", strip(F.col("content")).alias("reference"))


def scan_benchmark(
    spark: SparkSession, root: str, subsets: Sequence[str]
) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """Audio, references and warnings of a benchmark tree.

    A subset that lacks its audio or its reference folder is left out and named
    in the warnings, and so are files that the scans don't list. Without any complete subset the first two are ``None``.
    """
    complete, warnings = [], []
    for subset in subsets:
        for folder in (AUDIO_FOLDER, REFERENCE_FOLDER):
            path = f"{root}/{subset}/{folder}"
            if not path_exists(spark, path):
                warnings.append((subset, f"folder not found: {path}"))
                break
        else:
            complete.append(subset)
            warnings += [
                (subset, f"file not listed: {folder}/{name}")
                for folder in (AUDIO_FOLDER, REFERENCE_FOLDER)
                for name in unlisted_files(spark, f"{root}/{subset}/{folder}")
            ]
    report = spark.createDataFrame(warnings, "subset string, warning string")
    if not complete:
        return None, None, report
    return (
        scan_audio(spark, *[f"{root}/{s}/{AUDIO_FOLDER}" for s in complete]),
        scan_references(spark, *[f"{root}/{s}/{REFERENCE_FOLDER}" for s in complete]),
        report,
    )


def scan_stm(spark: SparkSession, *folders: str, drop_label: bool = False) -> DataFrame:
    """``path, subset, stem, text``: the speech of each STM file in file order."""
    files = _scan_text(spark, folders, ".stm")
    text = stm_transcript(F.col("content"), drop_label)
    return files.select("path", "subset", "stem", text.alias("text"))


def scan_stm_cues(
    spark: SparkSession, *folders: str, drop_label: bool = False, pattern: str = "*.stm"
) -> DataFrame:
    """One row per cue, read line by line so that large files are split over tasks.

    ``cue`` numbers the cues of a file from 1 in file order, comments and
    incomplete lines not counted. ``gap`` is the time since the end of the cue
    before, whatever split of the file holds it: negative where the two
    overlap, null for the first cue of a file, and where a time is missing or is
    no number. The lines are written to the work folder once and read from there.
    """
    lines = with_places(spark.read.option("pathGlobFilter", pattern).text(list(folders)))
    line = F.col("value")
    cues = lines.select(
        PATH, SPLIT, RANK,
        stm_field(line, 1).alias("filename"),
        stm_field(line, 2).alias("channel"),
        stm_field(line, 3).alias("speaker"),
        stm_field(line, 4).try_cast("double").alias("start"),
        stm_field(line, 5).try_cast("double").alias("end"),
        stm_text(line, drop_label).alias("text"),
    ).filter("filename <> ''")
    placed = numbered(stage(cues, "stm-cues"), number="cue", previous={"_ended": F.col("end")})
    path = _decoded(F.col(PATH))
    return placed.select(
        path.alias("path"), file_stem(path).alias("stem"), "cue", "filename", "channel", "speaker", "start", "end",
        (F.col("start") - F.col("_ended")).alias("gap"), "text",
    )


def scan_trs(
    spark: SparkSession,
    *folders: str,
    element_text_only: bool = False,
    unreadable: str | None = "",
) -> DataFrame:
    """``path, subset, stem, text`` of TRS files; unreadable XML gives the text ``unreadable``."""
    files = scan_files(spark, folders, ".trs")
    text = F.coalesce(trs_transcript(F.col("content"), element_text_only), F.lit(unreadable))
    keys = [value.alias(name) for name, value in _keys(F.col("path")).items()]
    return files.select("path", *keys, text.alias("text"))


def scan_subtitles(spark: SparkSession, *folders: str, form: str = "srt") -> DataFrame:
    """``path, subset, stem, text`` of SRT or VTT files."""
    if form not in ("srt", "vtt"):
        raise ValueError("form is 'srt' or 'vtt'")
    files = _scan_text(spark, folders, f".{form}")
    return files.select("path", "subset", "stem", subtitle_transcript(F.col("content")).alias("text"))


def subtitle_references(
    spark: SparkSession, subtitle_folder: str, audio_folder: str, form: str = "srt"
) -> DataFrame:
    """Subtitle texts with the audio found for them; ``reason`` where there is none."""
    texts = scan_subtitles(spark, subtitle_folder, form=form).drop("subset", "path")
    audio = scan_audio(spark, audio_folder, extensions=TRANSCRIPT_AUDIO)
    return attach_preferred_audio(texts, audio)


def text_references(
    spark: SparkSession, text_folder: str, audio_folder: str | None = None
) -> DataFrame:
    """``stem, reference``: text files unchanged, if given only those that have audio."""
    texts = _scan_text(spark, [text_folder], ".txt").select(
        "stem", F.col("content").alias("reference")
    )
    if audio_folder is None:
        return texts
    return texts_with_audio(texts, scan_audio(spark, audio_folder, extensions=TRANSCRIPT_AUDIO))


def discover_courses(
    spark: SparkSession, root: str, element_text_only: bool = False
) -> DataFrame:
    """``course, stem, text, reason`` of all complete courses below ``root/data``.

    ``reason`` is null for usable transcripts, else ``unreadable`` or ``too
    short``. Without any such tree there are no rows.

    A course with STM files is read from those, any other from its TRS files.
    That is settled by listing folders, before any file is read: the TRS files
    of a course with STM files are not even part of the scan.
    """
    folders = [
        folder
        for folder in matching_folders(spark, f"{root}/data/*/{MANUAL_FOLDER}")
        if not (course := folder.split("/")[-2]).startswith(".") and course != INCOMPLETE_COURSES
    ]
    timed = folders_with(spark, folders, ".stm")
    others = sorted(set(folders) - set(timed))
    course = path_segment(F.col("path"), 3).alias("course")
    texts = spark.createDataFrame([], "course string, stem string, text string")
    if timed:
        texts = texts.unionByName(scan_stm(spark, *map(literally, timed)).select(course, "stem", "text"))
    if others:
        trs = scan_trs(spark, *map(literally, others), element_text_only=element_text_only, unreadable=None)
        texts = texts.unionByName(trs.select(course, "stem", "text"))
    reason = F.when(F.col("text").isNull(), "unreadable").when(
        F.length(strip(F.col("text"))) < MIN_TEXT_LENGTH, "too short"
    )
    return texts.withColumn("reason", reason)


def course_audio(spark: SparkSession, root: str) -> DataFrame:
    """Audio beside courses: ``course, stem, path, extension, folder_rank`` (0 is tried first)."""
    path = F.col("path")
    found = None
    places = (
        (f"{root}/data/*/audio", 3),
        (f"{root}/data/audio/*", 2),
        (f"{root}/audio/*", 2),
    )
    for rank, (folder, level) in enumerate(places):
        if not matches(spark, folder):
            continue
        listed = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", "*.{" + ",".join(COURSE_AUDIO) + "}")
            .load(folder)
            .select(
                path_segment(path, level).alias("course"),
                file_stem(path).alias("stem"),
                path,
                F.substring_index(path, ".", -1).alias("extension"),
                F.lit(rank).alias("folder_rank"),
            )
        )
        found = listed if found is None else found.unionByName(listed)
    if found is None:
        schema = "course string, stem string, path string, extension string, folder_rank int"
        return spark.createDataFrame([], schema)
    return found


def course_samples(spark: SparkSession, root: str) -> DataFrame:
    """Course transcripts with the audio found in one of three folders, else a ``reason``.

    The reason is that of the transcript, or else the lack of audio.
    """
    found = attach_preferred_audio(
        discover_courses(spark, root).withColumnRenamed("reason", "_unusable"),
        course_audio(spark, root),
        keys=("course", "stem"),
        order=COURSE_AUDIO,
        folder_rank="folder_rank",
    )
    return found.withColumn("reason", F.coalesce("_unusable", "reason")).drop("_unusable")


def audio_inventory(audio: DataFrame, content: str = "content") -> DataFrame:
    """Replace the bytes by frames, sampling rate, channels, duration and reason.

    The duration is null where the content cannot be read.
    """
    kept = [c for c in audio.columns if c != content]
    probed = audio.withColumn("_head", wav_head_facts(F.col(content)))
    facts = probed.select(*kept, wav_full_facts(F.col(content), F.col("_head")).alias("_facts"))
    frames, rate = F.col("_facts.frames"), F.col("_facts.sampling_rate")
    return facts.select(
        *kept,
        "_facts.frames",
        "_facts.sampling_rate",
        "_facts.channels",
        duration_seconds(frames, rate).alias("duration"),
        F.col("_facts.reason").alias("audio_error"),
    )


def metadata_from_pairs(audio: DataFrame, references: DataFrame, source: str = "manual") -> DataFrame:
    """Metadata of every WAV file that has a reference; unreadable audio has duration 0."""
    wav = audio.filter(F.col("extension") == "wav")
    facts = audio_inventory(wav.select("path", "stem", "content"))
    seconds = F.coalesce(duration_rounded(F.col("frames"), F.col("sampling_rate")), F.lit(0.0))
    found = references.select("stem", F.col("path").alias("ref_path"))
    return facts.join(found, "stem").select(
        F.col("stem").alias("id"),
        F.lit(source).alias("source"),
        F.col("path").alias("audio_path"),
        "ref_path",
        seconds.alias("duration"),
        F.lit(SAMPLING_RATE).alias("sampling_rate"),
    )
