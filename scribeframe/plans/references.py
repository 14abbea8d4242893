"""Four ways to get reference transcripts, all giving ``id, text``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeframe.operators.hooks import pseudo_references
from scribeframe.operators.sampling import first_n
from scribeframe.sources.corpus import references_from_corpus
from scribeframe.sources.files import scan_audio, subtitle_references, text_references


def from_dataset(
    df: DataFrame,
    key: str,
    predicate: Column | None = None,
    limit: int | None = None,
    audio: str = "audio",
    text: str = "transcript",
) -> DataFrame:
    """Texts of a stored split, with ``audio``; ``limit`` counts rows in key order."""
    chosen = df if limit is None else first_n(df, key, limit)
    return references_from_corpus(chosen, key, predicate, audio, text).select(
        "id", F.col("reference").alias("text"), "audio"
    )


def from_subtitles(
    spark: SparkSession, subtitle_folder: str, audio_folder: str, form: str = "srt"
) -> DataFrame:
    """Subtitle texts that have audio."""
    found = subtitle_references(spark, subtitle_folder, audio_folder, form)
    return found.filter("reason is null").select(F.col("stem").alias("id"), "text")


def from_model(spark: SparkSession, audio_folder: str, factory) -> DataFrame:
    """Model output, marked ``is_pseudo``."""
    audio = scan_audio(spark, audio_folder, content=True)
    return pseudo_references(audio, factory, key="stem").select(
        F.col("stem").alias("id"), F.col("reference").alias("text"), "is_pseudo"
    )


def from_text_files(
    spark: SparkSession, text_folder: str, audio_folder: str | None = None
) -> DataFrame:
    """Text files unchanged, if asked only those that have audio."""
    return text_references(spark, text_folder, audio_folder).select(
        F.col("stem").alias("id"), F.col("reference").alias("text")
    )
