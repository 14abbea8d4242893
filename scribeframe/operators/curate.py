"""Clean a corpus: columns, predicates, reject reasons, metadata, validation, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from scribeframe.functions.audio import duration_rounded
from scribeframe.functions.text import normalize_strict, not_blank, strip

# Accepted duration in seconds, shortest course transcript,
# sampling rate, column names tried in order, the mixture aimed at, and the
# message of an invalid duration (id and seconds are put in).
MIN_DURATION = 10.0
MAX_DURATION = 600.0
MIN_TEXT_LENGTH = 10
SAMPLING_RATE = 16_000
AUDIO_COLUMNS = ("audio", "speech", "sound")
TEXT_COLUMNS = ("transcription", "text", "sentence", "transcript")
TARGET_SHARES = {"SUMM-RE": 0.40, "PASTEL": 0.40, "VoxPopuli": 0.20}
INVALID_DURATION = ("Invalid duration for ", ": ", "s")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}; there are {df.columns}")
    return df


def select_corpus(df: DataFrame, audio: str = "audio", text: str = "transcript") -> DataFrame:
    """Keep the audio and text columns under the names ``audio`` and ``text``."""
    require_columns(df, audio, text)
    return df.select(F.col(audio).alias("audio"), F.col(text).alias("text"))


def resolve_columns(
    df: DataFrame,
    audio: Sequence[str] = AUDIO_COLUMNS,
    text: Sequence[str] = TEXT_COLUMNS,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``audio``: first listed column present; ``text``: per row, first one not empty."""
    audio_found = [name for name in audio if name in df.columns]
    filled = [F.nullif(F.col(name), F.lit("")) for name in text if name in df.columns]
    return df.select(
        *keep,
        (F.col(audio_found[0]) if audio_found else F.lit(None).cast("binary")).alias("audio"),
        (F.coalesce(*filled) if filled else F.lit(None).cast("string")).alias("text"),
    )


def drop_empty_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.filter(not_blank(F.col(text)))


def with_audio_and_text(df: DataFrame, audio: str = "audio", text: str = "text") -> DataFrame:
    return df.filter(F.col(audio).isNotNull() & (F.col(text) != ""))


def drop_empty_normalized(df: DataFrame, text: str = "text") -> DataFrame:
    """Keep rows with something left after strict normalisation, in ``normalized``."""
    return df.withColumn("normalized", normalize_strict(F.col(text))).filter("normalized <> ''")


def minimum_length(df: DataFrame, text: str = "text", length: int = MIN_TEXT_LENGTH) -> DataFrame:
    return df.filter(F.length(strip(F.col(text))) >= length)


def duration_in_range(
    df: DataFrame, duration: str = "duration", low: float = MIN_DURATION, high: float = MAX_DURATION
) -> DataFrame:
    """Both limits belong to the range; pass the duration before rounding."""
    return df.filter(F.col(duration).between(low, high))


def label_rejects(
    df: DataFrame,
    text: str = "text",
    duration: str = "duration",
    audio_error: str | None = None,
    low: float = MIN_DURATION,
    high: float = MAX_DURATION,
) -> DataFrame:
    """Add ``normalized`` and ``reason``, null for rows that pass every check.

    One pass; the first failing check in the order below names the reason. A
    decode error counts as duration zero unless ``audio_error`` names its column.
    """
    seconds = F.coalesce(F.col(duration).cast("double"), F.lit(0.0))
    reason = F.when(~not_blank(F.col(text)), "empty text").when(
        F.col("normalized") == "", "empty after normalisation"
    )
    if audio_error is not None:
        reason = reason.when(F.col(audio_error).isNotNull(), "audio error")
    reason = reason.when(seconds < low, "too short").when(seconds > high, "too long")
    return df.withColumn("normalized", normalize_strict(F.col(text))).withColumn("reason", reason)


def kept_rows(labelled: DataFrame) -> DataFrame:
    return labelled.filter("reason is null").drop("reason")


def rejected_rows(labelled: DataFrame) -> DataFrame:
    return labelled.filter("reason is not null")


def metadata_rows(
    kept: DataFrame,
    root: str = "benchmark/education",
    sampling_rate: int = SAMPLING_RATE,
    frames: str = "frames",
) -> DataFrame:
    """Metadata of kept samples: id, source, both paths, rounded duration, sampling rate."""
    def path(folder: str, suffix: str) -> Column:
        return F.concat(F.lit(f"{root}/{folder}/"), F.col("id"), F.lit(suffix))

    return kept.select(
        "id",
        "source",
        path("audio", ".wav").alias("audio_path"),
        path("refs", ".txt").alias("ref_path"),
        duration_rounded(F.col(frames), F.lit(sampling_rate)).alias("duration"),
        F.lit(sampling_rate).alias("sampling_rate"),
    )


def invalid_durations(
    metadata: DataFrame, low: float = MIN_DURATION, high: float = MAX_DURATION
) -> DataFrame:
    seconds = F.coalesce(F.col("duration"), F.lit(0.0))
    return metadata.filter(~seconds.between(low, high)).select(
        "id",
        F.concat(
            F.lit(INVALID_DURATION[0]),
            F.coalesce("id", F.lit("")),
            F.lit(INVALID_DURATION[1]),
            seconds,
            F.lit(INVALID_DURATION[2]),
        ).alias("error"),
    )


def validate(
    metadata: DataFrame, audio_paths: DataFrame, ref_paths: DataFrame, root: str | None = None
) -> DataFrame:
    """All violations: paths not listed and durations out of range. Valid when empty.

    ``root`` is the folder that relative metadata paths start from.
    """
    from scribeframe.operators.match import missing_files

    missing = missing_files(metadata, audio_paths, ref_paths, root)
    return missing.unionByName(invalid_durations(metadata))


def validity(violations: DataFrame) -> DataFrame:
    """One row: whether the corpus is valid and how many violations there are."""
    return violations.agg(F.count(F.lit(1)).alias("errors")).select(
        (F.col("errors") == 0).alias("is_valid"), "errors"
    )


def corpus_summary(metadata: DataFrame, total: str = "TOTAL") -> DataFrame:
    """Files and minutes per source, sources in order of their names, and last in all."""
    report = metadata.rollup("source").agg(
        F.grouping("source").alias("_total"),
        F.count(F.lit(1)).alias("files"),
        (F.sum("duration") / 60).alias("minutes"),
    )
    return report.select(
        F.when(F.col("_total") == 1, total).otherwise(F.col("source")).alias("source"),
        (F.col("_total") == 1).alias("is_total"),
        "files",
        "minutes",
    ).orderBy("is_total", "source")


def mixture_report(df: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """Share of each source and its distance from the target share, in order of the names."""
    targets = TARGET_SHARES if targets is None else targets
    spark = df.sparkSession
    goal = spark.createDataFrame(list(targets.items()), "source string, target double")
    counts = df.groupBy("source").agg(F.count(F.lit(1)).alias("files"))
    everything = df.select(F.count(F.lit(1)).alias("n")).scalar()
    return (
        counts.join(goal, "source", "full_outer")
        .withColumn("files", F.coalesce("files", F.lit(0).cast("bigint")))
        .withColumn("share", F.try_divide(F.col("files"), everything))
        .withColumn("gap", F.col("share") - F.col("target"))
        .orderBy("source")
    )


def union_sources(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all frames, duplicates kept, columns matched by name."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def size_report(
    df: DataFrame, text: str = "text", split: str | None = None
) -> tuple[DataFrame, Observation]:
    """The frame unchanged plus an observation of its size, filled by the next action.

    ``loaded`` and ``kept`` rows and, where ``split`` names the column of the
    sides, ``train`` and ``test`` rows among the kept.
    """
    kept = not_blank(F.col(text))
    counts = [F.count(F.lit(1)).alias("loaded"), F.count_if(kept).alias("kept")]
    if split is not None:
        counts += [F.count_if(kept & (F.col(split) == side)).alias(side) for side in ("train", "test")]
    seen = Observation()
    return df.observe(seen, *counts), seen
