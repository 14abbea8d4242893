"""Benchmark job: audio with references and hypotheses, scored and summarised."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scribeframe.operators.hooks import Transcriber, transcribe
from scribeframe.operators.match import match_audio_references
from scribeframe.operators.scoring import error_rates, score_pairs, with_all_subsets
from scribeframe.session import stage
from scribeframe.sources.files import scan_benchmark, with_content

# Subsets of a benchmark tree unless others are named.
DEFAULT_SUBSETS = ("meetings", "telephone", "accents", "longform")


@dataclass(frozen=True)
class BenchmarkResult:
    scored: DataFrame
    summary: DataFrame
    rejects: DataFrame


def benchmark_report(
    audio: DataFrame,
    references: DataFrame,
    hypotheses: DataFrame,
    profile: str = "eval",
    with_cer: bool = False,
    subsets: Sequence[str] = (),
) -> BenchmarkResult:
    """Score ``hypotheses(subset, audio_file, hypothesis, error)`` against the references.

    Audio without a reference and rows whose transcription failed are rejects.
    """
    matched = match_audio_references(audio, references)
    heard = hypotheses.select("subset", "audio_file", "hypothesis", F.col("error").alias("_error"))
    joined = matched.join(heard, ["subset", "audio_file"], "left")
    reason = F.coalesce(
        F.col("reason"),
        F.col("_error"),
        F.when(F.col("hypothesis").isNull(), "no hypothesis"),
    )
    labelled = joined.withColumn("reason", reason)
    pairs = labelled.filter("reason is null").select(
        "subset", "audio_file", "reference", "hypothesis"
    )
    scored = score_pairs(pairs, profile=profile, with_cer=with_cer)
    summary = error_rates(scored)
    if subsets:
        summary = with_all_subsets(summary, list(subsets))
    rejects = labelled.filter("reason is not null").select("subset", "audio_file", "reason")
    return BenchmarkResult(scored, summary, rejects)


def run_benchmark(
    spark: SparkSession,
    root: str,
    factory,
    subsets: Sequence[str] = DEFAULT_SUBSETS,
    profile: str = "eval",
    with_cer: bool = False,
    batch_size: int = 1,
) -> tuple[BenchmarkResult | None, DataFrame]:
    """Scan a benchmark tree, transcribe with the given model and score.

    Returns the result, ``None`` without any complete subset, and the warnings.
    """
    audio, references, warnings = scan_benchmark(spark, root, subsets)
    if audio is None:
        return None, warnings
    # Paths are joined and bytes read after that; the model runs once, its output is staged.
    wanted = audio.join(references.select("subset", "stem"), ["subset", "stem"], "left_semi")
    contents = with_content(wanted.select("path"))
    heard = stage(transcribe_files(contents, factory, batch_size), "heard")
    return benchmark_report(audio, references, heard, profile, with_cer, subsets), warnings


def transcribe_files(contents: DataFrame, factory, batch_size: int = 1) -> DataFrame:
    """``subset, audio_file, hypothesis, error`` for audio files read with their content."""
    heard = transcribe(contents.select("path", "content"), factory, key="path", batch_size=batch_size)
    segments = F.split("path", "/")
    return heard.select(
        F.element_at(segments, -3).alias("subset"),
        F.element_at(segments, -1).alias("audio_file"),
        "hypothesis",
        "error",
    )


__all__ = ["BenchmarkResult", "Transcriber", "benchmark_report", "run_benchmark", "transcribe_files"]
