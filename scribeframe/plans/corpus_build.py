"""Corpus job: sources in, kept samples, metadata, rejects and summaries out."""

from __future__ import annotations

from collections.abc import Collection, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeframe.operators.curate import (
    corpus_summary,
    kept_rows,
    label_rejects,
    metadata_rows,
    mixture_report,
    rejected_rows,
    union_sources,
)
from scribeframe.operators.sampling import first_n, sample_ids
from scribeframe.session import stage

# Samples taken per source and the prefix of its ids.
SOURCE_QUOTAS = {"SUMM-RE": 15, "VoxPopuli": 8, "PASTEL": 15}
ID_PREFIXES = {"SUMM-RE": "summre", "VoxPopuli": "voxp", "PASTEL": "pastel"}


@dataclass(frozen=True)
class CorpusResult:
    references: DataFrame
    metadata: DataFrame
    rejects: DataFrame
    summary: DataFrame
    mixture: DataFrame


def source_samples(
    df: DataFrame, source: str, key: str, prefix: str | None = None, n: int | None = None
) -> DataFrame:
    """``id, source, position_key, text, frames`` of one source, ids in key order.

    ``n`` limits the rows before they are numbered: the first positions are the
    same, and only the rows that stay are numbered and joined.
    """
    prefix = ID_PREFIXES.get(source, "edu") if prefix is None else prefix
    chosen = df if n is None else first_n(df, key, n)
    ids = sample_ids(chosen.select(key), prefix, key)
    return chosen.join(ids, key).select(
        "id", F.lit(source).alias("source"), F.col(key).alias("position_key"), "text", "frames"
    )


def build_corpus(
    sources: Mapping[str, DataFrame],
    key: str,
    quotas: Mapping[str, int] | None = None,
    sampling_rate: int = 16_000,
    dense: Collection[str] = (),
    targets: Mapping[str, float] | None = None,
) -> CorpusResult:
    """Number, limit, check and describe the samples of several sources.

    Each source is a frame with ``key, text, frames``. Without ``quotas`` all
    rows are taken; ``SOURCE_QUOTAS`` holds the usual ones. Quotas come before
    the checks, so a rejected sample is not replaced. Ids count all rows, with
    gaps where one is rejected, but for the ``dense`` sources only kept rows.
    """
    quotas = {} if quotas is None else quotas
    parts = [source_samples(frame, name, key, n=quotas.get(name)) for name, frame in sources.items()]
    timed = union_sources(*parts).withColumn("duration", F.col("frames") / F.lit(sampling_rate))
    # Five outputs read the checked rows, so they are computed once.
    labelled = stage(label_rejects(timed), "labelled")
    kept = kept_rows(labelled)
    for name in dense:
        own = kept.filter(F.col("source") == name)
        numbered = sample_ids(own.drop("id"), ID_PREFIXES.get(name, "edu"), "position_key")
        kept = kept.filter(F.col("source") != name).unionByName(numbered)
    metadata = metadata_rows(kept, sampling_rate=sampling_rate)
    return CorpusResult(
        references=kept.select("id", F.col("normalized").alias("text")),
        metadata=metadata,
        rejects=rejected_rows(labelled).select("id", "source", "reason", "duration"),
        summary=corpus_summary(metadata),
        mixture=mixture_report(metadata, None if targets is None else dict(targets)),
    )
