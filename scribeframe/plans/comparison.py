"""Comparison job: two models on the same test samples."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from scribeframe.operators import compare
from scribeframe.operators.scoring import score_pairs


@dataclass(frozen=True)
class ModelComparison:
    paired: DataFrame
    outcome: DataFrame
    report: DataFrame
    examples: DataFrame


def compare_models(
    baseline: DataFrame,
    candidate: DataFrame,
    baseline_model: str,
    candidate_model: str,
    key: str = "sample_id",
    profile: str = "basic",
    language: str | None = None,
) -> ModelComparison:
    """Score both models' ``key, reference, hypothesis`` rows and judge the objectives."""
    shared = ["reference", *([language] if language else [])]
    paired = compare.pair_models(
        score_pairs(baseline, profile), score_pairs(candidate, profile), key, shared
    )
    outcome = compare.objectives(compare.compare(paired, language))
    return ModelComparison(
        paired=paired,
        outcome=outcome,
        report=compare.report(outcome, baseline_model, candidate_model),
        examples=compare.first_examples(paired, key),
    )
