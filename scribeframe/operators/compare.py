"""Compare a baseline with a candidate on the same samples and judge objectives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scribeframe.functions.edits import word_edits
from scribeframe.functions.metrics import error_rate, improvement, improvement_percent
from scribeframe.functions.text import PROFILES, words

# Objective names and what each one asks for.
OBJECTIVES = {
    "wer_improvement": "candidate error rate below the baseline",
    "multilingual_preserved": "other languages as good as before",
    "french_quality": "better French on the test set",
}


def pair_models(
    baseline: DataFrame,
    candidate: DataFrame,
    key: str = "sample_id",
    shared: Sequence[str] = ("reference",),
) -> DataFrame:
    """Both models' scores side by side, paired by sample and never by position.

    A sample scored by one model only is kept, with nulls for the other.
    ``shared`` names columns that belong to the sample and not to the model.
    """
    return pair_with_reason(baseline, candidate, key, shared).drop("reason")


def pair_with_reason(
    baseline: DataFrame,
    candidate: DataFrame,
    key: str = "sample_id",
    shared: Sequence[str] = ("reference",),
) -> DataFrame:
    """``pair_models`` and the ``reason`` why a sample is not a pair, null if it is one.

    ``baseline only`` or ``candidate only`` tells which model scored it, also
    where a hypothesis or a rate is null. Null keys pair with nothing; a key
    that a model has several times pairs with each row of the other's.
    """
    own = ["hypothesis", "word_edits", "ref_words", "wer"]

    def named(scored: DataFrame, prefix: str) -> DataFrame:
        columns = [F.col(c).alias(f"{prefix}_{c}") for c in [*shared, *own]]
        return scored.select(key, *columns, F.lit(True).alias(f"{prefix}_scored"))

    paired = named(baseline, "baseline").join(named(candidate, "candidate"), key, "full_outer")
    return paired.select(
        key,
        *[F.coalesce(f"baseline_{c}", f"candidate_{c}").alias(c) for c in shared],
        *[F.col(f"{prefix}_{c}") for prefix in ("baseline", "candidate") for c in own],
        F.when(F.col("candidate_scored").isNull(), "baseline only")
        .when(F.col("baseline_scored").isNull(), "candidate only")
        .alias("reason"),
    )


def pairing_report(paired: DataFrame, *group: str) -> DataFrame:
    """What the rates of a comparison rest on, per group of ``pair_with_reason`` rows.

    ``samples`` of either model, ``both_scored`` of them scored by both,
    ``baseline_only``, ``candidate_only``; and ``baseline_rate`` and
    ``candidate_rate`` over the samples that both scored, so that a sample one
    model lacks can't favour it.
    """
    both = F.col("reason").isNull()

    def rate(model: str) -> Column:
        edits, words_ = (F.sum(F.when(both, F.col(f"{model}_{c}"))) for c in ("word_edits", "ref_words"))
        return F.try_divide(edits.cast("double"), words_.cast("double")).alias(f"{model}_rate")

    return paired.groupBy(*group).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(both).alias("both_scored"),
        F.count_if(F.col("reason") == "baseline only").alias("baseline_only"),
        F.count_if(F.col("reason") == "candidate only").alias("candidate_only"),
        rate("baseline"),
        rate("candidate"),
    )


def score_both(
    df: DataFrame,
    profile: str = "basic",
    key: str = "sample_id",
    shared: Sequence[str] = ("reference",),
) -> DataFrame:
    """Both models' scores where one table holds both hypotheses, without a join.

    ``df`` has ``key``, ``reference``, ``baseline_hypothesis`` and
    ``candidate_hypothesis``; the result has the columns of ``pair_models``.
    The reference is normalised once, and what both models need of a step is
    asked for together, so that Python gets a batch once per step.
    """
    normalize = PROFILES[profile]
    models = ("baseline", "candidate")
    ref = F.col("reference")
    hyps = {prefix: F.col(f"{prefix}_hypothesis") for prefix in models}
    texts = {"_ref": ref} | {f"_{prefix}": hyp for prefix, hyp in hyps.items()}
    out = df.withColumns({name: F.when(text.isNotNull(), normalize(text)) for name, text in texts.items()})
    out = out.withColumns(
        {"_ref_words": F.size(words(F.col("_ref"))).cast("bigint")}
        | {f"{prefix}_word_edits": word_edits(F.col("_ref"), F.col(f"_{prefix}")) for prefix in models}
    )
    columns = []
    for prefix, hyp in hyps.items():
        count = F.size(words(F.col(f"_{prefix}"))).cast("bigint")
        out = out.withColumn(f"{prefix}_ref_words", F.when(hyp.isNotNull(), F.col("_ref_words")))
        rate = error_rate(F.col(f"{prefix}_word_edits"), F.col("_ref_words"), count, ref, hyp)
        out = out.withColumn(f"{prefix}_wer", rate)
        columns += [f"{prefix}_{c}" for c in ("hypothesis", "word_edits", "ref_words", "wer")]
    return out.select(key, *shared, *columns)


def compare(paired: DataFrame, language: str | None = None, tolerance: float = 0.0) -> DataFrame:
    """One row: corpus error rate of each model and the gain of the candidate.

    With a ``language`` column, ``multilingual_preserved`` tells whether no
    language got worse by more than ``tolerance``; without one it is null, not
    measured. Sums per language feed both, so the samples are read once.
    """
    base, cand = F.col("baseline_wer"), F.col("candidate_wer")
    sums = [f"{prefix}_{c}" for prefix in ("baseline", "candidate") for c in ("word_edits", "ref_words")]
    parts = paired.groupBy(*([language] if language else [])).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.count(base).alias("test_samples"),
        F.count(F.when(base.isNotNull() & cand.isNotNull(), 1)).alias("paired_samples"),
    )
    if language:
        kept = _rate("candidate") <= _rate("baseline") + tolerance
        parts = parts.agg(
            *[F.sum(c).alias(c) for c in [*sums, "test_samples", "paired_samples"]],
            F.every(kept).alias("multilingual_preserved"),
        )
    else:
        parts = parts.withColumn("multilingual_preserved", F.lit(None).cast("boolean"))
    return parts.select(
        _rate("baseline").alias("baseline_wer"),
        _rate("candidate").alias("candidate_wer"),
        "test_samples",
        "paired_samples",
        "multilingual_preserved",
    ).withColumns(
        {
            "improvement": improvement(base, cand),
            "improvement_percent": improvement_percent(base, cand),
        }
    )


def _rate(prefix: str) -> Column:
    return F.try_divide(F.col(f"{prefix}_word_edits"), F.col(f"{prefix}_ref_words"))


def objectives(comparison: DataFrame) -> DataFrame:
    """Add ``objectives_met``, the number met and the verdict."""
    better = F.col("candidate_wer") < F.col("baseline_wer")
    met = F.create_map(
        F.lit("wer_improvement"), better,
        F.lit("multilingual_preserved"), F.col("multilingual_preserved"),
        F.lit("french_quality"), better,
    )
    yes = F.filter(F.map_values("objectives_met"), lambda flag: F.coalesce(flag, F.lit(False)))
    verdict = (
        F.when(F.col("met_count") == len(OBJECTIVES), "success")
        .when(F.col("met_count") > 0, "partial")
        .otherwise("failure")
    )
    return (
        comparison.withColumn("objectives_met", met)
        .withColumn("met_count", F.size(yes))
        .withColumn("verdict", verdict)
    )


def report(comparison: DataFrame, baseline_model: str, candidate_model: str) -> DataFrame:
    """The evaluation report as one row."""
    return comparison.select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("date"),
        F.lit(baseline_model).alias("baseline_model"),
        F.lit(candidate_model).alias("fine_tuned_model"),
        "baseline_wer",
        F.col("candidate_wer").alias("fine_tuned_wer"),
        "improvement",
        "improvement_percent",
        "objectives_met",
        "test_samples",
    )


def first_examples(paired: DataFrame, key: str = "sample_id", n: int = 3) -> DataFrame:
    """The first samples, reference and both hypotheses side by side."""
    columns = [key, "reference", "baseline_hypothesis", "candidate_hypothesis"]
    return paired.select(*columns).orderBy(key).limit(n)


def worst_examples(paired: DataFrame, key: str = "sample_id", n: int = 10) -> DataFrame:
    """The samples on which the candidate lost most against the baseline.

    Samples without a loss sort last and go after the limit: a filter before it
    would move below the scoring and compute the edits twice.
    """
    loss = F.col("candidate_wer") - F.col("baseline_wer")
    worst = paired.withColumn("loss", loss).orderBy(F.desc_nulls_last("loss"), F.asc(key)).limit(n)
    return worst.filter("loss is not null").orderBy(F.desc("loss"), F.asc(key))
