"""Score hypotheses against references and summarise error rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scribeframe.functions import edits
from scribeframe.functions.metrics import error_rate
from scribeframe.functions.text import PROFILES, words

TOTAL = "GLOBAL AVG"


def score_pairs(
    df: DataFrame,
    profile: str = "eval",
    with_cer: bool = False,
    reference: str = "reference",
    hypothesis: str = "hypothesis",
) -> DataFrame:
    """Add edits, unit counts and error rates to rows holding a reference and a hypothesis.

    A map without a shuffle: each text is normalised once and dropped again.
    """
    normalize = PROFILES[profile]
    kept = df.columns
    ref, hyp = F.col(reference), F.col(hypothesis)
    out = df.withColumns(
        {
            "_ref": F.when(ref.isNotNull(), normalize(ref)),
            "_hyp": F.when(hyp.isNotNull(), normalize(hyp)),
        }
    )
    counted = {
        "profile": F.lit(profile),
        "ref_words": F.size(words(F.col("_ref"))).cast("bigint"),
        "hyp_words": F.size(words(F.col("_hyp"))).cast("bigint"),
        "word_edits": edits.word_edits(F.col("_ref"), F.col("_hyp")),
    }
    if with_cer:
        counted |= {
            "ref_chars": F.length("_ref").cast("bigint"),
            "hyp_chars": F.length("_hyp").cast("bigint"),
            "char_edits": edits.char_edits(F.col("_ref"), F.col("_hyp")),
        }
    out = out.withColumns(counted)
    rates = {
        "wer": error_rate(F.col("word_edits"), F.col("ref_words"), F.col("hyp_words"), ref, hyp)
    }
    rates["cer"] = (
        error_rate(F.col("char_edits"), F.col("ref_chars"), F.col("hyp_chars"), ref, hyp)
        if with_cer
        else F.lit(None).cast("double")
    )
    return out.withColumns(rates).select(*kept, *counted, *rates)


def error_rates(scored: DataFrame, by: str = "subset", total: str = TOTAL) -> DataFrame:
    """Mean error rate per subset and over all samples, in one pass.

    Subsets come in order of their names and the total last. The total weighs
    every sample alike; it is not the mean of the subset means.
    ``corpus_wer`` divides all edits by all reference words instead. CER columns
    appear when the rows were scored with CER.
    """
    def ratio(numerator: str, denominator: str):
        return F.try_divide(F.sum(numerator), F.sum(denominator))

    measures = [
        F.count("wer").alias("samples"),
        F.avg("wer").alias("avg_wer"),
        F.avg("cer").alias("avg_cer"),
        F.sum("word_edits").alias("word_edits"),
        F.sum("ref_words").alias("ref_words"),
        ratio("word_edits", "ref_words").alias("corpus_wer"),
    ]
    if "char_edits" in scored.columns:
        measures.append(ratio("char_edits", "ref_chars").alias("corpus_cer"))
    report = scored.rollup(by).agg(F.grouping(by).alias("_total"), *measures)
    label = F.when(F.col("_total") == 1, total).otherwise(F.col(by))
    return report.select(
        label.alias(by),
        (F.col("_total") == 1).alias("is_total"),
        *[c for c in report.columns if c not in (by, "_total")],
    ).orderBy("is_total", by)


def corpus_error_rate(scored: DataFrame) -> DataFrame:
    """One error rate for the whole set: all edits over all reference words."""
    return scored.agg(
        F.count("wer").alias("samples"),
        F.sum("word_edits").alias("word_edits"),
        F.sum("ref_words").alias("ref_words"),
        F.try_divide(F.sum("word_edits"), F.sum("ref_words")).alias("corpus_wer"),
    )


def with_all_subsets(
    report: DataFrame, subsets: list[str], by: str = "subset", empty_as_zero: bool = False
) -> DataFrame:
    """Add a row for each requested subset in which nothing was scored.

    Its error rate is null. ``empty_as_zero`` reports 0.0 there, which reads
    like a perfect score.
    """
    spark = report.sparkSession
    wanted = spark.createDataFrame([(name,) for name in subsets], f"{by} string")
    missing = wanted.join(report, by, "left_anti").withColumns(
        {
            "is_total": F.lit(False),
            "samples": F.lit(0).cast("bigint"),
            "avg_wer": F.lit(0.0 if empty_as_zero else None).cast("double"),
        }
    )
    return report.unionByName(missing, allowMissingColumns=True).orderBy("is_total", by)
